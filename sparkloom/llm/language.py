"""Language identification by fusing evidence.

The log-likelihood of a page's text under character trigram models is added to
the log-probabilities of its declared markup language and of its address suffix
given each language, and to a host prior smoothed towards the host's domain and
that towards all pages. All tables but the text models come from grouped
aggregation over all pages.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

#: Labelled texts for each language (those of smallest hash); cells of the trigram tables, and in all languages' tables together.
SAMPLE_ROWS, CELLS = 1_500, 1 << 15
ALL_CELLS = 64 * CELLS
#: Trigrams overlap, so their sum is tempered; and it weighs as that of so many trigrams at most, so that a long text can't outvote all else (a parameter; README has figures without).
TEMPER, MOST_GRAMS = 0.3, 400
#: Pseudo-counts: of a language given a declaration or suffix, of the domain in a host, of all pages in a domain.
SMOOTH, HOST_WEIGHT, DOMAIN_WEIGHT = 1.0, 10.0, 50.0

_DROP = re.compile(r"(?is)<!--.*?-->|<(script|style|head|nav|footer|aside|form)\b.*?</\1\s*>|<[^>]*>")
_FIRST = re.compile(r"""(?is)<!--.*?(?:-->|\Z)|<html(?=[\s/>])((?:[^>"']|"[^"]*"|'[^']*')*)""")
_ATTRIBUTE = re.compile(r"""(?s)([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_CODE = re.compile(r"(?i)[a-z]{2,3}(?![a-z])")
_LETTERS = re.compile(r"[^\W\d_]+")


def visible(html: str | None) -> str:
    return html_lib.unescape(_DROP.sub(" ", html)) if html else ""


def declared(html: str | None) -> str:
    """The primary code in the attribute `lang` of the first html tag that stands in no comment; else ''."""
    tag = next((m[1] for m in _FIRST.finditer(html or "") if m[1] is not None), "")
    said = next((m[2] or "" for m in _ATTRIBUTE.finditer(tag) if m[1].lower() == "lang"), "")
    code = _CODE.match(said.strip("\"'").strip())
    return code[0].lower() if code else ""


def trigrams(text: str | None) -> np.ndarray:
    """Cells of the trigrams of a text's letters, lower-cased, with blanks between words."""
    line = " " + " ".join(_LETTERS.findall(text.lower())) + " " if text else " "
    c = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.empty(0, np.int64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1]) * np.uint64(0x85EBCA77) + c[2:]
    return ((h ^ (h >> np.uint64(15))) % np.uint64(CELLS)).astype(np.int64)


def train_text(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities of trigrams, from about `rows` distinct labelled texts of each language. Many languages share fewer cells each."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    found = known.groupBy(lang_col).agg(F.approx_count_distinct(F.xxhash64(text_col)).alias("n")).collect()
    langs = sorted(r[0] for r in found)
    if not langs:
        return ["und"], np.full((1, CELLS), -np.log(CELLS))
    size = CELLS  # a power of two
    while size > 1 << 10 and size * len(langs) > ALL_CELLS:
        size //= 2
    # A share of each language by hash that holds about `rows` texts: no sort and no window over the corpus. Copies count once.
    share = F.create_map(*(x for r in found for x in (F.lit(r[0]), F.lit(1.0 if r["n"] <= rows else rows / r["n"]))))
    known = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    picked = known.where(F.pmod("h", F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20)).groupBy("lang", "h").agg(F.min("text").alias("text")).drop("h")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = sums.setdefault(lang, np.zeros(size, np.int64))
                s += np.bincount(trigrams(text) % size, minlength=size)
        cells = [(k, c, s[c]) for k, s in sums.items() for c in np.flatnonzero(s)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in cells], pa.string()), pa.array([x[1] for x in cells], pa.int32()), pa.array([x[2] for x in cells], pa.int64())], names=["lang", "cell", "n"])

    counts = picked.mapInArrow(count, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((len(langs), size), 0.5)
    table[counts["lang"].map(langs.index).to_numpy(int), counts["cell"].to_numpy(int)] += counts["n"]
    return langs, np.log(table / table.sum(1, keepdims=True))


def _text_evidence(pages: DataFrame, langs: list[str], table: np.ndarray, id_col: str, url_col: str, html_col: str, most: float) -> DataFrame:
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(table.astype(np.float32))  # at most ALL_CELLS, or 1,024 for each language
    fields = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            logs, said = [], []
            for html in b.column(2).to_pylist():
                cells = trigrams(visible(html)) % t.shape[1]
                n = len(cells)
                logs.append((t[:, cells].sum(1).astype(float) * (TEMPER * min(1.0, most / n))).tolist() if n else [0.0] * len(langs))
                said.append(declared(html))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said, pa.string()), pa.array(logs, pa.list_(pa.float64()))], names=[id_col, url_col, "declared", "text_log"])

    return pages.select(id_col, url_col, html_col).mapInArrow(work, ", ".join([*fields, "declared string, text_log array<double>"]))


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://([^/?#:]*)", 1))


def _suffix(url: Column) -> Column:
    """The host's last label, with a two-letter first part of the path, which many sites give the language in."""
    url = F.coalesce(url, F.lit(""))
    return F.concat(F.regexp_extract(_host(url), r"([^.]*)$", 1), F.lit("/"), F.lower(F.regexp_extract(url, r"://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1)))


def _votes(rows: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """One row for each key: how many of its rows each language's text evidence won. Summed before the shuffle."""
    return rows.groupBy(key).agg(F.array(*(F.sum((F.col("won") == k).cast("double")) for k in range(n))).alias(name))


def _given(counts: DataFrame, key: str, name: str, totals: Column, kinds: Column) -> DataFrame:
    """log P(key | language) with pseudo-counts."""
    return counts.select(key, F.zip_with(counts["v"], totals, lambda c, t: F.log((c + SMOOTH) / (t + SMOOTH * kinds))).alias(name))


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", lang_col: str = "lang", text_col: str = "text", most: float = MOST_GRAMS) -> DataFrame:
    """Per row of pages: id, url, host, declared, text_lang, lang, score (posterior of lang).

    docs gives labelled texts; a page's text weighs as `most` trigrams at most (inf: all of them). Null html counts as empty: the text then says
    nothing (text_lang null) and the other evidence decides. Null urls share the
    host ''. Ties go to the language first in the alphabet. Rows stay one for one.
    Host and suffix tables are joined, not broadcast by force, so Spark picks by
    size and can split a hot host.
    """
    small_batches(pages.sparkSession)
    langs, table = train_text(docs, lang_col, text_col)
    n = len(langs)
    first = _text_evidence(pages, langs, table, id_col, url_col, html_col, most)
    best = F.array_max("text_log")
    seen = first.withColumns({
        "host": _host(F.col(url_col)), "suffix": _suffix(F.col(url_col)),
        "won": F.when(F.array_min("text_log") == best, F.lit(-1)).otherwise(F.array_position("text_log", best).cast("int") - 1) if n > 1 else F.lit(0),
    })
    seen = written(seen.withColumn("domain", F.regexp_extract("host", r"([^.]*\.[^.]*)$", 1)), "evidence")
    total = [float(x or 0) for x in seen.agg(*(F.sum((F.col("won") == k).cast("double")) for k in range(n))).first()]
    totals = F.array(*(F.lit(x) for x in total))
    everywhere = F.array(*(F.lit((x + 1) / (sum(total) + n)) for x in total))

    said = written(_votes(seen, "declared", n, "v"), "declared")
    suffix = written(_votes(seen, "suffix", n, "v"), "suffixes")
    n_said, n_suffix = F.lit(float(said.count() + 1)), F.lit(float(suffix.count() + 1))
    hosts = _votes(seen, "host", n, "hv").withColumn("domain", F.regexp_extract("host", r"([^.]*\.[^.]*)$", 1))
    domains = _votes(seen, "domain", n, "dv")
    size = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    prior = hosts.join(domains, "domain", "left").select(
        "host", "hv", F.zip_with("dv", everywhere, lambda c, g: (c + g * DOMAIN_WEIGHT) / (size(F.col("dv")) + DOMAIN_WEIGHT)).alias("dp")
    )
    joined = (
        seen.join(_given(said, "declared", "by_said", totals, n_said), "declared", "left")
        .join(_given(suffix, "suffix", "by_suffix", totals, n_suffix), "suffix", "left")
        .join(prior, "host", "left")
    )
    # A page's own vote is taken out of its host's counts.
    others = F.transform("hv", lambda c, k: F.greatest(c - (k == F.col("won")).cast("double"), F.lit(0.0)))
    by_host = F.zip_with(others, "dp", lambda c, d: F.log(c + d * HOST_WEIGHT))
    log = F.zip_with(F.zip_with("text_log", "by_said", lambda a, b: a + b), F.zip_with("by_suffix", by_host, lambda a, b: a + b), lambda a, b: a + b)
    out = joined.select(id_col, url_col, "host", "declared", "won", log.alias("log"))
    top = F.array_max("log")
    names = F.array(*(F.lit(x) for x in langs))
    return out.select(
        id_col, url_col, "host", "declared", F.when(F.col("won") >= 0, F.get(names, F.col("won"))).alias("text_lang"),
        F.get(names, F.array_position("log", top).cast("int") - 1).alias("lang"),
        (1 / F.aggregate("log", F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("log")))).alias("score"),
    )
