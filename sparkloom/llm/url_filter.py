"""URL filter: host rules first, then the ratio of two character language models.

Urls that rules allow or block train two smoothed models of variable order (up
to three characters before, each order interpolated with the next lower by how
many kinds of character followed). Other urls are judged by the difference of
the models' log-likelihoods per character, against a threshold calibrated on
rule-judged urls that the models haven't seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Verdict, host and path of the rules
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Characters are folded to 32 symbols, so that all counts of four fit 2**20 cells whatever the input's size.
SYMBOLS, PAD = 32, 30
#: One in so many rule-judged urls calibrates.
FOLDS, BINS, SPAN = 5, 400, 4.0


def _fold() -> np.ndarray:
    t = np.full(256, 31, np.int64)
    t[0] = PAD
    for c in range(26):
        t[97 + c] = t[65 + c] = c
    t[48:58] = 26
    t[ord(".")], t[ord("/")], t[ord("-")] = 27, 28, 29
    return t


def grams(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all runs of four symbols that end in a character, and the url each belongs to. What precedes `://` is left out."""
    bodies = [(u or "").partition("://") for u in urls]
    raw = [(tail if sep else head).replace("\0", "?").encode() for head, sep, tail in bodies]
    lens = np.array([len(r) for r in raw], np.int64)
    codes = _fold()[np.frombuffer(b"".join(b"\0\0\0" + r for r in raw), np.uint8)]
    own = np.repeat(np.arange(len(raw)), lens + 3)
    starts = np.cumsum(lens + 3) - (lens + 3)
    real = np.flatnonzero(np.arange(len(codes)) - starts[own] >= 3)
    cells = ((codes[real - 3] * SYMBOLS + codes[real - 2]) * SYMBOLS + codes[real - 1]) * SYMBOLS + codes[real]
    return cells, own[real]


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Log-probability of the last symbol of each cell, orders three down to none interpolated."""
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(4):
        c = counts.reshape(-1, SYMBOLS ** (order + 1)).sum(0).reshape(-1, SYMBOLS).astype(float)
        kinds = (c > 0).sum(1, keepdims=True) + (c.sum(1, keepdims=True) == 0)
        lower = np.tile(p.reshape(-1, SYMBOLS), (SYMBOLS if order else 1, 1)) if order else p.reshape(1, -1)
        p = (c + kinds * lower) / (c.sum(1, keepdims=True) + kinds)
    return np.log(p).reshape(-1).astype(np.float32)


def host_of(url: Column) -> Column:
    tail = F.regexp_extract(url, r"(?s)://(.*)$", 1)
    return F.translate(F.regexp_extract(tail, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    tail = F.regexp_extract(url, r"(?s)://(.*)$", 1)
    return F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1)


def judged(pages: DataFrame, url_col: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages with host, path, rule (`host/path` of the longest rule that fits, or null) and rule_verdict; all by built-in expressions."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    out = pages.withColumns({"host": host_of(url), "path": path_of(url)})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest comes last and so decides
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return out.withColumns({"rule": rule, "rule_verdict": verdict})


def _train_fold(url_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(url_col), F.lit(""))) % FOLDS != 0


def train(seen: DataFrame, url_col: str = "url") -> tuple[np.ndarray, float]:
    """Log-ratio of each cell and the threshold, from the rows of judged() that a rule decided.

    All of those rows count. Without rows of both verdicts the ratio is nil and
    the threshold 0, which allows what no rule decides.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, SYMBOLS**4), np.int64)
        for b in batches:
            cells, own = grams(b.column(0).to_pylist())
            yes = np.array(b.column(1).to_pylist(), bool)[own] if len(own) else np.zeros(0, bool)
            for k in (0, 1):
                sums[k] += np.bincount(cells[yes == k], minlength=SYMBOLS**4)
        k, cell = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(cell, pa.int32()), pa.array(sums[k, cell], pa.int64())], names=["good", "cell", "n"])

    known = seen.where(F.col("rule_verdict").isNotNull()).select(F.col(url_col).alias("u"), (F.col("rule_verdict") == "allow").alias("good"), _train_fold(url_col).alias("fit"))
    counts = known.where("fit").select("u", "good").mapInArrow(count, "good int, cell int, n bigint").groupBy("good", "cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((2, SYMBOLS**4), np.int64)
    table[counts["good"].to_numpy(int), counts["cell"].to_numpy(int)] = counts["n"]
    if not table[0].any() or not table[1].any():
        return np.zeros(SYMBOLS**4, np.float32), 0.0
    ratio = log_probabilities(table[1]) - log_probabilities(table[0])
    scored = scored_urls(known.where("not fit"), ratio, "u", ["good"])
    bins = scored.groupBy("good", F.least(F.greatest(F.floor((F.col("score") + SPAN) / (2 * SPAN) * BINS), F.lit(0)), F.lit(BINS - 1)).alias("bin")).count().toPandas()
    hist = np.zeros((2, BINS))
    hist[bins["good"].to_numpy(int), bins["bin"].to_numpy(int)] = bins["count"]
    if not hist[0].any() or not hist[1].any():
        return ratio, 0.0
    # accepted urls at or above each bin's edge, rejected ones below it
    quality = hist[1][::-1].cumsum()[::-1] / hist[1].sum() + (hist[0].cumsum() - hist[0]) / hist[0].sum()
    best = np.flatnonzero(quality == quality.max())
    return ratio, float(best[len(best) // 2] / BINS * 2 * SPAN - SPAN)


def scored_urls(rows: DataFrame, ratio: np.ndarray, url_col: str, keep: list[str]) -> DataFrame:
    """The columns `keep` and score, the log-ratio per character (0 for empty urls)."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(ratio)  # 4 MB, whatever the input
    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = b.column(0).to_pylist()
            cells, own = grams(urls)
            total = np.bincount(own, weights=shared.value[cells], minlength=len(urls)) if len(urls) else np.zeros(0)
            n = np.bincount(own, minlength=len(urls)) if len(urls) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(i + 1) for i in range(len(keep))), pa.array(total / np.maximum(n, 1), pa.float64())], names=[*keep, "score"])

    return rows.select(F.col(url_col).alias("__url"), *keep).mapInArrow(work, ", ".join([*fields, "score double"]))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per row: id, host, path, rule, verdict, score (log-ratio per character).

    Null urls and urls without `://` have empty host and path, so no rule fits
    them; null and empty ones score 0. Ties with the threshold are allowed. Rows
    stay one for one.
    """
    small_batches(pages.sparkSession)
    seen = judged(pages.select(id_col, url_col), url_col, rules)
    ratio, threshold = train(seen, url_col)
    out = scored_urls(seen, ratio, url_col, [id_col, "host", "path", "rule", "rule_verdict"])
    by_score = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return out.select(id_col, "host", "path", "rule", F.coalesce("rule_verdict", by_score).alias("verdict"), "score")
