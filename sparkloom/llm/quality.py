"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import set_aside

# Frequent function words of the languages served
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "be", "with", "as", "by", "this", "are", "at", "from"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "que", "qui", "dans", "pour", "par", "sur", "est", "pas", "au", "avec"],
    "de": ["der", "die", "das", "und", "in", "den", "von", "zu", "mit", "ist", "des", "dem", "ein", "eine", "im", "nicht", "für", "auf", "als", "es"],
    "es": ["el", "la", "los", "las", "de", "del", "y", "en", "un", "una", "que", "se", "por", "con", "no", "para", "su", "al", "lo", "es"],
}

#: Measure, lowest and highest value kept (None: no bound on that side). A document is kept within all of them.
THRESHOLDS: list[tuple[str, float | None, float | None]] = [
    ("mean_word_chars", 2.0, 14.0),
    ("symbols_per_word", None, 0.1),
    ("bangs_per_word", None, 0.1),
    ("stop_word_share", 0.06, None),
    ("dup_line_share", None, 0.5),
]

#: Fewest words, and the largest share of words (per cent) in repeated windows of three words.
MIN_WORDS, MAX_REPEAT = 50, 50


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with value computed once: a lambda's variable is a bound value."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pairwise(a: Column, f) -> Column:  # noqa: ANN001
    """f(x, next x) over an array; f gets null after the last."""
    return F.zip_with(a, F.slice(a, 2, F.greatest(F.size(a), F.lit(1))), f)


def _repeat_words(words: Column) -> Column:
    """Words that lie in 3-word windows found twice or more.

    Windows are sorted with their positions, equal neighbours mark both
    positions, and the union of the marked windows is measured along the sorted
    positions; n log n in the text's words.
    """

    def windows(w: Column) -> Column:
        n = F.size(w)
        two = F.zip_with(F.slice(w, 1, n - 2), F.slice(w, 2, n - 2), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.zip_with(two, F.slice(w, 3, n - 2), lambda a, b: F.concat(a, F.lit(" "), b))

    def sorted_(t: Column) -> Column:
        return F.array_sort(F.transform(t, lambda x, i: F.struct(x.alias("t"), i.alias("i"))))

    def marked(z: Column) -> Column:
        hit = F.filter(_pairwise(z, lambda a, b: F.when(a["t"] == b["t"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull())
        return F.array_sort(F.array_distinct(F.flatten(hit)))

    def covered(p: Column) -> Column:
        gaps = _pairwise(p, lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)

    def found(t: Column) -> Column:
        return F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0).cast("long")).otherwise(_let(_let(sorted_(t), marked), covered))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(windows(words), found))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The id (and the columns `keep`), and the measures of each text.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, the
    ratios of THRESHOLDS, failed (array of the measures out of bounds) and kept.
    Null and empty texts have no words and are not kept. Rows stay one for one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws})
    blank = "\t\n\x0b\f\r "
    symbols = "#*$%&|<>"
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, blank, "")) > 0)
    count = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")
    # One bound value holds what is used more than once, so that nothing is computed twice.
    row = _let(
        F.struct(words.alias("w"), lines.alias("l")),
        lambda x: F.struct(
            F.size(x["w"]).cast("long").alias("n_words"),
            F.length(F.translate(text, blank, "")).cast("long").alias("word_chars"),
            count(symbols).alias("n_symbols"),
            (F.size(x["l"]) - F.size(F.array_distinct(x["l"]))).cast("long").alias("n_dup_lines"),
            _let(x["w"], _repeat_words).alias("n_repeat_words"),
            F.size(x["l"]).cast("long").alias("n_lines"),
            count("!").alias("n_bangs"),
            F.size(F.filter(x["w"], lambda w: F.lower(w).isin(stops))).cast("long").alias("n_stop_words"),
        ),
    )
    kept = [id_col, *(c for c in keep or [] if c != id_col)]
    found = docs.select(*kept, row.alias("__m")).select(*kept, "__m.*")
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    ratio = {
        "mean_word_chars": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "bangs_per_word": F.col("n_bangs") / n,
        "stop_word_share": F.col("n_stop_words") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
    }
    out = F.lit(False)
    marks = []
    for name, low, high in THRESHOLDS:
        bad = (ratio[name] < low if low is not None else F.lit(False)) | (ratio[name] > high if high is not None else F.lit(False))
        out = out | bad
        marks.append(F.when(bad, F.lit(name)))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return found.select(
        *kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~out).alias("kept"),
        *(ratio[name].alias(name) for name, _, _ in THRESHOLDS), F.filter(F.array(*marks), lambda x: x.isNotNull()).alias("failed"),
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that pass, with their own columns."""
    own, names, back = set_aside(docs)
    return measures(own, names[id_col], names[text_col], keep=own.columns).where("kept").select(*back)


def oracle_sql() -> str:
    """DuckDB SQL for the columns of op9."""
    stops = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    value = {
        "mean_word_chars": "word_chars / greatest(n_words, 1)", "symbols_per_word": "n_symbols / greatest(n_words, 1)", "bangs_per_word": "n_bangs / greatest(n_words, 1)",
        "stop_word_share": "n_stop / greatest(n_words, 1)", "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    }
    bad = " or ".join([f"{value[n]} < {lo}" for n, lo, _ in THRESHOLDS if lo is not None] + [f"{value[n]} > {hi}" for n, _, hi in THRESHOLDS if hi is not None])
    return rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
p as (select r, unnest(ws) as x, unnest(range(len(ws))) as i from w),
g as (select r, i, x || ' ' || lead(x) over o || ' ' || lead(x, 2) over o as g from p window o as (partition by r order by i)),
m as (select r, i from (select r, i, count(*) over (partition by r, g) as c from g where g is not null) where c > 1),
k as (select r, count(distinct i + j) as n from m, (select unnest([0, 1, 2]) as j) group by r),
f as (select w.r, doc_id, len(ws)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
             coalesce(k.n, 0)::bigint as n_repeat_words, len(ls) as n_lines, length(regexp_replace(t, '[^!]', '', 'g')) as n_bangs,
             len(list_filter(ws, lambda x: lower(x) in ({stops}))) as n_stop from w left join k using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words as base_failed,
       not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words or {bad}) as kept from f"""
