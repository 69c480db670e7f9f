"""Validation of question-answer pairs with reason codes, and reports on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T


def reason(question: str = "question", answer: str = "answer", language: str = "language", lexicon: Sequence[str] = L.MEDICAL_TERMS, openers: Sequence[str] = L.QUESTION_WORDS, any_opener: bool = False) -> Column:
    """`ok`, or why a pair is rejected. Tests run in this order and the first that fails names the reason."""
    arabic = T.language_bucket(language) == "arabic"

    def first(q: Column, a: Column) -> Column:
        nq, na = F.length(q), F.length(a)
        out = (
            F.when(~nq.between(L.MIN_QUESTION, L.MAX_QUESTION), F.concat(F.lit("q_len="), nq.cast("string")))
            .when(~na.between(L.MIN_ANSWER, L.MAX_ANSWER), F.concat(F.lit("a_len="), na.cast("string")))
            .when(a.rlike("(?iu)" + "|".join(L.REFUSALS)), "refusal_boilerplate")
        )
        if not any_opener:
            out = out.when(~T.looks_like_question(q, openers), "not_a_question")
        return (
            out.when((na < L.THIN_ANSWER) & (T.sentence_count(a) < L.MIN_SENTENCES), "answer_too_thin")
            .when(arabic & (T.arabic_ratio(q) < 0.5) & (T.arabic_ratio(a) < 0.5), "arabic_ratio_low")
            .when(~arabic & (T.ascii_ratio(q) < 0.5) & (T.ascii_ratio(a) < 0.5), "ascii_ratio_low")
            .when(~(T.contains_any(q, lexicon) | T.contains_any(a, lexicon)), "no_medical_term")
            .otherwise("ok")
        )

    return T.let(T.strip(question), lambda q: T.let(T.strip(answer), lambda a: first(q, a)))


def validate(pairs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """pairs with `reason`. It is exploded from an array of one, so that filters on it don't work it out a second time."""
    return pairs.withColumn("reason", F.explode(F.array(reason(**options))))


def rejections(checked: DataFrame, by: str = "specialty") -> DataFrame:
    return checked.where("reason <> 'ok'").groupBy(by, "reason").agg(F.count("*").alias("n"))


def funnel(checked: DataFrame, kept: DataFrame | None = None, by: str = "specialty") -> DataFrame:
    """input, kept_after_filter, kept_after_dedup and keep_rate for each group."""
    out = checked.groupBy(by).agg(F.count("*").alias("input"), F.count_if(F.col("reason") == "ok").alias("kept_after_filter"))
    if kept is not None:
        out = out.join(kept.groupBy(by).agg(F.count("*").alias("kept_after_dedup")), by, "left").fillna(0, ["kept_after_dedup"])
        out = out.withColumn("keep_rate", 100 * F.col("kept_after_dedup") / F.greatest(F.lit(1), F.col("input")))
    return out


def report(checked: DataFrame, kept: DataFrame, by: str = "specialty") -> DataFrame:
    """The funnel with a map of rejections for each group."""
    maps = rejections(checked, by).groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("rejections"))
    return funnel(checked, kept, by).join(maps, by, "left")


def valid_made(question: str, answer: str, least_question: int = 40, least_answer: int = 80) -> Column:
    """Lengths that a generated pair must have, trimmed; null counts as empty."""
    return (F.length(T.strip(question)) >= least_question) & (F.length(T.strip(answer)) >= least_answer)


def valid_translation(fr_q: str, fr_a: str, da_q: str, da_a: str) -> Column:
    """Four non-blank texts, and characters of the Arabic ranges at half the letters of the last two at least."""
    full = (T.strip(fr_q) != "") & (T.strip(fr_a) != "") & (T.strip(da_q) != "") & (T.strip(da_a) != "")
    both = F.concat(F.coalesce(F.col(da_q), F.lit("")), F.coalesce(F.col(da_a), F.lit("")))
    share = T.let(both, lambda s: F.try_divide(T.kept(s, T.ARABIC), T.kept(s, r"\p{L}")))
    return full & F.coalesce(share >= 0.5, F.lit(False))


def dialect_flag(q_ratio: str = "q_arabic_ratio", a_ratio: str = "a_arabic_ratio", q_ppl: str = "q_ppl", a_ppl: str = "a_ppl", min_ratio: float = 0.35, max_ppl: float = 800) -> Column:
    high = lambda c: F.coalesce(F.col(c) > max_ppl, F.lit(False))
    return (F.col(q_ratio) < min_ratio) | (F.col(a_ratio) < min_ratio) | high(q_ppl) | high(a_ppl)


def dialect_summary(scores: DataFrame, by: str = "specialty") -> DataFrame:
    """n, flagged, mean ratios and exact medians of perplexity (null if all are)."""
    return scores.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(dialect_flag()).alias("flagged"),
        F.avg(F.round("q_arabic_ratio", 3)).alias("q_ratio"), F.avg(F.round("a_arabic_ratio", 3)).alias("a_ratio"),
        F.median("q_ppl").alias("q_ppl"), F.median("a_ppl").alias("a_ppl"),
    )


def complete_trilingual(cols: Sequence[str] = ("question_en", "answer_en", "question_fr", "answer_fr", "question_darija", "answer_darija")) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & (T.truthy(c) != "")
    return out


def from_source(how: str, what: str, col: str = "source") -> Column:
    """Provenance tests: contains, lacks, equals, startswith."""
    c = F.coalesce(F.col(col), F.lit(""))
    return {"contains": c.contains(what), "lacks": ~c.contains(what), "equals": c == what, "startswith": c.startswith(what)}[how]


def has_sources(*cols: str) -> Column:
    """Whether any of the arrays holds something: a cheap gate before a costly step."""
    out = F.lit(False)
    for c in cols:
        out = out | (F.coalesce(F.size(c), F.lit(0)) > 0)
    return out


def drop_prefixed(df: DataFrame, prefix: str = "audio_") -> DataFrame:
    return df.drop(*(c for c in df.columns if c.startswith(prefix)))
