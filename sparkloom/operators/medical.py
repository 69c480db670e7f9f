"""Entity-level answer metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T

CATEGORIES = ("drugs", "symptoms", "exams", "dosages")


def drugs_in(x: Column | str, vocabulary: Sequence[str]) -> Column:
    """Drugs of a vocabulary that stand in the text as words, sorted."""
    hit = F.regexp_extract_all(F.lower(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))), F.lit(r"(?U)[\p{L}\p{N}_-]+"), F.lit(0))
    return F.array_sort(F.array_intersect(F.array_distinct(hit), F.array(*(F.lit(v.lower()) for v in vocabulary)).cast("array<string>")))


def entities(x: Column | str, drugs: Sequence[str] = (), symptoms: dict = L.SYMPTOMS, exams: dict = L.EXAMS) -> Column:
    """struct of sorted distinct drugs, symptoms, exams and dosages."""
    return F.struct(
        drugs_in(x, drugs).alias("drugs"), F.array_sort(T.groups_in(x, symptoms)).alias("symptoms"),
        F.array_sort(T.groups_in(x, exams)).alias("exams"), F.array_sort(F.array_distinct(F.transform(T.answer_dosages(x), T.normalize))).alias("dosages"),
    )


def recall(pred: str, ref: str) -> Column:
    """For each category the share of the reference's entities that the prediction has (null if it has none); macro is the mean of those of drugs, symptoms and exams that aren't null, 0 if all are."""
    per = {c: F.try_divide(F.size(F.array_intersect(f"{pred}.{c}", f"{ref}.{c}")), F.size(f"{ref}.{c}")) for c in CATEGORIES}
    some = F.filter(F.array(*(per[c] for c in CATEGORIES[:3])), lambda x: x.isNotNull())
    macro = F.coalesce(F.try_divide(F.aggregate(some, F.lit(0.0), lambda s, x: s + x), F.size(some)), F.lit(0.0))
    return F.struct(*(v.alias(k) for k, v in per.items()), macro.alias("macro"))


def hallucination(pred: str, ref: str) -> Column:
    """For each category the share of the prediction's entities that the reference lacks (0 if it has none); macro is the mean of the four."""
    per = {c: F.coalesce(F.try_divide(F.size(F.array_except(f"{pred}.{c}", f"{ref}.{c}")), F.size(f"{pred}.{c}")), F.lit(0.0)) for c in CATEGORIES}
    return F.struct(*(v.alias(k) for k, v in per.items()), (sum(per.values(), F.lit(0.0)) / len(CATEGORIES)).alias("macro"))


def candidates(pred: Column | str, k: int = 3, cues: Sequence[str] = L.DIAGNOSIS_CUES) -> Column:
    """The first k diagnoses that an answer lists: what follows the first cue (in the cues' order), split at numbers, else bullets, else `or` and `ou`."""
    text = F.coalesce(F.col(pred) if isinstance(pred, str) else pred, F.lit(""))
    low, after = F.lower(text), None
    for cue in cues:
        at = F.locate(cue, low)
        after = F.when(at > 0, T.strip(F.substr(text, at + len(cue)))) if after is None else after.when(at > 0, T.strip(F.substr(text, at + len(cue))))
    text = text if after is None else after.otherwise(text)
    filled = lambda a: F.filter(a, lambda s: T.strip(s) != "")
    numbered = filled(F.split(F.concat(F.lit(" "), text), r"(?U)\s+\d+[\.\)]\s+"))
    bullets = F.regexp_extract_all(text, F.lit(r"(?mdU)^\s*[-•*]\s*([^\n]+)"), F.lit(1))
    either = F.split(text, r"(?U)\bor\b|\bou\b", k + 1)
    parts = F.when(F.size(numbered) >= 2, numbered).when(F.size(bullets) > 0, bullets).otherwise(either)
    clean = F.transform(filled(parts), lambda s: F.regexp_replace(s, r"^[ .;:,—\-\n]+|[ .;:,—\-\n]+$", ""))
    return F.slice(clean, 1, k)


def hit_at_k(pred: Column | str, ref: Column | str, k: int = 3, least: int = 4) -> Column:
    """1 if one of the first k diagnoses contains the reference or the reverse (diagnoses of `least` characters up), else 0; null if either text is empty."""
    want = T.normalize(ref)
    match = F.exists(candidates(pred, k), lambda c: (F.length(T.normalize(c)) >= least) & (F.contains(T.normalize(c), want) | F.contains(want, T.normalize(c))))
    return F.when((T.truthy(pred) != "") & (T.truthy(ref) != ""), match.cast("int"))


def pathology(x: Column | str, groups: dict[str, Sequence[str]] = L.PATHOLOGIES) -> Column:
    """The group with most keywords in the text; of equals the one declared first; `other` without any."""
    low = F.lower(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")))
    votes = [sum((F.contains(low, F.lit(t)).cast("int") for t in ts), F.lit(0)) for ts in groups.values()]
    top = F.greatest(*votes) if len(votes) > 1 else votes[0]
    out = F.when(top == 0, "other")
    for name, v in zip(groups, votes, strict=True):
        out = out.when(v == top, name)
    return out.otherwise("other")


def breakdown(scored: DataFrame, least: int = 3) -> DataFrame:
    """Mean recall, hallucination and hit@k overall, by language and by pathology (of `least` rows up), in one pass over the rows.

    scored: lang, pathology, recall, hallucination, hit. Null hits don't count; a mean of nothing is 0.
    """
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(c)
    sets = scored.groupingSets([[], [F.col("lang")], [F.col("pathology")]], F.col("lang"), F.col("pathology"))
    out = sets.agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), mean("recall"), mean("hallucination"), mean("hit"))
    level = F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, "lang").otherwise("pathology")
    return out.withColumn("level", level).where((F.col("level") != "pathology") | (F.col("n") >= least)).select("level", F.coalesce("lang", "pathology", F.lit("all")).alias("value"), "n", "recall", "hallucination", "hit")


def aggregate(scored: DataFrame) -> DataFrame:
    """One row: the twelve macro metrics and how many answers name a dosage that the reference lacks.

    scored: rec and hal (of recall and hallucination), hit (null doesn't count) and
    cites (whether the answer cites anything). Means of nothing are 0.
    """
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return scored.agg(
        F.count("*").alias("n"), *(mean(f"rec.{c}").alias(f"recall_{c}") for c in (*CATEGORIES[:3], "macro")), *(mean(f"hal.{c}").alias(f"hallu_{c}") for c in (*CATEGORIES, "macro")),
        mean("hit").alias("hit_at_k"), (F.count_if("cites") / F.greatest(F.lit(1), F.count("*"))).alias("citations_share"), F.count_if(F.col("hal.dosages") > 0).alias("n_dosage_hallu"),
    )


def invented_dosages(scored: DataFrame) -> DataFrame:
    """The answers that name a dosage which the reference lacks."""
    return scored.where(F.col("hal.dosages") > 0)
