"""Inter-annotator agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kappa(a: str, b: str) -> Column:
    """Cohen's kappa of two binary columns as an aggregate: null without rows; with no chance of disagreement 1 if all agree, else 0."""
    same, pa, pb = F.avg((F.col(a) == F.col(b)).cast("double")), F.avg(F.col(a).cast("double")), F.avg(F.col(b).cast("double"))
    chance = pa * pb + (1 - pa) * (1 - pb)
    return F.when(chance == 1, F.when(same == 1, 1.0).otherwise(0.0)).otherwise(F.try_divide(same - chance, 1 - chance))


def pairwise(ratings: DataFrame, least: int = 2) -> DataFrame:
    """ratings: rater, pair_id, criterion, value. For each criterion and two raters with `least` common ratings: n and kappa."""
    r = ratings.where("value is not null")
    a = r.select("pair_id", "criterion", F.col("rater").alias("rater_a"), F.col("value").alias("va"))
    b = r.select("pair_id", "criterion", F.col("rater").alias("rater_b"), F.col("value").alias("vb"))
    both = a.join(b, ["pair_id", "criterion"]).where("rater_a < rater_b")
    return both.groupBy("criterion", "rater_a", "rater_b").agg(F.count("*").alias("n"), kappa("va", "vb").alias("kappa")).where(F.col("n") >= least)


def summary(pairs: DataFrame, target: float = 0.65) -> DataFrame:
    """Mean kappa of each criterion, from kappas rounded to 3 places, and whether it meets the target."""
    return pairs.groupBy("criterion").agg(F.round(F.avg(F.round("kappa", 3)), 3).alias("mean_kappa")).withColumn("passed", F.col("mean_kappa") >= target)


def rated_by_all(ratings: DataFrame, raters: int) -> DataFrame:
    return ratings.groupBy("pair_id").agg(F.countDistinct("rater").alias("n")).where(F.col("n") == raters).select("pair_id")


def acceptance(items: DataFrame, by: str = "specialty", criteria: tuple[str, ...] = ("c1", "c2", "c3")) -> DataFrame:
    """n, n_real, n_made and how many passed (value 1) each criterion, with n_rejected (some value 0; null is no rejection)."""
    bad = F.lit(False)
    for c in criteria:
        bad = bad | F.coalesce(F.col(c) == 0, F.lit(False))
    real = F.coalesce(F.col("source").startswith("real"), F.lit(False))
    passed = [F.count_if(F.col(c) == 1).alias(f"{c}_pass") for c in criteria]
    return items.groupBy(by).agg(F.count("*").alias("n"), F.count_if(real).alias("n_real"), F.count_if(~real).alias("n_made"), *passed, F.count_if(bad).alias("n_rejected"))


def rejected(items: DataFrame, criteria: tuple[str, ...] = ("c1", "c2", "c3")) -> DataFrame:
    bad = F.lit(False)
    for c in criteria:
        bad = bad | F.coalesce(F.col(c) == 0, F.lit(False))
    return items.where(bad)


def overall(criteria: DataFrame, target: float = 0.65) -> DataFrame:
    """One row: the mean of the criteria's mean kappas that aren't null, to 3 places, and whether it meets the target (judged before rounding; null if there is none)."""
    return criteria.agg(F.avg("mean_kappa").alias("m")).select(F.round("m", 3).alias("mean_kappa"), (F.col("m") >= target).alias("passed"))


def rates(accepted: DataFrame, criteria: tuple[str, ...] = ("c1", "c2", "c3")) -> DataFrame:
    """acceptance() with the percentage that passed each criterion and that was rejected."""
    share = lambda c: 100 * F.col(c) / F.greatest(F.lit(1), F.col("n"))
    return accepted.withColumns({f"{c}_pct": share(f"{c}_pass") for c in criteria} | {"rejected_pct": share("n_rejected")})
