"""Samples and splits that depend on keys and a seed only: draws are ordered by md5(seed || id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def draw(seed: int, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))


def half_real(df: DataFrame, by: str, real: Column, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group, half of them real: half of n or all real ones, the rest made ones, refilled with real ones if those run short."""
    x = df.withColumn("__real", real)
    size = lambda flag: F.sum((F.col("__real") == flag).cast("int")).over(W.partitionBy(by))
    r, s = size(True), size(False)
    n_real = F.least(F.lit(n // 2), r)
    n_made = F.least(F.lit(n) - n_real, s)
    n_real = F.when(F.lit(n) - n_real > s, F.least(F.lit(n) - n_made, r)).otherwise(n_real)
    rank = F.row_number().over(W.partitionBy(by, "__real").orderBy(draw(seed, id_col), id_col))
    return x.withColumns({"__rank": rank, "__take": F.when(F.col("__real"), n_real).otherwise(n_made)}).where("__rank <= __take").drop("__rank", "__take", "__real")


def choose(weights: dict[str, float], seed: int, id_col: str) -> Column:
    """A key drawn by weight from a hash of the id."""
    u = F.conv(F.substring(draw(seed, id_col), 1, 8), 16, 10).cast("double") / float(1 << 32)
    total, upto, out = sum(weights.values()), 0.0, None
    items = list(weights.items())
    for k, w in items[:-1]:
        upto += w / total
        out = F.when(u < upto, k) if out is None else out.when(u < upto, k)
    return F.lit(items[-1][0]) if out is None else out.otherwise(items[-1][0])


def strata(df: DataFrame, cap_by: str, stratum: list[str], id_col: str, cap: int, target: int, seed: int = 42) -> DataFrame:
    """A joint stratified sample: at most `cap` rows of each group, of each stratum its share of the target (one at least), and at most the target in all."""
    mine = draw(seed, id_col)
    capped = df.withColumn("__c", F.row_number().over(W.partitionBy(cap_by).orderBy(mine, id_col))).where(F.col("__c") <= cap).drop("__c")
    total = capped.count()
    if total <= target:
        return capped
    take = F.greatest(F.lit(1), F.rint(F.count("*").over(W.partitionBy(*stratum)) * (target / total)))
    rank = F.row_number().over(W.partitionBy(*stratum).orderBy(mine, id_col))
    picked = capped.withColumns({"__take": take, "__rank": rank}).where("__rank <= __take").drop("__take", "__rank")
    return picked.orderBy(draw(seed + 1, id_col), id_col).limit(target)  # the limit is the feature


def ranked(df: DataFrame, seed: int, id_col: str, name: str = "rank") -> DataFrame:
    """df with each row's place (from 1) in the order of draws, without moving all rows to one task.

    The draw's first three digits deal rows into 4096 even ranges; the ranges'
    counts, one number each, shift the places within them.
    """
    # a null id has no draw and comes last: '~' is beyond all digits
    x = df.withColumn("__draw", F.coalesce(draw(seed, id_col), F.lit("~"))).withColumn("__range", F.substring("__draw", 1, 3))
    before = x.groupBy("__range").agg(F.count("*").alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(W.partitionBy("__range").orderBy("__draw", id_col)) + F.col("__before")
    return x.join(F.broadcast(before), "__range").withColumn(name, place.cast("long")).drop("__range", "__before", "__draw")


def three_way(df: DataFrame, id_col: str, n: int, seed: int = 42, fixed: bool = True) -> DataFrame:
    """df with split: fixed sizes of 2,500 for test and validation and 15,000 for train from 20,000 rows on, else a tenth each and the rest.

    n is the number of rows. Rows beyond the fixed sizes are dropped. Unless fixed, all tables are split by tenths and no row is dropped.
    """
    ranks = ranked(df, seed, id_col)
    if fixed and n >= 20_000:
        return ranks.withColumn("split", F.when(F.col("rank") <= 15_000, "train").when(F.col("rank") <= 17_500, "validation").otherwise("test")).where("rank <= 20000").drop("rank")
    k = max(1, n // 10)
    return ranks.withColumn("split", F.when(F.col("rank") <= k, "test").when(F.col("rank") <= 2 * k, "validation").otherwise("train")).drop("rank")


def hold_out_size(n: int) -> int:
    return min(1000, max(50, n // 50))


def hold_out(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """df with held_out for hold_out_size(n) rows."""
    return ranked(df, seed, id_col).withColumn("held_out", F.col("rank") <= hold_out_size(n)).drop("rank")
