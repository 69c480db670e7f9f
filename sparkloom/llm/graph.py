"""Connected components by alternating stars, with tables in the shared folder between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Most centres, each with more than this share of all links' ends, and the parts that the links of one are dealt into.
CENTRES, SALTS = 256, 64


def _stamp(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h")).first()
    return r["n"], r["h"]


def _large_star(edges: DataFrame, links: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("degree"))
    # A node with more than its share of the links is a centre; there are CENTRES at most, and the links of each are dealt into SALTS parts
    centres = [r["u"] for r in low.where(F.col("degree") * CENTRES > 2 * links).select("u").collect()] if links > SALTS else []
    hot = F.col("u").isin(centres) if centres else F.lit(False)
    salted = both.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(0))
    spread = low.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).withColumn("salt", F.col("salt").cast("bigint"))
    return salted.where("v > u").join(spread, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (u, v): the component is its smallest node.

    Loops and nulls are dropped. A round replaces each node's edges by a star
    around the smallest node near it; it ends when nothing changes. Stars are
    found by grouped minima (summed before the shuffle) and joins in which the
    links of a large star are dealt into parts, so no task needs a whole component.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    was = _stamp(now)
    while was[0]:
        now = written(_small_star(_large_star(now, was[0])), "edges")
        stamp = _stamp(now)
        if stamp == was:
            break
        was = stamp
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
