"""Resumable increments: what is left to do, upserts, batches, status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .dedup import last_wins


def remaining(todo: DataFrame, done: DataFrame, key_todo: Column, key_done: Column, done_if: Column | None = None) -> DataFrame:
    """Rows of todo whose key no finished row has; empty keys are left out. One definition of the key on both sides makes a second run find nothing."""
    finished = (done.where(done_if) if done_if is not None else done).select(key_done.alias("__key")).distinct()
    return todo.withColumn("__key", key_todo).where("__key <> ''").join(finished, "__key", "left_anti").drop("__key")


def carry_forward(new: DataFrame, old: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """new, with what old already has in `cols` where new has nothing."""
    held = old.select(key, *(F.col(c).alias(f"__{c}") for c in cols))
    out = new.join(held, key, "left")
    return out.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}")) for c in cols}).drop(*(f"__{c}" for c in cols))


def upsert(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """base and changes with one row for each key, changes over base, later over earlier."""
    both = base.withColumn("__late", F.lit(0)).unionByName(changes.withColumn("__late", F.lit(1)), allowMissingColumns=True)
    return last_wins(both, F.col(key), ["__late", order]).drop("__late")


def backlog(inputs: DataFrame, outputs: DataFrame, by: str) -> DataFrame:
    """n_in, n_out and pending for each group, most pending first."""
    n = inputs.groupBy(by).agg(F.count("*").alias("n_in")).join(outputs.groupBy(by).agg(F.count("*").alias("n_out")), by, "left").fillna(0, ["n_out"])
    return n.withColumn("pending", F.col("n_in") - F.col("n_out")).orderBy(F.desc("pending"), by)


def deficit(have: DataFrame, targets: DataFrame, by: str, default: int = 1500, batch: int = 10, most: int = 200) -> DataFrame:
    """Groups below their target: n, target, need and batches to run, those with least first. targets is a plan: a few rows, joined as Spark sees fit."""
    n = have.groupBy(by).agg(F.count("*").alias("n")).join(targets, by, "left").withColumn("target", F.coalesce("target", F.lit(default)))
    out = n.where("n < target").withColumn("need", F.col("target") - F.col("n"))
    return out.withColumn("batches", F.least(F.lit(most), F.ceil(F.col("need") / batch)).cast("long")).orderBy("n", by)


def batches(df: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """df with batch, the index of fixed-size batches within each group."""
    return df.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(by).orderBy(order)) - 1) / size).cast("long"))


def head(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group; all of them for 0."""
    if n == 0:
        return df
    return df.withColumn("__n", F.row_number().over(W.partitionBy(by).orderBy(order))).where(F.col("__n") <= n).drop("__n")


def skip(df: DataFrame, by: str, order: str, done: DataFrame) -> DataFrame:
    """Rows after the first n_done of each group (done: by, n_done)."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(by).orderBy(order))).join(done, by, "left").where(F.col("__n") > F.coalesce("n_done", F.lit(0))).drop("__n", "n_done")


def split_done(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    full = F.coalesce(F.col(col), F.lit("")) != ""
    return df.where(full), df.where(~full)


def pair_key(pair_id: str = "pair_id", question: str = "question_en", n: int = 200) -> Column:
    """The id as text, or without one (null, empty or 0) the question's first n characters."""
    own = F.col(pair_id).cast("string")
    return F.when(~F.coalesce(own, F.lit("")).isin("", "0"), own).otherwise(F.substring(F.coalesce(F.col(question), F.lit("")), 1, n))


def allowed(df: DataFrame, col: str, values: Sequence[str] | None = None, limit: int | None = None, order: str | None = None) -> DataFrame:
    """Rows whose value is on the allow-list (None: all), and the first `limit` of them in order."""
    out = df if values is None else df.where(F.col(col).isin(list(values)))
    return out if not limit else out.orderBy(order or col).limit(limit)


def answered(requests: DataFrame, batch: str, position: str, items: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Requests with the items of their batch's response (batch, items: array of structs with `id` and cols).

    An item without an id counts by its position; of several with one id the last
    counts. Missing fields give '', or for the columns `keep` what the request has.
    """
    each = items.select(batch, F.posexplode("items").alias("__at", "__item")).where("__item is not null")
    each = each.select(batch, F.coalesce(F.col("__item.id").cast("long"), F.col("__at").cast("long")).alias(position), "__at", *(F.col(f"__item.{c}").alias(f"__{c}") for c in cols))
    last = each.groupBy(batch, position).agg(*(F.max_by(f"__{c}", "__at").alias(f"__{c}") for c in cols))
    out = requests.withColumn(position, F.col(position).cast("long")).join(last, [batch, position], "left")
    own = lambda c: F.coalesce(F.col(c), F.lit("")) if c in keep else F.lit("")
    return out.withColumns({c: F.coalesce(f"__{c}", own(c)) for c in cols}).drop(*(f"__{c}" for c in cols))


def match_by_id(requests: DataFrame, responses: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Requests with the response of the same batch and id; '' where there is none."""
    return requests.join(responses, list(keys), "left").fillna("", list(cols))


def zip_block(block: Column, response: Column, name: str = "item") -> Column:
    """A block with its response by position, or null if the response is shorter; what goes beyond the block is cut."""
    return F.when(F.size(response) >= F.size(block), F.arrays_zip(block, F.slice(response, 1, F.greatest(F.size(block), F.lit(0))))).alias(name)
