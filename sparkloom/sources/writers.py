"""Sinks of corpora."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def json_by_key(df: DataFrame, path: str, key: str = "specialty_id") -> None:
    """JSON lines in a folder for each key."""
    df.write.mode("overwrite").partitionBy(key).json(path)


def json_arrays(df: DataFrame, path: str, key: str = "specialty_id", order: str | None = None) -> None:
    """One file with one JSON array in a folder for each key, non-ASCII characters as they are. Rows are sorted by `order` and written line by line, so that no array is held."""
    row = F.to_json(F.struct(*(c for c in df.columns if c != key)), {"ignoreNullFields": "false"})
    at = W.partitionBy(key).orderBy(order or F.lit(0))
    lines = df.withColumns({"__n": F.row_number().over(at), "__next": F.lead(F.lit(1)).over(at), "__row": row})
    value = F.concat(F.when(F.col("__n") == 1, "[").otherwise(""), "__row", F.when(F.col("__next").isNull(), "]").otherwise(","))
    lines.select(key, "__n", value.alias("value")).sortWithinPartitions(key, "__n").select(key, "value").write.mode("overwrite").partitionBy(key).text(path)


def splits(df: DataFrame, path: str, col: str = "split") -> None:
    """Parquet in a folder for each split."""
    df.write.mode("overwrite").partitionBy(col).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def packet(df: DataFrame, path: str, cols: Sequence[str], blank: Sequence[str] = ("C1_plausibility", "C2_coherence", "C3_safety", "C4_language", "comment")) -> None:
    """A CSV packet for raters: a byte-order mark, the columns, and blank columns to fill in. Packets are small, so one file."""
    out = df.select(*cols, *(F.lit("").alias(c) for c in blank))
    first = out.columns[0]
    out.withColumnRenamed(first, "﻿" + first).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def report(df: DataFrame, path: str) -> None:
    """Each row as one JSON text."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def markdown(df: DataFrame, path: str, title: str) -> None:
    """A Markdown table of a small, ordered report."""
    cols = df.columns
    head = df.sparkSession.createDataFrame([(0, f"# {title}"), (1, ""), (2, "| " + " | ".join(cols) + " |"), (3, "|" + "---|" * len(cols))], "n int, value string")
    body = df.select(F.lit(4).alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)), F.lit(" |")).alias("value"))
    head.union(body).orderBy("n", "value").select("value").coalesce(1).write.mode("overwrite").text(path)


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Only the partitions that df holds are replaced, each by an atomic commit."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
