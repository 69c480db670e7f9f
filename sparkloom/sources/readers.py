"""Sources of corpora."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dimensions as D

PAIR = "question STRING, answer STRING, language STRING, source STRING"
_STEM = r"([^/]+?)(?:\.[^./]+)?$"


def _stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), _STEM, 1)


_ORDER = ("__time", "__file", "__block", "__place")


def _order() -> dict[str, Column]:
    """When a row was written: its file's time and name, its block's offset, its place in the block. Not how files are packed into tasks."""
    at = [F.col(f"_metadata.{c}") for c in ("file_modification_time", "file_name", "file_block_start")]
    return dict(zip(_ORDER, [*at, F.monotonically_increasing_id()], strict=True))


def json_arrays(spark: SparkSession, path: str, schema: str = PAIR, key: str = "specialty_id") -> DataFrame:
    """One JSON array for each file; the key is the file's stem. Files that can't be read give no rows; `_*` files are hidden."""
    df = spark.read.schema(schema + ", _bad STRING").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").option("allowSingleQuotes", False).json(path)
    return df.withColumn(key, _stem()).where("_bad is null").drop("_bad")


def wrapped_arrays(spark: SparkSession, path: str, schema: str = PAIR, field: str = "pairs", key: str = "specialty_id") -> DataFrame:
    """Arrays that are bare or lie in a field of an object."""
    raw = spark.read.text(path, wholetext=True).withColumn(key, _stem())
    item = "array<struct<" + ", ".join(": ".join(c.split()) for c in schema.split(",")) + ">>"
    wrapped = F.ltrim("value").startswith("{")  # an object would pass for an array of one
    rows = F.when(wrapped, F.from_json("value", f"{field} {item}")[field]).otherwise(F.from_json("value", item))
    return raw.select(key, F.inline(rows))


def pages(spark: SparkSession, path: str, glob: str = "pages_*.txt") -> DataFrame:
    """file_name and value, one row for each text file, by name. Bytes that are no UTF-8 are left out (and so is U+FFFD, which they are read as)."""
    df = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return df.select(F.col("_metadata.file_name").alias("file_name"), F.replace("value", F.lit("\ufffd"), F.lit("")).alias("value")).orderBy("file_name")


def annotations(spark: SparkSession, path: str, criteria: tuple[str, ...] = ("C1", "C2", "C3", "C4"), rater: str | None = None) -> DataFrame:
    """rater, pair_id, criterion columns (0, 1 or null, found by prefix) and comment; blank ids are dropped and the last row of an id in a file wins."""
    df = spark.read.option("header", True).csv(path)
    df = df.withColumns({"rater": F.lit(rater) if rater else _stem(), **_order()})
    cols = []
    for c in criteria:
        name = next((x for x in df.columns if x.startswith(c)), None)
        v = F.trim(F.col(name)) if name else F.lit(None)
        cols.append(F.when(v.isin("0", "1"), v.cast("int")).alias(c.lower()))
    keep = [c for c in ("comment", "specialty", "source") if c in df.columns]
    df = df.where(F.trim(F.coalesce("pair_id", F.lit(""))) != "").select("rater", "pair_id", *cols, *keep, *_ORDER)
    from ..operators.dedup import last_wins

    return last_wins(df, F.concat_ws("\0", "rater", "pair_id"), list(_ORDER)).drop(*_ORDER)


def checkpoint(spark: SparkSession, path: str, schema: str, key: str = "_pair_key") -> DataFrame:
    """A log of JSON lines; broken lines are dropped and the last of each key wins."""
    from ..operators.dedup import last_wins

    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).withColumns(_order())
    return last_wins(df, F.col(key), list(_ORDER)).drop(*_ORDER)


def first_available(spark: SparkSession, parquet: str, json: str) -> DataFrame:
    """The published table, or the local copy if that can't be found."""
    try:
        return spark.read.parquet(parquet)
    except AnalysisException:
        return spark.read.json(json)


def previous(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An earlier output, or no rows if there is none yet."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def real_only(df: DataFrame, cols: tuple[str, ...], source: str = "scraped_icliniq") -> DataFrame:
    """Rows of one source whose text fields are no JSON objects."""
    plain = F.lit(True)
    for c in cols:
        plain = plain & ~F.startswith(F.ltrim(F.coalesce(F.col(c), F.lit(""))), F.lit("{"))
    return df.where((F.col("source") == source) & plain)


def plan(spark: SparkSession, path: str) -> DataFrame:
    """specialty, target; no rows if the file is missing or broken."""
    try:
        return spark.read.schema("specialty STRING, target INT").option("multiLine", True).json(path).where("specialty is not null and target is not null")
    except AnalysisException:
        return spark.createDataFrame([], "specialty STRING, target INT")


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a node-link file."""
    g = spark.read.schema("nodes ARRAY<STRUCT<id: STRING, label: STRING, type: STRING>>, edges ARRAY<STRUCT<source: STRING, target: STRING, key: STRING, relation: STRING>>").option("multiLine", True).json(path)
    return g.select(F.inline("nodes")), g.select(F.inline("edges"))


def specialties(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """specialty_id and its English, French and Arabic labels."""
    return dimension(spark, rows or D.specialties(), "specialty_id STRING, label_en STRING, label_fr STRING, label_ar STRING")


def profiles(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """profile and the specialties that it judges."""
    return dimension(spark, rows or D.profiles(), "profile STRING, specs ARRAY<STRING>")


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table given in line, such as specialties or profiles."""
    return spark.createDataFrame(rows, schema)


def prompts(paths: dict[str, str]) -> dict[str, str]:
    """Templates by name, read on the driver."""
    out = {}
    for name, path in paths.items():
        with open(path, encoding="utf-8") as f:
            out[name] = f.read()
    return out
