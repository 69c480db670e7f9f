"""A drug knowledge graph from monograph texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T

# Headers that name no drug
NO_DRUGS = ["INDEX", "SOMMAIRE", "TABLE", "ANNEXE", "PRÉFACE", "AVERTISSEMENT"]
HEADER = r"(?md)^([A-ZÀ-Ý][A-ZÀ-Ý\- ]{3,40})(?U:\s*)$"


def segments(pages: DataFrame, doc: str = "file_name", text: str = "value", header: str = HEADER, skip: list[str] = NO_DRUGS) -> DataFrame:
    """doc, drug, ord, block: from each header to the next, or the end. Headers on the skip list neither open nor end a block.

    A header becomes a mark that no text holds, so that one split gives the
    blocks in order; skipped ones are turned back into text first.
    """
    mark = "\ue000"
    marked = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), header, mark + "$0")
    for s in skip:
        marked = F.regexp_replace(marked, rf"(?md){mark}(?={s}\s*$)", "")
    parts = F.slice(F.split(marked, mark), 2, 1 << 30)
    out = pages.select(doc, F.posexplode(parts).alias("ord", "block"))
    return out.select(doc, F.trim(F.regexp_extract("block", header, 1)).alias("drug"), "ord", "block")


def segments_by_position(headers: DataFrame, doc: str, start: str, length: str) -> DataFrame:
    """headers with stop: where the next header of the document starts, else the document's length."""
    return headers.withColumn("stop", F.lead(start).over(W.partitionBy(doc).orderBy(start))).withColumn("stop", F.coalesce("stop", length))


def _facts(block: Column, lexicons: dict[str, list[str]]) -> list[tuple[str, str, Column]]:
    has = lambda terms: T.contains_any(block, terms)
    none = F.array().cast("array<string>")
    indicated, warned = has(lexicons["indication"]), has(lexicons["contraindication"])
    diseases = T.terms_in(block, lexicons["diseases"])
    return [
        ("has_dosage", "dosage", F.array_distinct(T.dosages(block))),
        ("has_route", "route", T.terms_in(block, lexicons["routes"])),
        ("indication", "symptom", F.when(indicated, T.terms_in(block, lexicons["symptoms"])).otherwise(none)),
        ("treats", "disease", F.when(indicated, diseases).otherwise(none)),
        ("contraindication", "disease", F.when(warned, diseases).otherwise(none)),
    ]


DEFAULT = {
    "indication": L.INDICATION_PHRASES, "contraindication": L.CONTRAINDICATION_PHRASES, "diseases": L.MONOGRAPH_DISEASES,
    "symptoms": L.MONOGRAPH_SYMPTOMS, "routes": L.ROUTES,
}


def emissions(blocks: DataFrame, drug: str = "drug", block: str = "block", lexicons: dict[str, list[str]] = DEFAULT) -> DataFrame:
    """source, target, relation, type of each fact found in a block; the same fact in two blocks comes twice."""

    def named(relation: str, kind: str, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(relation).alias("relation"), F.lit(kind).alias("type"), x.alias("label")))

    lists = [named(*fact) for fact in _facts(F.col(block), lexicons)]
    out = blocks.select(F.concat(F.lit("drug:"), F.col(drug)).alias("source"), F.explode(F.concat(*lists)).alias("f"))
    return out.select("source", F.concat_ws(":", "f.type", "f.label").alias("target"), "f.relation", "f.type", "f.label")


def edges(found: DataFrame) -> DataFrame:
    return found.select("source", "target", F.col("relation").alias("key"), "relation").dropDuplicates(["source", "target", "key"])


def nodes(blocks: DataFrame, found: DataFrame, drug: str = "drug") -> DataFrame:
    drugs = blocks.select(F.concat(F.lit("drug:"), F.col(drug)).alias("id"), F.col(drug).alias("label"), F.lit("drug").alias("type"))
    return drugs.unionByName(found.select(F.col("target").alias("id"), "label", "type")).dropDuplicates(["id"])


def edge_counts(found: DataFrame) -> DataFrame:
    """Emissions and distinct edges of each relation."""
    return found.groupBy("relation").agg(F.count("*").alias("emitted"), F.countDistinct("source", "target").alias("distinct_edges"))


def drug_vocabulary(node_table: DataFrame, least: int = 4) -> DataFrame:
    return node_table.where((F.col("type") == "drug") & (F.length("label") >= least)).select(F.lower("label").alias("drug")).distinct()


def endpoint(kind: Column | str, label: Column | str) -> Column:
    """The string id of a node."""
    return F.concat_ws(":", kind, label)


def node_link_file(node_table: DataFrame, edge_table: DataFrame, path: str) -> None:
    """One node-link JSON document, streamed line by line into one file; a graph needn't fit one row."""
    part = lambda df, n, kind: df.select(F.lit(n).alias("n"), F.to_json(F.struct(*kind)).alias("value"))
    _lines(node_table.sparkSession, [
        ('{"nodes": [', part(node_table, 0, ("id", "label", "type"))), ('], "edges": [', part(edge_table, 1, ("source", "target", "key", "relation"))), ("]}", None),
    ], path, ",")


def graphml_file(node_table: DataFrame, edge_table: DataFrame, path: str) -> None:
    """One GraphML document, streamed line by line into one file."""
    head = '<?xml version="1.0" encoding="utf-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="label" for="node" attr.name="label" attr.type="string"/><key id="type" for="node" attr.name="type" attr.type="string"/><key id="relation" for="edge" attr.name="relation" attr.type="string"/><graph edgedefault="directed">'
    _lines(node_table.sparkSession, [(head, graphml(node_table, edge_table).select(F.col("part").alias("n"), "value")), ("</graph></graphml>", None)], path, "")


def _lines(spark: SparkSession, parts: list[tuple[str, DataFrame | None]], path: str, comma: str) -> None:
    out = None
    for k, (head, rows) in enumerate(parts):
        line = spark.createDataFrame([(2 * k, 0, head, True)], "k int, n int, value string, bare boolean")
        both = line if rows is None else line.union(rows.select(F.lit(2 * k + 1), "n", "value", F.lit(False)))
        out = both if out is None else out.union(both)
    nearest = F.lead("bare").over(W.orderBy("k", "n", "value"))
    value = F.when(F.col("bare") | nearest, F.col("value")).otherwise(F.concat("value", F.lit(comma)))
    out.select("k", "n", "value", value.alias("line")).coalesce(1).sortWithinPartitions("k", "n", "value").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def node_link_json(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """JSON lines, one for each node or edge, in the fields of a node-link file; a graph needn't fit one row."""
    n = node_table.select(F.lit("nodes").alias("part"), F.to_json(F.struct("id", "label", "type")).alias("value"))
    return n.unionByName(edge_table.select(F.lit("edges").alias("part"), F.to_json(F.struct("source", "target", "key", "relation")).alias("value")))


def graphml(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """The body lines of a GraphML file (nodes, then edges, by `part`)."""

    def esc(c: str) -> Column:
        out = F.col(c)
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    n = node_table.select(F.lit(1).alias("part"), F.format_string('<node id="%s"><data key="label">%s</data><data key="type">%s</data></node>', esc("id"), esc("label"), esc("type")).alias("value"))
    return n.unionByName(edge_table.select(F.lit(2).alias("part"), F.format_string('<edge source="%s" target="%s" id="%s"><data key="relation">%s</data></edge>', esc("source"), esc("target"), esc("key"), esc("relation")).alias("value")))
