"""JSON feeds: lines read with their errors told apart, and rows written as canonical bundles with their hashes.

A null line is a bad one. Repeated lines and rows are kept each. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed_lines(lines: DataFrame, text: str, schema: str) -> DataFrame:
    """lines with `row` (the fields of schema) and `good`; a malformed line is kept with a null row (SRC-17).

    The lines are one column, so a file is read by spark.read.text and a bad line costs no other.
    """
    row = F.from_json(text, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = lines.withColumn("_row", row).withColumn("good", F.col("_row").isNotNull() & F.col("_row._corrupt").isNull())
    return out.withColumn("row", F.when(F.col("good"), F.col("_row").dropFields("_corrupt"))).drop("_row")


def import_counts(parsed: DataFrame, by: str) -> DataFrame:
    """by, imported, skipped."""
    return parsed.groupBy(by).agg(F.count(F.when(F.col("good"), 1)).alias("imported"), F.count(F.when(~F.col("good"), 1)).alias("skipped"))


def canonical_json(*names: str) -> Column:
    """The named columns as one JSON object, its keys in order (FN-22, SNK-09); nulls are left out."""
    return F.to_json(F.struct(*sorted(names)))


def bundles(rows: DataFrame, key: str, *names: str) -> DataFrame:
    """key, bundle, sha256: a canonical JSON line for each row and its hash (SNK-06)."""
    out = rows.select(key, canonical_json(*names).alias("bundle"))
    return out.withColumn("sha256", F.sha2("bundle", 256))


def since(rows: DataFrame, position: str, after: int, superseded: Column) -> DataFrame:
    """Rows beyond a position that nothing supersedes, for an incremental export (SNK-07)."""
    return rows.filter((F.col(position) > after) & ~superseded)


def scored_nodes(documents: DataFrame, text: str) -> DataFrame:
    """One row a node of a forest document: tree, triplet_id, truth_score, words (SRC-18)."""
    kind = "trees array<struct<nodes: array<struct<triplet_id: string, truth_score: double, words: array<string>>>>>"
    trees = documents.select("*", F.posexplode(F.from_json(text, kind)["trees"]).alias("tree", "_t")).drop(text)
    return trees.select("*", F.explode("_t.nodes").alias("_n")).select(*[c for c in trees.columns if c != "_t"], "_n.triplet_id", "_n.truth_score", "_n.words")
