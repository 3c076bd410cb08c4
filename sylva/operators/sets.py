"""Unions of durable and temporary rows, presence tests, and the checks on rows that arrive from elsewhere.

Null keys match nothing, except where rows are grouped by them. Empty tables leave what the other side has. Columns that are added (temp, available, total) replace those of
their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def durable_and_temp(durable: DataFrame, temp: DataFrame) -> DataFrame:
    """All rows of both with `temp`; a row that both have stays twice (SET-01)."""
    return durable.withColumn("temp", F.lit(False)).unionByName(temp.withColumn("temp", F.lit(True)))


def preferred(durable: DataFrame, temp: DataFrame, key: str) -> DataFrame:
    """One row a key: the durable one, else the temporary one (SRC-08). Both have the same columns, key unique in each.

    A grouped maximum, so it combines before the shuffle and no window sorts whole rows.
    """
    both, fields = durable_and_temp(durable, temp), [c for c in durable.columns if c != key]
    best = both.groupBy(key).agg(F.min(F.struct("temp", *fields)).alias("_x"))
    return best.select(key, *[F.col("_x")[c].alias(c) for c in [*fields, "temp"]])


def distinct_union(*parts: DataFrame) -> DataFrame:
    """The set of all rows (SET-03, SET-04)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def available(files: DataFrame, quarantined: DataFrame, pending: DataFrame, key: str) -> DataFrame:
    """files with `available`: neither quarantined nor pending (FLT-12, SET-02). Each key of the flags is joined once."""
    flagged = distinct_union(quarantined.select(key), pending.select(key)).withColumn("_flagged", F.lit(True))
    return files.join(flagged, key, "left").withColumn("available", F.col("_flagged").isNull()).drop("_flagged")


def with_store_rows(locations: DataFrame, stored: DataFrame, scheme: str) -> DataFrame:
    """locations(file_id, uri) and one made-up address for each file that the store holds (SET-06, RD-02)."""
    made = stored.select("file_id", F.concat(F.lit(scheme), F.col("file_id").cast("string")).alias("uri"))
    return locations.select("file_id", "uri").unionByName(made)


def verified_append(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """What to do with each incoming row of log_id, seq, hash: skip, append or broken (ST-03, ST-08).

    Rows that are known must be the same ones; new rows must follow each other from the log's tip. A row after a gap or
    after a differing one in its log is broken too. Known rows that did not arrive play no part.
    """
    have = known.select("log_id", "seq", F.col("hash").alias("_hash"))
    tips = known.groupBy("log_id").agg(F.max("seq").alias("_tip"))
    rows = incoming.join(have, ["log_id", "seq"], "left").join(tips, "log_id", "left").withColumn("_tip", F.coalesce("_tip", F.lit(0)))
    order = Window.partitionBy("log_id").orderBy("seq")
    new = F.col("seq") > F.col("_tip")
    no = F.sum(F.when(new, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    bad = F.when(new, F.col("seq") != F.col("_tip") + no).otherwise(~F.col("hash").eqNullSafe(F.col("_hash")))
    spoiled = F.max(bad).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("log_id", "seq", F.when(spoiled, "broken").when(new, "append").otherwise("skip").alias("action"))


def page_with_total(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of rows, each with `total`, the number of all rows (AGG-19): one count beside one ordered slice."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(500, max(1, limit))).join(F.broadcast(total))  # one row
