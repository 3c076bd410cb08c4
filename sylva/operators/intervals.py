"""Half-open interval sets: coalescing, chunk coverage, progress, resumption.

Ranges with a null end are dropped, and repeated or empty ones change nothing. Null keys form a group of their own. Empty tables give no rows. Other columns are ignored.
One key's ranges are merged in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(ranges: DataFrame, key: str) -> DataFrame:
    """key, start, end: ranges(key, start, end) merged; touching ranges merge too, empty ones vanish (ST-12, T-20)."""
    w = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    out = ranges.filter(F.col("start") < F.col("end")).withColumn("_fresh", fresh)
    out = out.withColumn("_no", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy(key, "_no").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_no")


def covered_chunks(merged: DataFrame, key: str, size: int) -> DataFrame:
    """key, chunk: chunks of `size` that lie whole in one merged range (ST-13), generated from the ranges without a join."""
    first, last = F.ceil(F.col("start") / size).cast("long"), F.floor(F.col("end") / size).cast("long") - 1
    return merged.filter(first <= last).select(key, F.explode(F.sequence(first, last)).alias("chunk"))


def progress(merged: DataFrame, key: str, size: int) -> DataFrame:
    """key, n_ranges, verified, chunks_done (AGG-08, AGG-09)."""
    done = F.greatest(F.lit(0), F.floor(F.col("end") / size) - F.ceil(F.col("start") / size)).cast("long")
    return merged.groupBy(key).agg(F.count("*").alias("n_ranges"), F.sum(F.col("end") - F.col("start")).alias("verified"), F.sum(done).alias("chunks_done"))


def session_progress(files: DataFrame, merged: DataFrame, size: int) -> DataFrame:
    """session, file_id, verified, chunks_done, chunks_total, state of files(session, file_id, length, committed) (AGG-09, RD-13).

    merged(file_id, start, end) are verified ranges within the file. The last chunk may be short; it is done if it lies whole in a range. state is committed, complete, running or waiting.
    """
    at = files.select("session", "file_id", "length", "committed").join(merged.select("file_id", "start", "end"), "file_id", "left")
    whole = F.when(F.col("end") >= F.col("length"), F.ceil(F.col("length") / size)).otherwise(F.floor(F.col("end") / size))
    done = F.greatest(F.lit(0), whole - F.ceil(F.col("start") / size))
    out = at.groupBy("session", "file_id", "length", "committed").agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("verified"), F.coalesce(F.sum(done), F.lit(0)).cast("long").alias("chunks_done"))
    total = F.ceil(F.col("length") / size).cast("long")
    state = F.when(F.col("committed"), "committed").when(F.col("verified") >= F.col("length"), "complete").when(F.col("verified") > 0, "running").otherwise("waiting")
    return out.select("session", "file_id", "verified", "chunks_done", total.alias("chunks_total"), state.alias("state"))


def to_fetch(manifest: DataFrame, held: DataFrame) -> DataFrame:
    """file_id, chunk, again: chunks of manifest(file_id, chunk, hash) that held(file_id, chunk, hash) lacks or has with another hash, again then being true (ST-18)."""
    have = held.groupBy("file_id", "chunk").agg(F.collect_set("hash").alias("_have"))
    out = manifest.join(have, ["file_id", "chunk"], "left").filter(F.col("_have").isNull() | ~F.coalesce(F.array_contains("_have", F.col("hash")), F.lit(False)))
    return out.select("file_id", "chunk", F.col("_have").isNotNull().alias("again"))
