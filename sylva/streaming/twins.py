"""Folds of a growing log by Structured Streaming; each must leave what its batch twin leaves.

The log is a folder of Parquet files. Every micro-batch writes the rows that it changed into a folder of its own number under `base`, where the stream's checkpoint lies too, so a
batch that is run again is idempotent, and a stream that is started again with the same base goes on where it stopped. State is kept by key; what the stream leaves is the last
batch's row of each key. All available input is read, then the query stops; the same queries run without end under a processing-time trigger.
Null keys form a group of their own; rows that come twice change nothing but counts; an empty log gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import sets
from ..plans.forest import KINDS
from ..sources.tables import shared_dir


def tail(spark: SparkSession, d: str, files_a_batch: int | None = None) -> DataFrame:
    """The events table as a stream of log rows: seq, ts, kind, entity, value."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    # The source lists a folder, so it watches the table's parent for files or folders of its name.
    rows = reader.parquet(f"{d}/events.parque[t]")
    return rows.select(F.col("event_id").alias("seq"), "ts", kinds[F.col("event_type")].alias("kind"), F.col("user_id").alias("entity"), "value", F.get_json_object("props", "$.k").cast("int").alias("field"))


def new_base(spark: SparkSession) -> str:
    """A folder for a stream's checkpoint and rows, to be given to `settled` each time the stream is started."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _stored(spark: SparkSession, base: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema.add("batch", "long") if "batch" not in schema.names else schema).parquet(f"{base}/rows")
    except AnalysisException:  # no batch yet
        return spark.createDataFrame([], schema.add("batch", "long") if "batch" not in schema.names else schema)


def settled(stream: DataFrame, keys: list[str] | None = None, base: str | None = None, into: Callable[[DataFrame, DataFrame], DataFrame] | None = None, out_schema=None) -> DataFrame:
    """Runs a stream over all input that is there and gives the table that it leaves: the last row of each key, or all rows without keys.

    into(batch, stored) makes a batch's rows from what it brings and what earlier batches left, where that needs more than state; out_schema is then that of its result.
    """
    spark = stream.sparkSession
    base = base or new_base(spark)
    schema = out_schema or stream.schema
    fields = list(schema.names)

    def keep(batch: DataFrame, number: int) -> None:
        rows = batch
        if into is not None:
            rows = into(batch, _stored(spark, base, type(schema)(list(schema.fields))).filter(F.col("batch") < number).drop("batch"))
        rows.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    writer = stream.writeStream.outputMode("append" if keys is None else "update").foreachBatch(keep)
    writer.option("checkpointLocation", f"{base}/marks").trigger(availableNow=True).start().awaitTermination()
    rows = _stored(spark, base, type(schema)(list(schema.fields)))
    if keys is None:
        return rows.select(*fields)
    rest = [c for c in fields if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_x")).select(*keys, "_x.*")


def tail_counts(spark: SparkSession, d: str, base: str | None = None) -> DataFrame:
    """kind, n, tip (ST-01)."""
    return settled(tail(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.max("seq").alias("tip")), ["kind"], base)


def fold_last(spark: SparkSession, d: str, base: str | None = None, files_a_batch: int | None = None) -> DataFrame:
    """The last event of each entity (ST-06): the batch fold's aggregate, kept as state."""
    return settled(tail(spark, d, files_a_batch).groupBy("entity").agg(F.max(F.struct("seq", "kind", "value")).alias("x")).select("entity", "x.*"), ["entity"], base)


def fold_links(spark: SparkSession, d: str, base: str | None = None, files_a_batch: int | None = None) -> DataFrame:
    """entity, field, seq, value, active: what fold.reactivated gives for links made and revoked, kept as state in any order of arrival (ST-06)."""
    log = tail(spark, d, files_a_batch).filter("kind in ('LinkCreated', 'Revoked')")
    made, gone = F.max(F.when(F.col("kind") == "LinkCreated", F.struct("seq", "value"))), F.max(F.when(F.col("kind") == "Revoked", F.col("seq")))
    held = settled(log.groupBy("entity", "field").agg(made.alias("x"), gone.alias("gone")).select("entity", "field", "x.seq", "x.value", "gone"), ["entity", "field"], base)
    return held.filter("seq is not null").select("entity", "field", "seq", "value", (F.col("gone").isNull() | (F.col("gone") < F.col("seq"))).alias("active"))


def open_pairs(spark: SparkSession, d: str, base: str | None = None, files_a_batch: int | None = None) -> DataFrame:
    """entity, field, n_out, n_in, complete: halves that wait for each other, whichever comes first (ST-07): fold.pairs, kept as state."""
    log = tail(spark, d, files_a_batch).filter("kind in ('NodeCreated', 'LinkCreated')")
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    held = settled(log.groupBy("entity", "field").agg(n("NodeCreated").alias("n_out"), n("LinkCreated").alias("n_in")), ["entity", "field"], base)
    return held.withColumn("complete", (F.col("n_out") > 0) & (F.col("n_in") > 0))


def arrivals(incoming: DataFrame, base: str | None = None) -> DataFrame:
    """log_id, seq, hash, action of a stream incoming(log_id, seq, hash) of shipped log rows (ST-03): sets.verified_append against what earlier batches appended.

    A row that came in an earlier batch is skipped if it is the same; a log that breaks takes nothing more from that batch on.
    """

    def into(batch: DataFrame, stored: DataFrame) -> DataFrame:
        known = stored.filter("action = 'append'").select("log_id", "seq", "hash")
        broken = stored.filter("action = 'broken'").select("log_id").distinct().withColumn("_broken", F.lit(True))
        judged = sets.verified_append(known, batch).join(batch.select("log_id", "seq", "hash").distinct(), ["log_id", "seq"]).join(broken, "log_id", "left")
        return judged.select("log_id", "seq", "hash", F.when(F.col("_broken"), "broken").otherwise(F.col("action")).alias("action"))

    return settled(incoming, None, base, into, incoming.select("log_id", "seq", "hash", F.lit("").alias("action")).schema)


def debounced(events: DataFrame, key: str, ts: str, quiet: str) -> DataFrame:
    """key, opened, due, n: bursts of changes to watch(key), each of which asks for one scan when it has been quiet for so long (ST-09); for a stream or a table.

    A stream needs a watermark on ts, which decides how late a change may come.
    """
    return events.groupBy(key, F.session_window(ts, quiet).alias("_w")).agg(F.count("*").alias("n")).select(key, F.col("_w.start").alias("opened"), F.col("_w.end").alias("due"), "n")


def _union(ranges: list[tuple[int, int]]) -> list[list[int]]:
    merged: list[list[int]] = []
    for s, e in sorted(ranges):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return merged


def _merge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Merges new ranges into the key's stored ones; gives the whole set with the number of its version."""
    version, starts, ends = state.get if state.exists else (0, [], [])
    ranges = list(zip(map(int, starts), map(int, ends)))
    for b in batches:
        ranges += [(int(s), int(e)) for s, e in zip(b["start"], b["end"]) if s < e]
    merged = _union(ranges)
    state.update((version + 1, [m[0] for m in merged], [m[1] for m in merged]))
    yield pd.DataFrame({"user_id": key[0], "version": version + 1, "start": [m[0] for m in merged], "end": [m[1] for m in merged]})


def ranges_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("entity").alias("user_id"), "ts", F.col("seq").alias("start"), (F.col("seq") + 1 + F.floor(F.col("value") / 2)).alias("end"))


def islands(spark: SparkSession, d: str, base: str | None = None, files_a_batch: int | None = None) -> DataFrame:
    """Coalesced ranges of each user, with the merged set as keyed state (ST-12, ST-14). A key's ranges, merged, are one state."""
    merged = ranges_of(tail(spark, d, files_a_batch)).groupBy("user_id").applyInPandasWithState(_merge, "user_id long, version long, start long, end long", "version long, starts array<long>, ends array<long>", "update", GroupStateTimeout.NoTimeout)
    lists = settled(merged, ["user_id", "version", "start"], base)
    last = lists.groupBy("user_id").agg(F.max("version").alias("version"))
    return lists.join(last, ["user_id", "version"]).select("user_id", "start", "end")


def hot_ranges(rows: DataFrame, ttl: str, late: str, base: str | None = None) -> DataFrame:
    """user_id, start, end: ranges asked for no longer than ttl before the stream's watermark, merged by key (ST-15).

    rows(user_id, ts, start, end) is a stream; late is how late a row may come. A key holds its ranges with their times; those whose time has run out go when the key
    is next touched or when its timeout fires, and a key without any leaves the state.
    """
    seconds = int(pd.Timedelta(ttl).total_seconds())

    def touch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get[1:])) if state.exists else []
        version = (state.get[0] if state.exists else 0) + 1
        for b in batches:
            held += [(int(t), int(s), int(e)) for t, s, e in zip(b["at"], b["start"], b["end"]) if s < e]
        now = state.getCurrentWatermarkMs() // 1000
        held = sorted(h for h in held if h[0] + seconds > now)
        merged = _union([(s, e) for _, s, e in held])
        if held:
            state.update((version, *[[int(h[i]) for h in held] for i in range(3)]))
            state.setTimeoutTimestamp(max(now + 1, held[0][0] + seconds) * 1000)
        else:
            state.remove()
        # An empty set is told by one row without a range.
        yield pd.DataFrame({"user_id": key[0], "version": version, "start": [m[0] for m in merged] or [None], "end": [m[1] for m in merged] or [None]}).astype({"start": "Int64", "end": "Int64"})

    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select("user_id", "ts", F.unix_timestamp("ts").alias("at"), "start", "end")
    told = timed.groupBy("user_id").applyInPandasWithState(touch, "user_id long, version long, start long, end long", "version long, at array<long>, starts array<long>, ends array<long>", "update", GroupStateTimeout.EventTimeTimeout)
    lists = settled(told.withColumn("first", F.coalesce("start", F.lit(-1))), ["user_id", "version", "first"], base)
    last = lists.groupBy("user_id").agg(F.max("version").alias("version"))
    return lists.join(last, ["user_id", "version"]).filter("start is not null").select("user_id", "start", "end")


def feeds(own: DataFrame, followed: list[DataFrame], key: str, base: str | None = None) -> DataFrame:
    """All rows of the own feed and of those followed, streams of the same columns, each key once, with the first batch's row kept (ST-19, SRC-16)."""
    every = own
    for f in followed:
        every = every.unionByName(f)

    def into(batch: DataFrame, stored: DataFrame) -> DataFrame:
        first = batch.groupBy(key).agg(F.min(F.struct(*[c for c in batch.columns if c != key])).alias("_x")).select(key, "_x.*").select(*batch.columns)
        return first.join(stored.select(key), key, "left_anti").select(*batch.columns)

    return settled(every, None, base, into, every.schema)
