"""Source tables, log scans, file scans and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one task sorts or groups.
ROWS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local master without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="sylva-")
    spark.sparkContext.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, which cuts its lineage: lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df dealt by keys to as many tasks as its rows ask for, ROWS each, and to no fewer than the shuffle partitions.

    What a task sorts or groups then stays the same however large df is; adaptive execution, which goes by compressed bytes, doesn't merge these. Without rows they
    are counted, which for a table as written takes its footers alone.
    """
    n = df.count() if rows is None else rows
    return df.repartition(max(partitions(df.sparkSession), -(-n // ROWS)), *keys)


def counted(right: DataFrame) -> DataFrame:
    """right, a table as written, for a join: broadcast if it has ROWS rows at most, else merged. Spark would go by the bytes of its files."""
    return F.broadcast(right) if right.count() <= ROWS else right.hint("merge")


def paired(left: DataFrame, right: DataFrame, key: str, how: str, rows: int | None = None) -> DataFrame:
    """left joined with right on a key that few rows of left share, both spread by the rows of left, or as for rows.

    The sides are merged and never broadcast: Spark would go by right's compressed files, in which ids in order take less than a byte a row, and build it in the driver at 100 bytes a row.
    """
    n = left.count() if rows is None else rows
    return spread(left, key, rows=n).join(spread(right, key, rows=n).hint("merge"), key, how)


def met(left: DataFrame, right: DataFrame, key: str, how: str, few: bool = False) -> DataFrame:
    """left joined with right on key, both spread; how: left, inner, left_semi or left_anti.

    Keys that more than ROWS rows of left have are as many as its rows / ROWS at most, and meet right by broadcast, so no task gets all rows of one key. left is read three
    times, so it should be a table as written, or a scan; right should have few rows for each key. With few, right is a table as written, and is broadcast whole if it has ROWS rows at most, as counted.
    """
    if few and right.count() <= ROWS:
        return left.join(F.broadcast(right), key, how)
    n = left.count()
    pieces = -(-n // ROWS)
    if pieces > 1:
        hot = F.broadcast(written(left.groupBy(key).agg(F.count("*").alias("_n")).filter((F.col("_n") > ROWS) & F.col(key).isNotNull()).select(key), "hot"))
        often = left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, how)
        left = left.join(hot, key, "left_anti")
    rest = paired(left, right, key, how, n)
    return rest.unionByName(often) if pieces > 1 else rest


def millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.unix_date(F.to_date(ts)).cast("long") * 86_400_000 + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + F.floor(F.date_part(F.lit("second"), ts) * 1000).cast("long")


def log_range(log: DataFrame, from_seq: int, most: int) -> DataFrame:
    """The first `most` rows of a log from from_seq on (SRC-01)."""
    return log.filter(F.col("seq") >= from_seq).orderBy("seq").limit(most)


def log_row(log: DataFrame, seq: int) -> DataFrame:
    """The row of each log at seq, if any (SRC-02); the condition reaches the scan."""
    return log.filter(F.col("seq") == seq)


def region_log(log: DataFrame, log_id: object, from_seq: int = 0) -> DataFrame:
    """The rows of one log from from_seq on, each with the log's tip (SRC-04); none if the log isn't held. A log partitioned by log_id is pruned to that folder."""
    own = log.filter(F.col("log_id") == log_id)
    tip = own.agg(F.max("seq").alias("tip"))  # one row
    return own.filter(F.col("seq") >= from_seq).crossJoin(F.broadcast(tip))


def baselines(log: DataFrame) -> DataFrame:
    """log_id, seq, node_id, root of the generations of regions that logs begin, in RegionBaseline events (SRC-07)."""
    return log.filter("kind = 'RegionBaseline'").select("log_id", "seq", "node_id", "root")


def held_logs(found: DataFrame, held: DataFrame, parents: DataFrame) -> DataFrame:
    """log_id, status of all logs that baselines found(log_id, parent_log) name, from the top down (ST-04): read if held and all above it are, else not_held or unreached.

    parents(log_id) are the top logs. As many rounds as logs are nested.
    """
    have = held.select("log_id").distinct()
    reached = written(parents.select("log_id").distinct().join(have, "log_id", "left_semi"), "reached")
    last = reached
    while True:
        below = found.join(last.select(F.col("log_id").alias("parent_log")), "parent_log", "left_semi").select("log_id").distinct()
        last = written(below.join(have, "log_id", "left_semi").join(reached, "log_id", "left_anti"), "reached")
        if last.isEmpty():
            break
        reached = written(reached.unionByName(last), "reached")
    every = found.select("log_id").unionByName(parents.select("log_id")).distinct()
    ok, there = reached.withColumn("_ok", F.lit(True)), have.withColumn("_have", F.lit(True))
    return every.join(ok, "log_id", "left").join(there, "log_id", "left").select("log_id", F.when(F.col("_ok"), "read").when(F.col("_have"), "unreached").otherwise("not_held").alias("status"))


def log_tips(log: DataFrame) -> DataFrame:
    """The last seq of every log and its row count (SRC-03, ST-05)."""
    return log.groupBy("log_id").agg(F.max("seq").alias("seq"), F.count("*").alias("n_rows"))


def batch_cut(log: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """Per log, the rows of the next batch: at most most_rows, and none after one that brings the bodies beyond most_bytes (ORD-07).

    Each log's rows from the batch's start on are summed in one task; a log is read in batches, so filter it by seq first.
    """
    w = Window.partitionBy("log_id").orderBy("seq")
    before = F.coalesce(F.sum(F.octet_length("body")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return log.withColumn("_no", F.row_number().over(w)).withColumn("_before", before).filter((F.col("_no") <= most_rows) & (F.col("_before") <= most_bytes)).drop("_no", "_before")


def files(spark: SparkSession, path: str, extensions: str = "", content: bool = False) -> DataFrame:
    """uri, rel, name, length, modified, and content on demand, of the files under a folder, however deep (SRC-10, SRC-11).

    Names with a dot in front, also of folders, are left out; extensions is a list, separated by commas, in lower case, empty for all. Spark lists the folder in
    parallel and skips what it can't read. Without content only the listing is read.
    """
    from ..functions.scalars import has_extension

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/").split("://")[-1].removeprefix("file:")
    rel = F.regexp_replace(F.expr("regexp_replace(path, '^[a-z]+:/*', '/')"), "^.*?" + "".join(c if c.isalnum() or c in "/_-" else f"\\{c}" for c in root) + "/", "")
    name = F.element_at(F.split("path", "/"), -1)
    out = found.select(F.col("path").alias("uri"), rel.alias("rel"), name.alias("name"), "length", F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    return out.filter(~F.col("rel").rlike("(^|/)\\.") & has_extension(F.col("name"), F.lit(extensions)))


def appended(feed: DataFrame, more: DataFrame, key: str, position: str) -> DataFrame:
    """What of more an append-only feed takes: rows whose key it lacks, the first of each key by position (SRC-16)."""
    first = more.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in more.columns]), F.col(position)).alias("_x")).select("_x.*")
    return first.join(feed.select(key), key, "left_anti").select(*more.columns)
