"""Integrity: chains, chunk manifests, state commitments, seals, contents, duplicates.

Hashes are SHA-256 in lower-case hex. Null contents are empty where that is said, else their hash is null. Repeated rows are hashed each. Empty tables give no rows.
Columns beyond those named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import met, partitions, written


def chain_heads(log: DataFrame, seed: str) -> DataFrame:
    """log_id, n, head: the running SHA-256 over the rows of each log(log_id, seq, kind, body) in order (AGG-07).

    A chain is sequential within its log, so a log's rows are read in order by one task, which holds one hash; logs are
    independent. Null fields are left out of a row's line. To verify stored hashes use broken_links, which needs no more than each row's neighbour.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(log_id: object, n: int, head: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([log_id], kind), pa.array([n], pa.int64()), pa.array([head], pa.string())], names=["log_id", "n", "head"])

        log_id, n, head, kind = None, 0, seed, pa.null()
        for batch in batches:
            kind = batch.column(0).type
            for i, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n and i != log_id:
                    yield out(log_id, n, head)
                    n, head = 0, seed
                log_id, n, head = i, n + 1, hashlib.sha256(f"{head}|{line}".encode()).hexdigest()
        if n:
            yield out(log_id, n, head)

    rows = log.select("log_id", F.concat_ws("|", "seq", "kind", "body").alias("line"), "seq").repartition(partitions(log.sparkSession), "log_id").sortWithinPartitions("log_id", "seq", "line")
    return rows.select("log_id", "line").mapInArrow(run, f"log_id {dict(log.dtypes)['log_id']}, n long, head string")


def broken_links(log: DataFrame, seed: str) -> DataFrame:
    """Rows of log(log_id, seq, kind, body, chain_hash) whose hash is not the step from the row before (VF-03)."""
    before = F.coalesce(F.lag("chain_hash").over(Window.partitionBy("log_id").orderBy("seq")), F.lit(seed))
    step = F.sha2(F.concat_ws("|", before, F.concat_ws("|", "seq", "kind", "body")), 256)
    return log.withColumn("expected", step).filter("chain_hash is null or chain_hash <> expected")


def chunks(files: DataFrame, key: str, content: str, size: int) -> DataFrame:
    """key, chunk, length, hash for every chunk of `size` characters; empty content has none (RC-13, FN-16, T-20)."""
    n = F.ceil(F.length(content) / size).cast("int")
    out = files.filter(F.length(content) > 0).select(key, content, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    piece = F.substring(F.col(content), F.col("chunk") * size + 1, F.lit(size))
    return out.select(key, "chunk", F.length(piece).alias("length"), F.sha2(piece, 256).alias("hash"))


def manifest_roots(files: DataFrame, key: str, content: str, size: int) -> DataFrame:
    """key, n_chunks, root: the hash over a file's chunk hashes in order (AGG-06), computed in its row."""
    n = F.ceil(F.length(content) / size).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(places, lambda i: F.sha2(F.substring(F.col(content), i * size + 1, F.lit(size)), 256))
    return files.select(key, F.size(hashes).alias("n_chunks"), F.sha2(F.array_join(hashes, ""), 256).alias("root"))


def attested(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, chunk_size, manifest_root of manifests(file_id, content_hash, ...) that speak of what files(file_id, content_hash) hold now (JN-16)."""
    return manifests.join(files.select("file_id", "content_hash"), ["file_id", "content_hash"], "left_semi").select("file_id", "chunk_size", "manifest_root")


def _root_of_bytes(h: Column) -> Column:
    """The same for hashes as bytes, whose order is that of their digits."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(h)), lambda x: F.lower(F.hex(x))), ""), 256)


def _root_of(h: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(h)), ""), 256)


def commitment(rows: DataFrame, section: str | list[str], row: Column) -> DataFrame:
    """section, n, root: a commitment to each section's set of rows (AGG-05).

    Rows are hashed and combined in order of their hashes by their first four, then two, hex digits, so no group holds a
    section: a tree of fixed shape that any order of rows gives alike.
    """
    by = [section] if isinstance(section, str) else section
    leaf = rows.select(*by, F.unhex(F.sha2(row, 256)).alias("h")).withColumn("four", F.lower(F.hex(F.substring("h", 1, 2))))
    leaf = leaf.repartition(*by, "four")  # groups are too many for partial lists to be of use
    low = leaf.groupBy(*by, "four").agg(F.count("*").alias("n"), _root_of_bytes(F.col("h")).alias("h"))
    mid = low.groupBy(*by, F.substring("four", 1, 2).alias("two")).agg(F.sum("n").alias("n"), _root_of(F.concat("four", "h")).alias("h"))
    return mid.groupBy(*by).agg(F.sum("n").alias("n"), _root_of(F.concat("two", "h")).alias("root"))


def state_roots(sections: dict[str, tuple[DataFrame, str, list[str]]], members: DataFrame) -> DataFrame:
    """region, root: one hash over the commitments of all sections of what each region holds (AGG-05).

    sections: name -> relation, the column with the node that places a row, and its columns in order; names give the sections' order.
    members(id, region). A section without rows in a region counts as empty; nulls are written as empty fields.
    """
    members = written(members.select("id", "region"), "members")
    parts = None
    for name, (df, node, columns) in sections.items():
        line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
        rows = met(df.select(F.col(node).alias("id"), line.alias("_line")).filter("id is not null"), members, "id", "inner").select("region", F.lit(name).alias("section"), "_line")
        parts = rows if parts is None else parts.unionByName(rows)
    roots = commitment(parts, ["region", "section"], F.col("_line")).groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("section", "root"))).alias("_of"))
    all_ = F.concat_ws("", *[F.concat(F.lit(f"{name}:"), F.coalesce(F.try_element_at("_of", F.lit(name)), F.lit(""))) for name in sections])
    return members.select("region").distinct().join(roots, "region", "left").select("region", F.sha2(F.when(F.col("_of").isNull(), "").otherwise(all_), 256).alias("root"))


def compared(committed: DataFrame, computed: DataFrame, key: str) -> DataFrame:
    """key, status: ok, differs or unknown, of committed(key, root) against computed(key, root) (VF-05)."""
    out = committed.select(key, F.col("root").alias("_said")).join(computed.select(key, F.col("root").alias("_found")), key, "left")
    return out.select(key, F.when(F.col("_found").isNull(), "unknown").when(F.col("_found") == F.col("_said"), "ok").otherwise("differs").alias("status"))


def seals(regions: DataFrame, log: DataFrame) -> DataFrame:
    """log_id, status of regions(log_id, committed_seq, committed_head) against log(log_id, seq, chain_hash) (VF-06).

    sealed: the log ends where its head was committed, with that hash; open: it goes on beyond; short: its tail isn't held; differs: the committed row is another one.
    """
    tips = log.groupBy("log_id").agg(F.max("seq").alias("_tip"))
    at = log.select("log_id", F.col("seq").alias("committed_seq"), "chain_hash")
    out = regions.join(tips, "log_id", "left").join(at, ["log_id", "committed_seq"], "left")
    tip = F.coalesce("_tip", F.lit(0))
    status = F.when(tip < F.col("committed_seq"), "short").when(~F.col("chain_hash").eqNullSafe(F.col("committed_head")), "differs").when(tip > F.col("committed_seq"), "open").otherwise("sealed")
    return out.select("log_id", status.alias("status"))


def location_checks(locations: DataFrame, files: DataFrame, stored: DataFrame) -> DataFrame:
    """file_id, uri, status, action of live locations(file_id, uri) (VF-08, RD-17, VF-12).

    files(file_id, content_hash) says what each should hold; stored(uri, content) is what was found there, for instance spark.read.format("binaryFile"), hashed in the scan. status is
    Ok, Mismatch, Missing, or Unhashed where files has no hash. A mismatch is to be put in quarantine, a match to be let out.
    """
    found = stored.select("uri", F.sha2("content", 256).alias("_found"), F.lit(True).alias("_there"))
    out = locations.select("file_id", "uri").join(files.select("file_id", "content_hash"), "file_id").join(found, "uri", "left")
    status = F.when(F.coalesce("content_hash", F.lit("")) == "", "Unhashed").when(F.col("_there").isNull(), "Missing").when(F.col("_found").eqNullSafe(F.col("content_hash")), "Ok").otherwise("Mismatch")
    out = out.select("file_id", "uri", status.alias("status"))
    return out.withColumn("action", F.when(F.col("status") == "Mismatch", "quarantine").when(F.col("status") == "Ok", "lift"))


def bundle_checks(bundles: DataFrame, digits: str) -> DataFrame:
    """bundle rows with status: ok, bad hash or bad checkpoint, for bundles(position, bundle, sha256, checkpoint) (VF-10, FN-20)."""
    from ..functions.scalars import checkpoint

    status = F.when(~F.sha2("bundle", 256).eqNullSafe(F.col("sha256")), "bad hash").when(~checkpoint(F.col("position"), digits).eqNullSafe(F.col("checkpoint")), "bad checkpoint").otherwise("ok")
    return bundles.withColumn("status", status)


def importable(bundles: DataFrame, known: DataFrame, key: str, digits: str) -> DataFrame:
    """bundles with action: write what verifies and isn't known, skip what is, reject the rest (RD-18)."""
    have = known.select(key).distinct().withColumn("_have", F.lit(True))
    out = bundle_checks(bundles, digits).join(have, key, "left")
    return out.withColumn("action", F.when(F.col("status") != "ok", "reject").when(F.col("_have"), "skip").otherwise("write")).drop("_have")


def ordered_fingerprint(rows: DataFrame, group: str, key: str, line: Column, block: int = 1 << 16) -> DataFrame:
    """group, fingerprint: a hash over the lines of each group in order of a whole-number key, which is unique in it (AGG-13).

    Keys are cut into blocks, whose lines are hashed together; their hashes, one for each block, are hashed in order.
    """
    at = rows.select(group, F.col(key).alias("_key"), F.floor(F.col(key) / block).alias("_block"), line.alias("_line"))
    joined = lambda order, c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("l")))), lambda x: x["l"]), "\n"), 256)
    low = at.groupBy(group, "_block").agg(joined("_key", "_line").alias("_h"))
    return low.groupBy(group).agg(joined("_block", "_h").alias("fingerprint"))


def duplicates(files: DataFrame, key: str, content: str) -> DataFrame:
    """hash, n, first: contents that more than one file has (AGG-16/17); only hashes are shuffled."""
    out = files.select(F.sha2(content, 256).alias("hash"), key).groupBy("hash").agg(F.count("*").alias("n"), F.min(key).alias("first"))
    return out.filter("n > 1")
