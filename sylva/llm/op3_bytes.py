"""Contiguous shards of near equal bytes from global prefix sums. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, in_order, written


def byte_shards(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """Cuts docs, in order of doc_id, into n_shards contiguous shards of near equal bytes.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, start (bytes before it), shard and slot
    (gapless from 0 in each shard). A document belongs to the shard whose n-th part of all bytes holds
    its first byte, so a shard misses its target by less than one document.

    Only doc_id, size and checksum are shuffled; the text stays in the scan. Null text has size 1 and the
    checksum of the empty text; a null doc_id stands first; rows with equal doc_id stand by checksum and
    size; equal rows are interchangeable and each keeps a slot of its own. An empty table gives no rows.
    A document longer than a target leaves the shards that lie inside it empty. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    placed = in_order(written(narrow, "sizes"), F.col("doc_id"), F.col("text_crc32"), F.col("size"), size="size")
    total = F.broadcast(placed.agg(F.max(F.col("start") + F.col("size")).alias("_all")))
    placed = placed.join(total).withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"cast((start * {n_shards}) div _all as int)")))
    placed = written(placed.drop("_all"), "placed")
    first = placed.groupBy("shard").agg(F.min("row_no").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "start", "shard", (F.col("row_no") - F.col("_first")).alias("slot"))


def op3_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_shards(documents(spark, sf_dir), n_shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 is folded over each text's bytes by its table, which the first two expressions make.
ORACLE = """
with crc as (select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(256) r(i)),
texts as (select distinct coalesce(text, '') as text from documents),
sums as (select text, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) as text_crc32 from texts, crc),
sized as (select doc_id, strlen(coalesce(d.text, '')) + 1 as size, text_crc32 from documents d join sums on sums.text = coalesce(d.text, '')),
placed as (select *, coalesce(sum(size) over (order by doc_id nulls first, text_crc32, size rows between unbounded preceding and 1 preceding), 0) as start from sized),
cut as (select *, cast(least(7, start * 8 // (select sum(size) from sized)) as int) as shard from placed)
select doc_id, cast(size as bigint) as size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by start) - 1 as slot, cast(null as int) as grown_shard from cut"""
