"""Registered queries of imports, exports, unions of durable and temporary rows, and arrivals from other logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import sets, verify
from ..sources import feeds
from ..sources.tables import table
from . import forest as V
from .catalog import query
from .forest import CHAT_SQL, EVENTS_SQL, LINKS_SQL, NODES_SQL, with_sql

# --- durable and temporary rows ----------------------------------------------------------------------------------


def _rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, d, "orders")
    durable = orders.filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("id"), F.lit("durable").alias("label"), F.col("o_custkey").alias("parent"))
    temp = orders.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.lit("temp").alias("label"), F.col("o_custkey").alias("parent"))
    return durable, temp


_ROWS_SQL = "durable as (select o_orderkey as id, 'durable' as label, o_custkey as parent from orders where o_orderstatus <> 'O'), temporary as (select o_orderkey as id, 'temp' as label, o_custkey as parent from orders where o_orderkey % 3 <> 0)"


@query(with_sql(_ROWS_SQL) + "select *, false as temp from durable union all select *, true from temporary where id not in (select id from durable)")
def node_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each node's durable row, else its temporary one (SRC-08)."""
    return sets.preferred(*_rows(spark, d), "id")


@query(with_sql(_ROWS_SQL) + "select parent, count(*) as n, count(*) filter (temp) as n_temp from (select *, false as temp from durable union all select *, true from temporary) group by parent")
def durable_and_temp_children(spark: SparkSession, d: str) -> DataFrame:
    """Children of each parent as a bag over both kinds of rows (SET-01)."""
    return sets.durable_and_temp(*_rows(spark, d)).groupBy("parent").agg(F.count("*").alias("n"), F.count(F.when(F.col("temp"), 1)).alias("n_temp"))


@query("select l_partkey as file_id, l_suppkey as location from lineitem where l_returnflag <> 'R' union select l_partkey, l_suppkey from lineitem where l_linestatus = 'O'")
def tracked_locations(spark: SparkSession, d: str) -> DataFrame:
    """The set of locations that are live or scanned (SET-03, AGG-17)."""
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("file_id"), F.col("l_suppkey").alias("location"), "l_returnflag", "l_linestatus")
    return sets.distinct_union(rows.filter("l_returnflag <> 'R'").drop("l_returnflag", "l_linestatus"), rows.filter("l_linestatus = 'O'").drop("l_returnflag", "l_linestatus"))


@query("select p_partkey, p_partkey not in (select l_partkey from lineitem where l_quantity = 50) and p_partkey not in (select l_partkey from lineitem where l_returnflag = 'R' and l_discount > 0.08) as available from part")
def file_availability(spark: SparkSession, d: str) -> DataFrame:
    """Whether a file is neither quarantined nor pending (FLT-12, SET-02)."""
    lines = table(spark, d, "lineitem").withColumn("p_partkey", F.col("l_partkey"))
    return sets.available(table(spark, d, "part").select("p_partkey"), lines.filter("l_quantity = 50"), lines.filter("l_returnflag = 'R' and l_discount > 0.08"), "p_partkey")


@query("select distinct l_partkey as file_id, 's' || l_suppkey as uri from lineitem where l_returnflag = 'N' union all select p_partkey, 'store:///' || p_partkey from part where p_size < 10")
def locations_with_store(spark: SparkSession, d: str) -> DataFrame:
    """Live locations and a made-up row for what the store holds (SET-06, RD-02)."""
    held = table(spark, d, "lineitem").filter("l_returnflag = 'N'").select(F.col("l_partkey").alias("file_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("uri")).distinct()
    return sets.with_store_rows(held, table(spark, d, "part").filter("p_size < 10").select(F.col("p_partkey").alias("file_id")), "store:///")


@query("select o_orderkey, o_totalprice, (select count(*) from orders) as total from orders order by o_totalprice desc, o_orderkey limit 50 offset 100")
def page_with_total(spark: SparkSession, d: str) -> DataFrame:
    """A page of a listing and the number of all rows (AGG-19)."""
    return sets.page_with_total(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 100, 50)


# --- scans and listings ------------------------------------------------------------------------------------------


@query(with_sql(NODES_SQL) + "select node_type, count(*) as n, min(label) as first_label from nodes group by node_type")
def type_scan(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by type (SRC-09)."""
    return V.nodes(spark, d).groupBy("node_type").agg(F.count("*").alias("n"), F.min("label").alias("first_label"))


@query(with_sql(EVENTS_SQL) + "select kind, min(seq) as first_seq, count(*) as n from log where seq between 100 and 5000 group by kind")
def kind_scan(spark: SparkSession, d: str) -> DataFrame:
    """Where each kind of event first stands in a range of the log (SRC-06)."""
    return V.event_log(spark, d).filter(F.col("seq").between(100, 5000)).groupBy("kind").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"))


@query(with_sql(NODES_SQL, LINKS_SQL) + "select child_id as id, label, count(*) as n_parents, count(*) filter (suspended) as n_inactive from links join nodes on nodes.id = child_id where not removed group by child_id, label having count(*) > 1")
def shared_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with several inbound links, and how many of these are inactive (RD-15, AGG-11)."""
    inbound = V.links(spark, d).filter("not removed").groupBy(F.col("child_id").alias("id")).agg(F.count("*").alias("n_parents"), F.count(F.when(F.col("suspended"), 1)).alias("n_inactive"))
    return inbound.filter("n_parents > 1").join(V.nodes(spark, d).select("id", "label"), "id")


@query("select p_partkey, p_name, arg_min(l_suppkey, (l_orderkey, l_linenumber, l_suppkey)) as first_location from part left join lineitem on l_partkey = p_partkey group by p_partkey, p_name")
def first_location(spark: SparkSession, d: str) -> DataFrame:
    """Files with their first member location, if any (JN-19). Locations are reduced before the join."""
    first = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min_by("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_suppkey")).alias("first_location"))
    return table(spark, d, "part").select("p_partkey", "p_name").join(first, "p_partkey", "left")


@query(
    "with blocks as (select c_mktsegment, c_custkey // 1024 as block, sha256(string_agg(c_custkey || '=' || c_nationkey, chr(10) order by c_custkey)) as h from customer group by 1, 2) "
    "select c_mktsegment, sha256(string_agg(h, chr(10) order by block)) as fingerprint from blocks group by c_mktsegment"
)
def score_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A hash over the lines id=score of each group in order of id (AGG-13), by way of hashes of ranges of ids."""
    line = F.concat_ws("=", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"))
    return verify.ordered_fingerprint(table(spark, d, "customer"), "c_mktsegment", "c_custkey", line, 1024)


# --- feeds -------------------------------------------------------------------------------------------------------

_LINES_SQL = "lines as (select event_type, case when event_id % 7 = 0 then props[1:length(props) - 1] else props end as line from events)"


@query(with_sql(_LINES_SQL) + "select event_type, count(*) filter (json_valid(line)) as imported, count(*) filter (not json_valid(line)) as skipped from lines group by event_type")
def json_import(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a feed that parse and lines that don't; every seventh is cut short (SRC-17)."""
    cut = F.when(F.col("event_id") % 7 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    lines = table(spark, d, "events").select("event_type", cut.alias("line"))
    return feeds.import_counts(feeds.parsed_lines(lines, "line", "k int"), "event_type")


@query(with_sql(EVENTS_SQL) + "select seq, bundle, sha256(bundle) as sha256 from (select seq, cast(to_json({'entity': entity, 'kind': kind, 'seq': seq}) as varchar) as bundle from log where seq > 1000 and kind <> 'Revoked')")
def export_bundles(spark: SparkSession, d: str) -> DataFrame:
    """An incremental export: canonical JSON of what follows a position, with hashes (SNK-06, SNK-07, SNK-09)."""
    rows = feeds.since(V.event_log(spark, d), "seq", 1000, F.col("kind") == "Revoked")
    return feeds.bundles(rows, "seq", "seq", "kind", "entity")


@query("select c_mktsegment, 0 as tree, 'c' || c_custkey as triplet_id, c_nationkey / 25.0::double as truth_score, [c_mktsegment, c_name] as words from customer union all select c_mktsegment, 1, 's' || c_custkey, 0.5::double, [] from customer where c_custkey % 2 = 0")
def forest_import(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of nested forest documents (SRC-18)."""
    node = lambda prefix, score, words: F.struct(F.concat(F.lit(prefix), F.col("c_custkey").cast("string")).alias("triplet_id"), score.alias("truth_score"), words.alias("words"))
    one = F.struct(F.array(node("c", F.col("c_nationkey") / F.lit(25.0), F.array("c_mktsegment", "c_name"))).alias("nodes"))
    two = F.struct(F.array(node("s", F.lit(0.5), F.array().cast("array<string>"))).alias("nodes"))
    trees = F.when(F.col("c_custkey") % 2 == 0, F.array(one, two)).otherwise(F.array(one))
    text = F.to_json(F.struct(trees.alias("trees")))
    return feeds.scored_nodes(table(spark, d, "customer").select("c_mktsegment", text.alias("text")), "text")


@query(
    with_sql(
        CHAT_SQL, "known as (select log_id, seq, sha256(body) as hash from log where seq <= 3)",
        "incoming as (select log_id, seq, sha256(case when log_id % 10 = 0 and seq = 2 then body || '!' else body end) as hash from log where not (log_id % 7 = 0 and seq = 4))",
        "tips as (select log_id, max(seq) as tip from known group by log_id)",
        "judged as (select i.log_id, i.seq, coalesce(tip, 0) as tip, case when i.seq > coalesce(tip, 0) then i.seq <> coalesce(tip, 0) + count(*) filter (i.seq > coalesce(tip, 0)) over (partition by i.log_id order by i.seq) else i.hash is distinct from k.hash end as bad from incoming i left join known k using (log_id, seq) left join tips on tips.log_id = i.log_id)",
    )
    + "select log_id, seq, case when bool_or(bad) over (partition by log_id order by seq) then 'broken' when seq > tip then 'append' else 'skip' end as action from judged"
)
def verified_append(spark: SparkSession, d: str) -> DataFrame:
    """Shipped log rows against the held ones: one in ten logs differs in its second row, one in seven lacks its fourth (ST-03, ST-08)."""
    log = V.chat_log(spark, d)
    known = log.filter("seq <= 3").select("log_id", "seq", F.sha2("body", 256).alias("hash"))
    body = F.when((F.col("log_id") % 10 == 0) & (F.col("seq") == 2), F.concat("body", F.lit("!"))).otherwise(F.col("body"))
    incoming = log.filter(~((F.col("log_id") % 7 == 0) & (F.col("seq") == 4))).select("log_id", "seq", F.sha2(body, 256).alias("hash"))
    return sets.verified_append(known, incoming)


# --- scalars -----------------------------------------------------------------------------------------------------


_RANGE_TEXTS = ["0-10", "5-", "7-3", "-5", "9", "", "1-2-3", "99999999999999999999-", "1-99999999999999999999", "a-b"]


@query("select event_id, [0, 5, 7, null, null, null, null, null, null, null][1 + event_id % 10]::bigint as start, [10, null, 3, null, null, null, null, null, null, null][1 + event_id % 10]::bigint as \"end\" from events")
def byte_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Ranges START-END and START-, malformed ones and ones beyond 64 bits (FN-28)."""
    text = F.element_at(F.array(*map(F.lit, _RANGE_TEXTS)), (F.col("event_id") % 10 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", *[c.alias(k) for k, c in S.byte_range(text).items()])


@query("select event_id, case when x <= 0 then 'expired' when x >= 604800000 then x // 604800000 || 'w' when x >= 86400000 then x // 86400000 || 'd' when x >= 3600000 then x // 3600000 || 'h' when x >= 60000 then x // 60000 || 'm' else (x + 999) // 1000 || 's' end as remaining from (select event_id, event_id * event_id * 37 - 5 as x from events)")
def remaining_time(spark: SparkSession, d: str) -> DataFrame:
    """Time until expiry in its largest unit (FN-11)."""
    return table(spark, d, "events").select("event_id", S.remaining(F.col("event_id") * F.col("event_id") * 37 - 5).alias("remaining"))
