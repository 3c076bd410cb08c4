"""Catalog relations as views over the source tables, in Spark and as DuckDB common table expressions.

The forest is: root; regions, nations, customers and orders as nested folders; suppliers under their nation; folder
parts with a file for each part. Orders refer to their parts. Finished orders are removed from their customer;
references to parts that were returned are suspended.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.authz import ANY, KEY, PUBLIC, TAG
from ..sources.tables import millis, spread, table

AS_OF = 1500  # the time at which expiry and activity are judged


def _id(prefix: str, key: str):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """id, node_type, label."""
    row = lambda df, i, kind, label: df.select(i.alias("id"), F.lit(kind).alias("node_type"), label.alias("label"))
    t = lambda name: table(spark, d, name)
    fixed = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(x).alias("id"), F.lit("folder").alias("node_type"), F.lit(x).alias("label")) for x in ("root", "parts")])))
    parts = [
        fixed, row(t("region"), _id("r", "r_regionkey"), "folder", F.col("r_name")), row(t("nation"), _id("n", "n_nationkey"), "folder", F.col("n_name")),
        row(t("customer"), _id("c", "c_custkey"), "folder", F.col("c_name")), row(t("orders"), _id("o", "o_orderkey"), "folder", _id("order-", "o_orderkey")),
        row(t("supplier"), _id("s", "s_suppkey"), "folder", F.col("s_name")), row(t("part"), _id("p", "p_partkey"), "file", F.col("p_name")),
    ]
    return reduce(DataFrame.unionByName, parts)


def links(spark: SparkSession, d: str) -> DataFrame:
    """id, parent_id, child_id, link_type, order_key, removed, suspended."""

    def row(df, parent, child, kind, key, removed=F.lit(False), suspended=F.lit(False)):
        return df.select(
            F.concat(parent, F.lit(">"), child).alias("id"), parent.alias("parent_id"), child.alias("child_id"), F.lit(kind).alias("link_type"),
            F.concat(F.lpad(F.col(key).cast("string"), 9, "0"), F.lit("U")).alias("order_key"), removed.alias("removed"), suspended.alias("suspended"),
        )

    t = lambda name: table(spark, d, name)
    root = F.lit("root")
    items = spread(t("lineitem").select("l_orderkey", "l_partkey", "l_returnflag"), "l_orderkey", "l_partkey", rows=t("lineitem").count())
    refs = items.groupBy("l_orderkey", "l_partkey").agg(F.max(F.col("l_returnflag") == "R").alias("returned"))
    parts = [
        row(t("region"), root, _id("r", "r_regionkey"), "contains", "r_regionkey"), row(t("nation"), _id("r", "n_regionkey"), _id("n", "n_nationkey"), "contains", "n_nationkey"),
        row(t("customer"), _id("n", "c_nationkey"), _id("c", "c_custkey"), "contains", "c_custkey"), row(t("supplier"), _id("n", "s_nationkey"), _id("s", "s_suppkey"), "contains", "s_suppkey"),
        row(t("orders"), _id("c", "o_custkey"), _id("o", "o_orderkey"), "contains", "o_orderkey", F.col("o_orderstatus") == "F"),
        row(spark.range(1), root, F.lit("parts"), "contains", "id"), row(t("part"), F.lit("parts"), _id("p", "p_partkey"), "contains", "p_partkey"),
        row(refs, _id("o", "l_orderkey"), _id("p", "l_partkey"), "ref", "l_partkey", suspended=F.col("returned")),
    ]
    return reduce(DataFrame.unionByName, parts)


def contains(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).filter("link_type = 'contains' and not removed")


_LINK = "{parent} || '>' || {child} as id, {parent} as parent_id, {child} as child_id, '{kind}' as link_type, lpad(cast({key} as varchar), 9, '0') || 'U' as order_key, {removed} as removed, {suspended} as suspended"


def _sql_link(source: str, parent: str, child: str, key: str, kind: str = "contains", removed: str = "false", suspended: str = "false") -> str:
    return "select " + _LINK.format(parent=parent, child=child, kind=kind, key=key, removed=removed, suspended=suspended) + f" from {source}"


NODES_SQL = """nodes as (select 'root' as id, 'folder' as node_type, 'root' as label union all select 'parts', 'folder', 'parts'
 union all select 'r' || r_regionkey, 'folder', r_name from region union all select 'n' || n_nationkey, 'folder', n_name from nation
 union all select 'c' || c_custkey, 'folder', c_name from customer union all select 'o' || o_orderkey, 'folder', 'order-' || o_orderkey from orders
 union all select 's' || s_suppkey, 'folder', s_name from supplier union all select 'p' || p_partkey, 'file', p_name from part)"""
LINKS_SQL = "links as (" + " union all ".join([
    _sql_link("region", "'root'", "'r' || r_regionkey", "r_regionkey"), _sql_link("nation", "'r' || n_regionkey", "'n' || n_nationkey", "n_nationkey"),
    _sql_link("customer", "'n' || c_nationkey", "'c' || c_custkey", "c_custkey"), _sql_link("supplier", "'n' || s_nationkey", "'s' || s_suppkey", "s_suppkey"),
    _sql_link("orders", "'c' || o_custkey", "'o' || o_orderkey", "o_orderkey", removed="o_orderstatus = 'F'"), _sql_link("(select 0 as id) z", "'root'", "'parts'", "z.id"),
    _sql_link("part", "'parts'", "'p' || p_partkey", "p_partkey"),
    _sql_link("(select l_orderkey, l_partkey, bool_or(l_returnflag = 'R') as returned from lineitem group by all) x", "'o' || l_orderkey", "'p' || l_partkey", "l_partkey", "ref", suspended="returned"),
]) + ")"
CONTAINS_SQL = "contains_ as (select * from links where link_type = 'contains' and not removed)"


def with_sql(*views: str, recursive: bool = False) -> str:
    return ("with recursive " if recursive else "with ") + ", ".join(views) + " "


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """log_id, seq, at_ms, kind, entity, field, value: the events table as one catalog log a user."""
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.lit("top").alias("log_id"), F.col("event_id").alias("seq"), millis(F.col("ts")).alias("at_ms"), kinds[F.col("event_type")].alias("kind"), F.col("user_id").alias("entity"), k.alias("field"), "value")


#: Which kind of catalog event each event type stands for.
KINDS = {"signup": "DeviceAuthorized", "view": "NodeCreated", "click": "LinkCreated", "purchase": "AclSet", "error": "Revoked"}
EVENTS_SQL = (
    "log as (select 'top' as log_id, event_id as seq, epoch_us(ts) // 1000 as at_ms, case event_type " + " ".join(f"when '{a}' then '{b}'" for a, b in KINDS.items()) + " end as kind, "
    "user_id as entity, cast(json_extract_string(props, '$.k') as int) as field, value from events)"
)


def chat_log(spark: SparkSession, d: str) -> DataFrame:
    """log_id, seq, kind, body: one log a conversation, one event a turn."""
    t = table(spark, d, "conversations")
    return t.select(F.col("conv_id").alias("log_id"), (F.col("turn") + 1).alias("seq"), F.col("role").alias("kind"), F.col("text").alias("body"))


CHAT_SQL = "log as (select conv_id as log_id, turn + 1 as seq, role as kind, text as body from conversations)"


def device_keys(spark: SparkSession, d: str) -> DataFrame:
    """pubkey, device_index (-1: member), authorized_at, revoked_at: one key a customer; every 50th is an owner's, every 11th is revoked."""
    c = F.col("c_custkey")
    return table(spark, d, "customer").select(_id("k", "c_custkey").alias("pubkey"), F.when(c % 50 == 0, 0).otherwise(-1).cast("long").alias("device_index"), c.alias("authorized_at"), F.when(c % 11 == 0, c + 500).alias("revoked_at"))


def member_tags(spark: SparkSession, d: str) -> DataFrame:
    """member, tag, authority: customers carry their segment as a tag, given by one of 13 authorities."""
    return table(spark, d, "customer").select(_id("k", "c_custkey").alias("member"), F.lower("c_mktsegment").alias("tag"), F.concat(F.lit("k"), (F.col("c_custkey") % 13).cast("string")).alias("authority"))


def acl(spark: SparkSession, d: str) -> DataFrame:
    """node_id, principal_kind, principal_id, authority, rights, expires_at (0: never)."""
    r, n, c = (table(spark, d, x) for x in ("region", "nation", "customer"))
    row = lambda df, node, kind, who, authority, rights, expires: df.select(node.alias("node_id"), F.lit(kind).alias("principal_kind"), who.alias("principal_id"), authority.alias("authority"), rights.cast("int").alias("rights"), expires.cast("long").alias("expires_at"))
    none, zero = F.lit(""), F.lit(0)
    tags = table(spark, d, "customer").select("c_nationkey", F.lower("c_mktsegment").alias("tag")).distinct()
    return reduce(DataFrame.unionByName, [
        row(r.filter("r_regionkey < 2"), _id("r", "r_regionkey"), PUBLIC, none, none, F.lit(1), zero),
        row(n, _id("n", "n_nationkey"), ANY, none, none, F.when(F.col("n_nationkey") % 3 == 0, 1).otherwise(2), F.col("n_nationkey") * 100),
        row(tags, _id("n", "c_nationkey"), TAG, F.col("tag"), F.concat(F.lit("k"), (F.col("c_nationkey") % 13).cast("string")), F.lit(2), zero),
        row(c, _id("c", "c_custkey"), KEY, _id("k", "c_custkey"), none, F.when(F.col("c_acctbal") > 0, 5).otherwise(1), F.col("c_custkey") % 4 * 1000),
    ])


KEYS_SQL = "device_keys as (select 'k' || c_custkey as pubkey, cast(case when c_custkey % 50 = 0 then 0 else -1 end as bigint) as device_index, c_custkey as authorized_at, case when c_custkey % 11 = 0 then c_custkey + 500 end as revoked_at from customer)"
TAGS_SQL = "member_tags as (select 'k' || c_custkey as member, lower(c_mktsegment) as tag, 'k' || (c_custkey % 13) as authority from customer)"
ACL_SQL = """acl as (select 'r' || r_regionkey as node_id, 2 as principal_kind, '' as principal_id, '' as authority, 1 as rights, cast(0 as bigint) as expires_at from region where r_regionkey < 2
 union all select 'n' || n_nationkey, 0, '', '', case when n_nationkey % 3 = 0 then 1 else 2 end, n_nationkey * 100 from nation
 union all select distinct 'n' || c_nationkey, 3, lower(c_mktsegment), 'k' || (c_nationkey % 13), 2, 0 from customer
 union all select 'c' || c_custkey, 1, 'k' || c_custkey, '', case when c_acctbal > 0 then 5 else 1 end, c_custkey % 4 * 1000 from customer)"""
