"""Registered queries of authorization, folds of a whole catalog log, and integrity of logs and regions."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import authz, fold, graph, reconcile, verify
from ..sources import tables
from ..sources.tables import table
from . import forest as V
from .catalog import _CLOSURE_SQL, _REGION_SQL, _RIGHTS_SQL, SEED, query
from .forest import ACL_SQL, AS_OF, CHAT_SQL, CONTAINS_SQL, KEYS_SQL, LINKS_SQL, NODES_SQL, TAGS_SQL, with_sql

_STANDING_SQL = "standing as (select pubkey, case when revoked_at is not null then 'revoked' when device_index = -1 then 'member' else 'owner' end as standing from device_keys)"


def _id(prefix: str, key: str | Column) -> Column:
    return F.concat(F.lit(prefix), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _rights_sql(pairs: str, *views: str) -> str:
    """effective(principal, node_id, rights) of the pairs that a query gives."""
    asked = "select 'k' || o_custkey as principal, 'o' || o_orderkey as node_id from orders"
    assert asked in _RIGHTS_SQL
    return with_sql(LINKS_SQL, CONTAINS_SQL, _CLOSURE_SQL, KEYS_SQL, TAGS_SQL, ACL_SQL, _STANDING_SQL, *views, _RIGHTS_SQL.replace(asked, pairs), recursive=True)


def _rights(spark: SparkSession, d: str, pairs: DataFrame) -> DataFrame:
    closure = graph.ancestors(V.contains(spark, d))
    return authz.effective_rights(pairs, closure, V.acl(spark, d), V.device_keys(spark, d), V.member_tags(spark, d), AS_OF)


# --- authorization -----------------------------------------------------------------------------------------------


@query(with_sql(ACL_SQL) + "select node_id, principal_kind, principal_id, authority, rights, expires_at, case rights when 1 then 'r' when 2 then 'w' when 5 then 'ra' end as letters from acl where node_id in (select 'n' || n_nationkey from nation union all select 'c' || c_custkey from customer where c_custkey % 3 = 0)")
def acl_listing(spark: SparkSession, d: str) -> DataFrame:
    """The entries on nations and on every third customer (AU-07)."""
    nodes = table(spark, d, "nation").select(_id("n", "n_nationkey").alias("node_id")).unionByName(table(spark, d, "customer").filter("c_custkey % 3 = 0").select(_id("c", "c_custkey").alias("node_id")))
    return authz.listed(V.acl(spark, d), nodes).select("node_id", "principal_kind", "principal_id", "authority", "rights", "expires_at", "letters")


@query(with_sql(TAGS_SQL, KEYS_SQL) + "select member, tag, authority, authority in (select pubkey from device_keys where revoked_at is null) as live from member_tags")
def member_tag_rows(spark: SparkSession, d: str) -> DataFrame:
    """The tags of every key, also those whose authority is gone (RD-03)."""
    live = V.device_keys(spark, d).filter("revoked_at is null").select(F.col("pubkey").alias("authority"), F.lit(True).alias("_live"))
    return V.member_tags(spark, d).join(live, "authority", "left").select("member", "tag", "authority", F.coalesce("_live", F.lit(False)).alias("live"))


_HOME_PAIRS = "select 'k' || c_custkey as principal, 'c' || c_custkey as node_id from customer union all select 'k' || c_custkey, 'n' || c_nationkey from customer union all select 'k' || c_custkey, 'root' from customer"


def _home_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    of = lambda node: c.select(_id("k", "c_custkey").alias("principal"), node.alias("node_id"))
    return of(_id("c", "c_custkey")).unionByName(of(_id("n", "c_nationkey"))).unionByName(of(F.lit("root")))


@query(_rights_sql(_HOME_PAIRS) + "select principal, node_id, rights, rights & 2 = 2 as allowed from effective")
def may_write(spark: SparkSession, d: str) -> DataFrame:
    """Whether every key may write on its own folder, its nation's and the root (RD-04)."""
    return authz.may(_rights(spark, d, _home_pairs(spark, d)), authz.WRITE)


@query(
    _rights_sql(_HOME_PAIRS)
    + "select 'k' || c_custkey as principal, 'n' || c_nationkey as region, exists (select 1 from effective where principal = 'k' || c_custkey and rights & 4 <> 0 and node_id in ('root', 'n' || c_nationkey)) as allowed from customer"
)
def replication_gate(spark: SparkSession, d: str) -> DataFrame:
    """Which keys may take a copy of their nation's log (AU-10)."""
    requests = table(spark, d, "customer").select(_id("k", "c_custkey").alias("principal"), _id("n", "c_nationkey").alias("region"))
    return authz.may_replicate(requests, _rights(spark, d, _home_pairs(spark, d)), "root")


_SEEN_PAIRS = "select distinct principal, node_id from (select 'k' || (o_custkey + o_orderkey % 2) as principal, 'o' || o_orderkey as node_id from orders union all select 'k' || (o_custkey + o_orderkey % 2), 'c' || o_custkey from orders)"


@query(
    _rights_sql(_SEEN_PAIRS)
    + "select a.principal, 'c' || o_custkey as parent_id, 'o' || o_orderkey as child_id from orders join effective a on a.node_id = 'o' || o_orderkey and a.rights & 1 = 1 join effective b on b.principal = a.principal and b.node_id = 'c' || o_custkey and b.rights & 1 = 1"
)
def readable_listing(spark: SparkSession, d: str) -> DataFrame:
    """Orders as their customer's key, or the next customer's, sees them (RD-08, AU-06)."""
    o = table(spark, d, "orders")
    who = _id("k", F.col("o_custkey") + F.col("o_orderkey") % 2).alias("principal")
    pairs = o.select(who, _id("o", "o_orderkey").alias("node_id")).unionByName(o.select(who, _id("c", "o_custkey").alias("node_id"))).distinct()
    return authz.readable_children(o.select(_id("c", "o_custkey").alias("parent_id"), _id("o", "o_orderkey").alias("child_id")), _rights(spark, d, pairs))


_ACTS = ["AclSet", "LinkCreated", "LinkRemoved", "FileLocationAdded", "NodeMovedOut", "MemberTagged", "RegionMarked", "NodeMovedIn"]
_ACTS_SQL = (
    "acts as (select o_orderkey as seq, ["
    + ", ".join(f"'{x}'" for x in _ACTS)
    + f"""][1 + o_orderkey % 8] as kind, 'k' || case when o_orderkey % 3 = 0 then o_custkey % 100 * 11 else o_custkey end as author, {AS_OF} - o_orderkey % 700 as at,
 case when o_orderkey % 5 = 0 then 'c' || o_custkey else 'o' || o_orderkey end as node_id, case when o_orderkey % 7 <> 0 then 'c' || o_custkey end as parent_id, case when o_orderkey % 4 <> 3 then 'c' || o_custkey || '>o' || o_orderkey else 'gone' end as link_id from orders)"""
)
_NEED_SQL = """need as (select a.*, case when kind in ('AclSet', 'RegionMarked', 'FileLocationAdded') then node_id when kind in ('LinkCreated', 'NodeMovedIn') then a.parent_id
  when kind in ('LinkRemoved', 'NodeMovedOut') and l.parent_id is not null then l.parent_id when kind = 'NodeMovedOut' then node_id when kind = 'LinkRemoved' and l.id is not null then l.child_id end as target,
  case when kind in ('AclSet', 'RegionMarked') then 4 when kind in ('FileLocationAdded', 'LinkCreated', 'NodeMovedIn') or l.parent_id is not null then 2 else 4 end as bit from acts a left join links l on l.id = a.link_id)"""


def _acts(spark: SparkSession, d: str) -> DataFrame:
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.element_at(F.array(*map(F.lit, _ACTS)), (i % 8 + 1).cast("int"))
    return table(spark, d, "orders").select(
        i.alias("seq"), kind.alias("kind"), _id("k", F.when(i % 3 == 0, c % 100 * 11).otherwise(c)).alias("author"), (AS_OF - i % 700).alias("at"), F.when(i % 5 == 0, _id("c", c)).otherwise(_id("o", i)).alias("node_id"),
        F.when(i % 7 != 0, _id("c", c)).alias("parent_id"), F.when(i % 4 != 3, F.concat(_id("c", c), F.lit(">"), _id("o", i))).otherwise("gone").alias("link_id"),
    )


@query(
    _rights_sql("select distinct author as principal, target as node_id from need where target is not null", _ACTS_SQL, _NEED_SQL)
    + '''select seq, target, case when target is not null then bit end as needed, case when not coalesce(authorized_at <= need."at" and (revoked_at is null or revoked_at > need."at"), false) then 'inactive' when target is null or coalesce(e.rights, 0) & bit = bit then 'ok' else 'forbidden' end as verdict from need left join device_keys on pubkey = author left join effective e on e.principal = author and e.node_id = target'''
)
def member_events(spark: SparkSession, d: str) -> DataFrame:
    """What members' events need, and whether their authors may (AU-03)."""
    need = tables.written(authz.required(_acts(spark, d), V.links(spark, d)), "need")
    wanted = need.filter("target is not null").select(F.col("author").alias("principal"), F.col("target").alias("node_id")).distinct()
    return authz.judged(need, _rights(spark, d, wanted), V.device_keys(spark, d)).select("seq", "target", "needed", "verdict")


@query("select 'o' || o_orderkey as id, case when o_orderkey % 2 = 0 then 'o' || o_orderkey when c_custkey % 10 = 0 then 'n' || c_nationkey else 'c' || c_custkey end as ground from orders join customer on c_custkey = o_custkey")
def batch_ground(spark: SparkSession, d: str) -> DataFrame:
    """Where rights on nodes of a batch are judged: every second order and every tenth customer are new (AU-04)."""
    o = table(spark, d, "orders")
    born = o.filter("o_orderkey % 2 <> 0").select(_id("o", "o_orderkey").alias("id"), _id("c", "o_custkey").alias("parent_id"))
    born = born.unionByName(table(spark, d, "customer").filter("c_custkey % 10 = 0").select(_id("c", "c_custkey").alias("id"), _id("n", "c_nationkey").alias("parent_id")))
    return authz.old_ground(o.select(_id("o", "o_orderkey").alias("id")), born)


_ROOTS_SQL = """roots as (select 'top' as log_id, event_id as seq, 'k' || user_id as root, lead(event_id) over (order by event_id) as until from events
 where event_id = 0 or (event_type = 'error' and cast(json_extract_string(props, '$.k') as int) % 10 = 0 and value > 20))"""


def _roots(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int") % 10 == 0
    kind = F.when(F.col("event_id") == 0, "ForestCreated").when((F.col("event_type") == "error") & k, "RootRotated").otherwise("Other")
    return authz.root_lineage(table(spark, d, "events").select(F.lit("top").alias("log_id"), F.col("event_id").alias("seq"), kind.alias("kind"), _id("k", "user_id").alias("key"), (F.col("value") > 20).alias("valid")))


@query(with_sql(_ROOTS_SQL) + "select log_id, seq, root, until from roots")
def root_lineage(spark: SparkSession, d: str) -> DataFrame:
    """The root keys of a forest one after the other (AU-11)."""
    return _roots(spark, d)


@query(
    _rights_sql("select distinct 'k' || user_id as principal, 'root' as node_id from events", _ROOTS_SQL)
    + "select event_id as seq, 'k' || user_id as author, exists (select 1 from effective where principal = 'k' || user_id and rights & 4 <> 0) or exists (select 1 from roots where root = 'k' || user_id and event_id > seq and (until is null or event_id <= until)) as valid from events where event_type in ('signup', 'error')"
)
def device_certificates(spark: SparkSession, d: str) -> DataFrame:
    """Which device certificates were signed by the root of their time or an admin (AU-05)."""
    e = table(spark, d, "events")
    certs = e.filter("event_type in ('signup', 'error')").select(F.col("event_id").alias("seq"), _id("k", "user_id").alias("author"))
    rights = _rights(spark, d, e.select(_id("k", "user_id").alias("principal"), F.lit("root").alias("node_id")).distinct())
    return authz.certified(certs, _roots(spark, d), rights, "root")


# --- folds of a whole log ----------------------------------------------------------------------------------------

#: Kinds that the events table's rows take in turn.
_KINDS = [
    "LinkCreated", "LinkRemoved", "LinkReordered", "LinkSuperseded", "LinkSuspended", "LinkUnsuspended", "NodeMovedIn", "NodeMovedOut", "LinkCreated", "DeviceAuthorized", "DeviceRevoked", "RecoveryKeyRegistered", "RecoveryKeyRevoked",
    "AclSet", "AclSet", "MemberTagged", "NodeCreated", "NodePurged", "FileLocationAdded", "FileLocationRemoved", "FolderBound", "FolderUnbound", "RegionMarked", "RegionUnmarked", "RegionBaseline", "SubRegionHead", "SecureBlobUpdated", "ChunkManifestRecorded", "NodeCreated", "FileLocationAdded", "RegionMarked",
]
_LOG_SQL = (
    "flog as (select event_id as seq, case when event_id in (500, 5000) then 'RootRotated' else (["
    + ", ".join(f"'{x}'" for x in _KINDS)
    + f"""])[1 + (event_id * 11 + u) % {len(_KINDS)}] end as kind, event_id * 10 as at, 'l' || (u % 97) as link_id, case when event_id % 3 = 0 then 'l' || (u % 97 + 100) when event_id % 3 = 1 then 'l' || ((u + 31) % 97) end as other_id,
 'n' || (u % 13) as parent_id, 'n' || (u % 29) as child_id, 'contains' as link_type, 'o' || k as order_key, 'n' || (u % 41) as node_id, 'k' || (u % 53) as pubkey, u % 3 - 1 as device_index, u % 4 as principal_kind, 'p' || (k % 5) as principal_id,
 cast(floor(value) as bigint) % 4 as rights, u * 2 as expires_at, 'k' || (u % 7) as author, 't' || (k % 3) as tag, k % 2 = 0 as granted, 'file:///' || (k % 6) as uri, 'h' || k as root, k as head_seq, 'folder' as node_type, 'label' || k as label
 from (select *, user_id as u, cast(json_extract_string(props, '$.k') as bigint) as k from events))"""
)


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "value", F.col("user_id").alias("u"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    i, u, k = F.col("event_id"), F.col("u"), F.col("k")
    kind = F.when(i.isin(500, 5000), "RootRotated").otherwise(F.element_at(F.array(*map(F.lit, _KINDS)), ((i * 11 + u) % len(_KINDS) + 1).cast("int")))
    other = F.when(i % 3 == 0, _id("l", u % 97 + 100)).when(i % 3 == 1, _id("l", (u + 31) % 97))
    return e.select(
        i.alias("seq"), kind.alias("kind"), (i * 10).alias("at"), _id("l", u % 97).alias("link_id"), other.alias("other_id"), _id("n", u % 13).alias("parent_id"), _id("n", u % 29).alias("child_id"), F.lit("contains").alias("link_type"),
        _id("o", k).alias("order_key"), _id("n", u % 41).alias("node_id"), _id("k", u % 53).alias("pubkey"), (u % 3 - 1).alias("device_index"), (u % 4).alias("principal_kind"), _id("p", k % 5).alias("principal_id"),
        (F.floor("value") % 4).alias("rights"), (u * 2).alias("expires_at"), _id("k", u % 7).alias("author"), _id("t", k % 3).alias("tag"), (k % 2 == 0).alias("granted"), _id("file:///", k % 6).alias("uri"),
        _id("h", k).alias("root"), k.alias("head_seq"), F.lit("folder").alias("node_type"), _id("label", k).alias("label"),
    )


def _fold(sql: str, relation: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return fold.projection(_log(spark, d))[relation]

    run.__name__ = f"fold_{relation}"
    run.__doc__ = f"The relation {relation} that a whole log leaves (FD-01)."
    query(with_sql(_LOG_SQL) + re.sub(r"\bat\b", '"at"', sql))(run)  # a reserved word


_LAST = "(select *, row_number() over (partition by {keys} order by seq desc) as no from flog where kind = '{kind}') where no = 1"
_fold("select pubkey, device_index, authorized_at, (select max(at) from flog r where r.kind = 'DeviceRevoked' and r.pubkey = x.pubkey and r.seq > x.seq) as revoked_at from (select pubkey, device_index, at as authorized_at, seq, row_number() over (partition by pubkey order by seq) as no from flog where kind = 'DeviceAuthorized') x where no = 1", "device_keys")
_fold("select pubkey, min(at) as registered_at from flog f where kind = 'RecoveryKeyRegistered' and seq > coalesce((select max(seq) from flog where kind = 'RootRotated'), -1) and seq > coalesce((select max(seq) from flog r where r.kind = 'RecoveryKeyRevoked' and r.pubkey = f.pubkey), -1) group by pubkey", "recovery_keys")
_fold("select node_id, principal_kind, principal_id, authority, rights, at as set_at, expires_at from (select *, row_number() over (partition by node_id, principal_kind, principal_id, authority order by seq desc) as no from (select *, case when principal_kind = 3 then author else '' end as authority from flog where kind = 'AclSet')) where no = 1 and rights <> 0", "acl")
_fold("select pubkey, tag, author as authority, at as set_at from " + _LAST.format(keys="pubkey, tag, author", kind="MemberTagged") + " and granted", "member_tags")
_fold("select node_id, node_type, label, at as created_at from (select *, row_number() over (partition by node_id order by seq) as no from flog where kind = 'NodeCreated') where no = 1 and node_id not in (select node_id from flog where kind = 'NodePurged')", "nodes")
_fold(
    """, ev as (select seq, kind, link_id, parent_id, child_id, link_type, order_key, at, other_id from flog where kind like 'Link%' or kind like 'NodeMoved%' union all select seq, 'Left', other_id, null, null, null, null, at, null from flog where kind = 'NodeMovedIn' and other_id is not null),
    w as (select *, case when kind = 'LinkCreated' and count(*) filter (kind = 'Left') over b > count(*) filter (kind = 'NodeMovedOut') over b then last_value(case when kind = 'Left' then at end ignore nulls) over b end as late from ev window b as (partition by link_id order by seq, kind rows between unbounded preceding and 1 preceding)),
    made as (select * from (select *, row_number() over (partition by link_id order by seq desc) as no from w where kind in ('LinkCreated', 'NodeMovedIn')) where no = 1)
    select m.link_id, m.parent_id, m.child_id, m.link_type, coalesce(arg_max(w.order_key, w.seq) filter (w.kind = 'LinkReordered'), m.order_key) as order_key, m.at as created_at, coalesce(arg_max(w.at, w.seq) filter (w.kind in ('LinkRemoved', 'NodeMovedOut', 'Left')), m.late) as removed_at,
    nullif(arg_max(coalesce(w.other_id, ''), w.seq) filter (w.kind = 'LinkSuperseded'), '') as superseded_by, nullif(arg_max(case when w.kind = 'LinkSuspended' then w.at else -1 end, w.seq) filter (w.kind in ('LinkSuspended', 'LinkUnsuspended')), -1) as suspended_at
    from made m left join w on w.link_id = m.link_id and w.seq > m.seq group by m.link_id, m.parent_id, m.child_id, m.link_type, m.order_key, m.at, m.late""".replace(", ev as", " select * from (with ev as", 1)
    + ")",
    "links",
)
_fold(
    "select node_id as file_id, uri, max(at) filter (kind = 'FileLocationAdded') as added_at, max(at) filter (kind = 'FileLocationRemoved' and seq > made) as removed_at from (select *, max(seq) filter (kind = 'FileLocationAdded') over (partition by node_id, uri) as made from flog f where kind in ('FileLocationAdded', 'FileLocationRemoved') and seq > coalesce((select max(seq) from flog p where p.kind = 'NodePurged' and p.node_id = f.node_id), -1)) where made is not null group by 1, 2",
    "file_locations",
)
_fold("select node_id as folder_id, uri, at as bound_at, (select max(at) from flog r where r.kind = 'FolderUnbound' and r.node_id = x.node_id and r.seq > x.seq) as unbound_at from " + _LAST.format(keys="node_id", kind="FolderBound").replace(") where", ") x where"), "folder_bindings")
_fold(
    """select node_id, marked_at, case when base > first_seq then base end as baseline_seq, case when base > first_seq then base_root end as state_root, case when head > first_seq and (base is null or head > base) then head_no end as committed_seq, case when head > first_seq and (base is null or head > base) then head_root end as committed_head
    from (select node_id, min(seq) filter (kind = 'RegionMarked') as first_seq, max(at) filter (kind = 'RegionMarked') as marked_at, max(seq) filter (kind = 'RegionBaseline') as base, arg_max(root, seq) filter (kind = 'RegionBaseline') as base_root, max(seq) filter (kind = 'SubRegionHead') as head,
    arg_max(head_seq, seq) filter (kind = 'SubRegionHead') as head_no, arg_max(root, seq) filter (kind = 'SubRegionHead') as head_root from flog f where kind in ('RegionMarked', 'RegionBaseline', 'SubRegionHead') and seq > coalesce((select max(seq) from flog u where u.kind = 'RegionUnmarked' and u.node_id = f.node_id), -1) group by node_id) where first_seq is not null""",
    "regions",
)
_fold("select link_id, min(node_id) as node_id, max(at) as at, min(half) as half from (select link_id, node_id, at, 'out' as half from flog where kind = 'NodeMovedOut' union all select other_id, child_id, at, 'in' from flog where kind = 'NodeMovedIn' and other_id is not null) group by link_id having count(distinct half) = 1", "pending_moves")
_fold("select node_id, root, at, author from " + _LAST.format(keys="node_id", kind="SecureBlobUpdated"), "secure_blobs")
_fold("select node_id, root from " + _LAST.format(keys="node_id", kind="ChunkManifestRecorded"), "chunk_manifests")
_fold("select distinct node_id from flog where kind = 'NodePurged'", "purged_nodes")


@query(with_sql(CHAT_SQL, "judged as (select *, case when length(body) % 13 = 0 then 'too short' when kind = 'system' then 'kind' end as bad from log)") + "select log_id, seq, case when seq > min(case when bad is not null then seq end) over (partition by log_id) then 'stopped' else bad end as error from judged")
def replay_errors(spark: SparkSession, d: str) -> DataFrame:
    """Rows that fail a check, and those that a log doesn't reach after one (FD-02, FD-04)."""
    return fold.replayed(V.chat_log(spark, d), [("too short", F.length("body") % 13 != 0), ("kind", F.col("kind") != "system")]).select("log_id", "seq", "error")


_TREE_SQL = "tree as (select 'top' as log_id, null as parent_log, null::bigint as baseline_seq union all select 'r' || r_regionkey, 'top', 1000 + r_regionkey from region union all select 'n' || n_nationkey, 'r' || n_regionkey, 2000 + n_nationkey from nation), rows as (select case event_id % 3 when 0 then 'top' when 1 then 'r' || (event_id % 5) else 'n' || (event_id % 25) end as log_id, event_id as seq from events)"


@query(
    with_sql(_TREE_SQL)
    + "select r.log_id, r.seq, array_to_string(list_concat(case when a.parent_log is null then [] when b.parent_log is null then [a.baseline_seq] else [b.baseline_seq, a.baseline_seq] end, [r.seq]), '.') as place from rows r join tree a using (log_id) left join tree b on b.log_id = a.parent_log"
)
def replay_places(spark: SparkSession, d: str) -> DataFrame:
    """An order in which a tree of logs is replayed in one go (FD-03)."""
    region = table(spark, d, "region").select(_id("r", "r_regionkey").alias("log_id"), F.lit("top").alias("parent_log"), (F.col("r_regionkey") + 1000).cast("long").alias("baseline_seq"))
    nation = table(spark, d, "nation").select(_id("n", "n_nationkey").alias("log_id"), _id("r", "n_regionkey").alias("parent_log"), (F.col("n_nationkey") + 2000).cast("long").alias("baseline_seq"))
    i = F.col("event_id")
    rows = table(spark, d, "events").select(F.when(i % 3 == 0, "top").when(i % 3 == 1, _id("r", i % 5)).otherwise(_id("n", i % 25)).alias("log_id"), i.alias("seq"))
    return fold.replay_order(rows, region.unionByName(nation)).select("log_id", "seq", F.array_join(F.col("place").cast("array<string>"), ".").alias("place"))


# --- integrity of logs and regions -------------------------------------------------------------------------------

_HASHED_SQL = f"hashed as (select log_id, seq, kind, body, list_reduce(list_prepend('{SEED}', list(concat_ws('|', seq, kind, body)) over (partition by log_id order by seq)), lambda a, x: sha256(concat_ws('|', a, x))) as chain_hash from log)"


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    """The conversations' log with stored hashes; a conversation's few turns are hashed in one row."""
    log = V.chat_log(spark, d)
    rows = log.groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "body"))).alias("x"))
    head = lambda n: F.aggregate(F.slice("x", 1, n), F.lit(SEED), lambda a, r: F.sha2(F.concat_ws("|", a, r["seq"], r["kind"], r["body"]), 256))
    rows = rows.select("log_id", "x", F.posexplode("x").alias("i", "r"))
    return rows.select("log_id", "r.seq", "r.kind", "r.body", head(F.col("i") + 1).alias("chain_hash"))


@query(with_sql(CHAT_SQL, _HASHED_SQL) + "select log_id, seq from hashed where log_id % 10 = 0 and seq = 2 or log_id % 7 = 0 and seq = 3 and log_id % 10 <> 0")
def chain_broken(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose stored hash isn't the step from the row before: some bodies were changed, others' hashes kept (VF-03)."""
    i, seq = F.col("log_id"), F.col("seq")
    changed = ((i % 10 == 0) & (seq == 2)) | ((i % 7 == 0) & (seq == 3) & (i % 10 != 0))
    return verify.broken_links(_hashed(spark, d).withColumn("body", F.when(changed, F.concat("body", F.lit("!"))).otherwise(F.col("body"))), SEED).select("log_id", "seq")


@query(
    with_sql(CHAT_SQL, _HASHED_SQL, "regions as (select log_id, max(seq) - (log_id % 3 = 1)::int + (log_id % 5 = 4)::int as committed_seq from log group by log_id)")
    + "select r.log_id, case when committed_seq > tip then 'short' when r.log_id % 11 = 0 or chain_hash is null then 'differs' when committed_seq < tip then 'open' else 'sealed' end as status from regions r left join (select log_id, max(seq) as tip from log group by log_id) t using (log_id) left join hashed h on h.log_id = r.log_id and h.seq = committed_seq"
)
def region_seals(spark: SparkSession, d: str) -> DataFrame:
    """Committed heads against the logs that are held (VF-06)."""
    log, i = _hashed(spark, d), F.col("log_id")
    at = log.groupBy("log_id").agg(F.max("seq").alias("tip")).withColumn("committed_seq", F.col("tip") - F.when(i % 3 == 1, 1).otherwise(0) + F.when(i % 5 == 4, 1).otherwise(0))
    heads = at.join(log.select("log_id", F.col("seq").alias("committed_seq"), "chain_hash"), ["log_id", "committed_seq"], "left")
    heads = heads.withColumn("committed_head", F.when(i % 11 == 0, "other").otherwise(F.coalesce("chain_hash", F.lit("none"))))
    return verify.seals(heads.select("log_id", "committed_seq", "committed_head"), log)


@cache
def _root_sql() -> str:
    join = lambda h: f"sha256(string_agg({h}, '' order by {h}))"
    line = lambda *c: "concat_ws('|', " + ", ".join(f"coalesce(cast(x.{x} as varchar), '')" for x in c) + ")"
    parts = {
        "nodes": ("nodes", "id", line("id", "node_type", "label")),
        "links": ("links", "parent_id", line("id", "parent_id", "child_id", "link_type", "order_key", "removed", "suspended")),
        "locations": ("(select distinct 'p' || l_partkey as file_id, l_suppkey from lineitem)", "file_id", line("file_id", "l_suppkey")),
        "acl": ("acl", "node_id", line("node_id", "principal_kind", "principal_id", "authority", "rights", "expires_at")),
    }
    rows = " union all ".join(f"select region, '{name}' as section, {text} as line from {source} x join regions m on m.id = x.{node}" for name, (source, node, text) in parts.items())
    low = f"low as (select region, section, h[1:4] as four, {join('h')} as h from (select region, section, sha256(line) as h from parts) group by all)"
    mid = f"mid as (select region, section, four[1:2] as two, {join('four || h')} as h from low group by region, section, four[1:2])"
    one = f"one as (select region, section, {join('two || h')} as root from mid group by region, section)"
    all_ = " || ".join(f"'{name}:' || coalesce(max(root) filter (section = '{name}'), '')" for name in parts)
    return with_sql(NODES_SQL, LINKS_SQL, CONTAINS_SQL, _CLOSURE_SQL, _REGION_SQL, ACL_SQL, f"parts as ({rows})", low, mid, one, f"roots as (select region, sha256({all_}) as root from one group by region)", recursive=True)


def _state_roots(spark: SparkSession, d: str) -> DataFrame:
    marks = table(spark, d, "nation").select(_id("n", "n_nationkey").alias("node"))
    members = graph.region_of(V.nodes(spark, d), V.contains(spark, d), marks)
    links = tables.written(V.links(spark, d), "links")
    held = tables.spread(table(spark, d, "lineitem").select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey").distinct()
    held = tables.written(held.select(_id("p", "l_partkey").alias("file_id"), "l_suppkey"), "held")
    return verify.state_roots(
        {
            "nodes": (V.nodes(spark, d), "id", ["id", "node_type", "label"]), "links": (links, "parent_id", ["id", "parent_id", "child_id", "link_type", "order_key", "removed", "suspended"]),
            "locations": (held, "file_id", ["file_id", "l_suppkey"]), "acl": (V.acl(spark, d), "node_id", ["node_id", "principal_kind", "principal_id", "authority", "rights", "expires_at"]),
        },
        members,
    )


@query(_root_sql() + "select region, root from roots")
def state_root(spark: SparkSession, d: str) -> DataFrame:
    """One hash over all sections of each region's state (AGG-05)."""
    return _state_roots(spark, d)


@query(_root_sql() + "select region, case when region = 'n3' then 'differs' else 'ok' end as status from roots union all select 'nowhere', 'unknown'")
def state_commitments(spark: SparkSession, d: str) -> DataFrame:
    """Committed roots against those computed again (VF-05); one was tampered with and one is of no region."""
    found = tables.written(_state_roots(spark, d), "roots")
    said = found.withColumn("root", F.when(F.col("region") == "n3", "tampered").otherwise(F.col("root"))).unionByName(spark.range(1).select(F.lit("nowhere").alias("region"), F.lit("").alias("root")))
    return verify.compared(said, found, "region")


@query("select doc_id as file_id, 1024 as chunk_size, 'root' || doc_id as manifest_root from documents where doc_id % 3 <> 0")
def attested_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Manifests that speak of what a file holds now; every third is of an older content (JN-16)."""
    files = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.sha2("text", 256).alias("content_hash"))
    said = F.when(F.col("file_id") % 3 == 0, "old").otherwise(F.col("content_hash"))
    return verify.attested(files.select("file_id", said.alias("content_hash"), F.lit(1024).alias("chunk_size"), _id("root", "file_id").alias("manifest_root")), files)


@query(
    f"with p as (select '{S.pi_hex()}' as pi), b as (select event_id as position, props as bundle, case when event_id % 9 = 0 then sha256(props || ' ') else sha256(props) end as h, case when event_id % 10 = 0 then repeat('0', 32) else pi[event_id * 32 % 992 + 1:event_id * 32 % 992 + 32] end as c, pi from events, p) "
    "select position, status, case when status <> 'ok' then 'reject' when position % 4 = 0 then 'skip' else 'write' end as action from (select position, case when h <> sha256(bundle) then 'bad hash' when c <> pi[position * 32 % 992 + 1:position * 32 % 992 + 32] then 'bad checkpoint' else 'ok' end as status from b)"
)
def bundle_imports(spark: SparkSession, d: str) -> DataFrame:
    """Bundles that verify and aren't known yet (VF-10, RD-18, FN-20)."""
    i, digits = F.col("position"), S.pi_hex()
    rows = table(spark, d, "events").select(F.col("event_id").alias("position"), F.col("props").alias("bundle"))
    rows = rows.withColumn("sha256", F.when(i % 9 == 0, F.sha2(F.concat("bundle", F.lit(" ")), 256)).otherwise(F.sha2("bundle", 256)))
    rows = rows.withColumn("checkpoint", F.when(i % 10 == 0, "0" * 32).otherwise(S.checkpoint(i, digits)))
    return verify.importable(rows, rows.filter(i % 4 == 0), "position", digits).select("position", "status", "action")


# --- routing -----------------------------------------------------------------------------------------------------


@query(
    with_sql(NODES_SQL, LINKS_SQL, CONTAINS_SQL, _CLOSURE_SQL, _REGION_SQL, _ACTS_SQL, recursive=True)
    + """, sent as (select a.*, case when kind in ('LinkCreated', 'NodeMovedIn') and a.parent_id is not null then a.parent_id when kind in ('LinkCreated', 'LinkRemoved', 'NodeMovedOut') then coalesce(l.parent_id, l.child_id, node_id) else node_id end as place from acts a left join links l on l.id = a.link_id)
    select seq, case when kind <> 'RegionMarked' and place like 'n%' then place else coalesce(case when kind = 'RegionMarked' and place like 'n%' then 'top' end, region, 'top') end as log_id from sent left join regions on id = place""".replace(", sent as", "select * from (with sent as", 1)
    + ")"
)
def event_routes(spark: SparkSession, d: str) -> DataFrame:
    """The log that takes each event, nations being regions (SNK-02)."""
    marks = table(spark, d, "nation").select(_id("n", "n_nationkey").alias("node"))
    members = graph.region_of(V.nodes(spark, d), V.contains(spark, d), marks)
    return reconcile.routed(_acts(spark, d), members, V.links(spark, d), marks.select(F.col("node").alias("node_id"), F.lit("top").alias("enclosing"))).select("seq", "log_id")
