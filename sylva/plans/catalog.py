"""The registered queries over the source tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import authz, fold, graph, intervals, media, reconcile, verify
from ..sources.tables import batch_cut, log_range, log_tips, table
from ..streaming import twins
from . import forest as V
from .forest import ACL_SQL, AS_OF, CHAT_SQL, CONTAINS_SQL, EVENTS_SQL, KEYS_SQL, LINKS_SQL, NODES_SQL, TAGS_SQL, with_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
SEED = "0" * 64


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


# --- hierarchy ---------------------------------------------------------------------------------------------------

_LIVE_SQL = "live as (select l.* from links l join nodes on l.child_id = nodes.id where not removed and not suspended)"
_WALK_SQL = """walk as (select 'root' as id, 0 as depth, 'contains' as link_type, '' as sort_path
 union all select l.child_id, w.depth + 1, l.link_type, w.sort_path || '/' || l.order_key || '/' || l.child_id from walk w join live l on l.parent_id = w.id where w.link_type = 'contains' {})"""


@query(with_sql(NODES_SQL, LINKS_SQL, _LIVE_SQL, _WALK_SQL.format(""), recursive=True) + "select id, depth, link_type, sort_path from walk")
def forest_walk(spark: SparkSession, d: str) -> DataFrame:
    return graph.walk(V.nodes(spark, d), V.links(spark, d), "root")


@query(with_sql(NODES_SQL, LINKS_SQL, _LIVE_SQL, _WALK_SQL.format("and w.depth < 2"), recursive=True) + "select id, depth, link_type, sort_path from walk")
def forest_walk_bounded(spark: SparkSession, d: str) -> DataFrame:
    return graph.walk(V.nodes(spark, d), V.links(spark, d), "root", most_depth=2)


@query(with_sql(NODES_SQL, LINKS_SQL) + "select parent_id, child_id, link_type, node_type, label, order_key, row_number() over (partition by parent_id order by order_key, child_id) as position from links join nodes on child_id = nodes.id where not removed and not suspended")
def children_ordered(spark: SparkSession, d: str) -> DataFrame:
    return graph.children(V.nodes(spark, d), V.links(spark, d))


@query(with_sql(LINKS_SQL) + "select child_id, count(*) as inbound, count(*) filter (not suspended) as shown, max(order_key) as last_key from links where not removed group by child_id")
def inbound_counts(spark: SparkSession, d: str) -> DataFrame:
    """Suspended links count, but aren't shown (AGG-01, AGG-02, T-01)."""
    return V.links(spark, d).filter("not removed").groupBy("child_id").agg(F.count("*").alias("inbound"), F.count(F.when(~F.col("suspended"), 1)).alias("shown"), F.max("order_key").alias("last_key"))


_CLOSURE_SQL = "closure as (select child_id as node, parent_id as ancestor, 1 as distance from contains_ union all select c.node, l.parent_id, c.distance + 1 from closure c join contains_ l on l.child_id = c.ancestor)"


def _closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.ancestors(V.contains(spark, d))


@query(with_sql(LINKS_SQL, CONTAINS_SQL, _CLOSURE_SQL, recursive=True) + "select node, ancestor, distance from closure")
def ancestors_closure(spark: SparkSession, d: str) -> DataFrame:
    return _closure(spark, d)


_PATHS_SQL = "up as (select node, string_agg(label, '/' order by distance desc) as above from closure join nodes on id = ancestor group by node), paths as (select id, case when above is null then label else above || '/' || label end as path from nodes left join up on node = id)"


@query(with_sql(NODES_SQL, LINKS_SQL, CONTAINS_SQL, _CLOSURE_SQL, _PATHS_SQL, recursive=True) + "select id, path from paths")
def node_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.paths(V.nodes(spark, d), V.contains(spark, d))


_LOOKUPS_SQL = """lookups as (select '/' || r_name || '/' || n_name as path from nation join region on r_regionkey = n_regionkey
 union all select r_name || '/' || n_name || '/' || c_name from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey
 union all select 'parts/' || p_name from part where p_size < 5 union all select n_name from nation union all select '' from region)"""


@query(
    with_sql(
        NODES_SQL, LINKS_SQL, _LIVE_SQL, _LOOKUPS_SQL,
        "split as (select distinct path, list_filter(string_split(path, '/'), lambda x: x <> '') as parts from lookups)",
        "best as (select parent_id, label, arg_min(child_id, (link_type <> 'contains', order_key, child_id)) as child from live join nodes on nodes.id = child_id group by all)",
        "steps as (select path, parts, 0 as n, 'root' as id from split union all select path, parts, n + 1, child from steps join best on parent_id = id and label = parts[n + 1])",
        recursive=True,
    )
    + "select split.path, id from split left join steps on steps.path = split.path and n = len(split.parts)"
)
def path_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The nodes that paths of labels lead to, by segments (GR-06); some lead nowhere."""
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    nation = table(spark, d, "nation").join(region, "n_regionkey")
    customer = table(spark, d, "customer").join(nation.withColumn("c_nationkey", F.col("n_nationkey")), "c_nationkey")
    part = table(spark, d, "part").filter("p_size < 5")
    lookups = nation.select(F.concat(F.lit("/"), F.concat_ws("/", "r_name", "n_name")).alias("path"))
    for more in (customer.select(F.concat_ws("/", "r_name", "n_name", "c_name")), part.select(F.concat(F.lit("parts/"), "p_name")), nation.select("n_name"), region.select(F.lit(""))):
        lookups = lookups.union(more)
    return graph.resolved(lookups, V.nodes(spark, d), V.links(spark, d), "root")


@query(with_sql(NODES_SQL, LINKS_SQL) + "select id, node_type, label from nodes where id not in (select child_id from links where not removed)")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    return graph.orphans(V.nodes(spark, d), V.links(spark, d))


@query(
    with_sql(LINKS_SQL, CONTAINS_SQL, _CLOSURE_SQL, recursive=True)
    + "select child, new_parent, coalesce(distance, 0) as distance, case when distance = 1 then [new_parent, child] else (select list_prepend(new_parent, list(c.ancestor order by c.distance)) from closure c where c.node = new_parent and c.distance <= closure.distance) end as path from (select distinct 'n' || c_nationkey as child, 'c' || c_custkey as new_parent from customer union all select 'c' || o_custkey, 'o' || o_orderkey from orders union all select 'r' || n_regionkey, 'c' || c_custkey from customer join nation on n_nationkey = c_nationkey union all select 's' || s_suppkey, 'n' || s_nationkey from supplier) m left join closure on node = new_parent and ancestor = child where child = new_parent or distance is not null"
)
def cycle_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Proposed moves under one's own descendants: nations and regions into customers, customers into orders, suppliers into nations (GR-08)."""
    pair = lambda name, a, ka, b, kb: table(spark, d, name).select(F.concat(F.lit(a), F.col(ka).cast("string")).alias("child"), F.concat(F.lit(b), F.col(kb).cast("string")).alias("new_parent"))
    moves = pair("customer", "n", "c_nationkey", "c", "c_custkey").unionByName(pair("orders", "c", "o_custkey", "o", "o_orderkey")).unionByName(pair("supplier", "s", "s_suppkey", "n", "s_nationkey"))
    far = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    moves = moves.unionByName(far.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("child"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("new_parent")))
    return graph.would_cycle(moves, _closure(spark, d))


_REGION_SQL = "own as (select id, id as node, 0 as distance from nodes union all select node, ancestor, distance from closure), near as (select id, arg_min(node, distance) as region from own where node in (select 'n' || n_nationkey from nation) group by id), regions as (select nodes.id, coalesce(region, 'top') as region from nodes left join near using (id))"


def _region_of(spark: SparkSession, d: str) -> DataFrame:
    marks = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    return graph.region_of(V.nodes(spark, d), V.contains(spark, d), marks)


@query(with_sql(NODES_SQL, LINKS_SQL, CONTAINS_SQL, _CLOSURE_SQL, _REGION_SQL, recursive=True) + "select id, region from regions")
def region_of_node(spark: SparkSession, d: str) -> DataFrame:
    return _region_of(spark, d)


@query(with_sql(NODES_SQL, LINKS_SQL, CONTAINS_SQL, _CLOSURE_SQL, _REGION_SQL, recursive=True) + "select region, count(*) as n_nodes from regions group by region")
def region_closure_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _region_of(spark, d).groupBy("region").agg(F.count("*").alias("n_nodes"))


@query(
    with_sql(
        LINKS_SQL, CONTAINS_SQL, _CLOSURE_SQL, "roots as (select 'n' || n_nationkey as root from nation where n_nationkey < 5 union all select 'parts')",
        "files as (select distinct node as id, ancestor as root from closure where ancestor in (select root from roots) and (node[1] = 'p' and node <> 'parts' or node[1] = 'o'))",
        "held as (select 'p' || l_partkey as id from lineitem where l_returnflag = 'N' and l_quantity > 45 union select 'o' || l_orderkey from lineitem where l_linestatus = 'O')",
        recursive=True,
    )
    + "select id, root from files where id not in (select id from held)"
)
def missing_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Files in the closure of placed roots, references aside, that have no readable location (GR-13, RC-07)."""
    name = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    roots = table(spark, d, "nation").filter("n_nationkey < 5").select(name("n", "n_nationkey").alias("ancestor"))
    roots = roots.unionByName(spark.range(1).select(F.lit("parts").alias("ancestor")))
    files = _closure(spark, d).join(roots, "ancestor", "left_semi").filter("node like 'o%' or (node like 'p%' and node <> 'parts')").select(F.col("node").alias("id"), F.col("ancestor").alias("root")).distinct()
    lines = table(spark, d, "lineitem")
    held = lines.filter("l_returnflag = 'N' and l_quantity > 45").select(name("p", "l_partkey").alias("file_id")).unionByName(lines.filter("l_linestatus = 'O'").select(name("o", "l_orderkey").alias("file_id")))
    return reconcile.missing_bytes(files.withColumnRenamed("id", "file_id"), held.distinct()).select(F.col("file_id").alias("id"), "root")


_NEXT_SQL = "edges as (select o_orderkey as node, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as next from orders)"


@query(with_sql(_NEXT_SQL, "chain as (select node, node as head, 0::bigint as position from edges where node not in (select next from edges where next is not null) union all select e.next, c.head, c.position + 1 from chain c join edges e on e.node = c.node where e.next is not null)", recursive=True) + "select node, head, position from chain")
def supersede_chain(spark: SparkSession, d: str) -> DataFrame:
    """Each order's place in its customer's chain, by following next pointers (GR-20, JN-04, ORD-04)."""
    follows = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return graph.chains(table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), follows.alias("next")))


# --- fold --------------------------------------------------------------------------------------------------------


@query(with_sql(EVENTS_SQL) + "select entity, max(seq) as seq, arg_max(kind, seq) as kind, arg_max(value, seq) as value from log group by entity")
def fold_lww(spark: SparkSession, d: str) -> DataFrame:
    return fold.last_wins(V.event_log(spark, d), ["entity"], ["kind", "value"])


@query(with_sql(EVENTS_SQL) + "select entity, min(seq) as seq, arg_min(at_ms, seq) as at_ms, arg_min(value, seq) as value from log where kind = 'DeviceAuthorized' group by entity")
def fold_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    return fold.first_wins(V.event_log(spark, d).filter("kind = 'DeviceAuthorized'"), ["entity"], ["at_ms", "value"])


@query(with_sql(EVENTS_SQL) + "select entity, field, max(seq) filter (kind = 'LinkCreated') as seq, arg_max(value, seq) filter (kind = 'LinkCreated') as value, coalesce(max(seq) filter (kind = 'LinkCreated') > max(seq) filter (kind = 'Revoked'), true) as active from log where kind in ('LinkCreated', 'Revoked') group by entity, field having max(seq) filter (kind = 'LinkCreated') is not null")
def fold_reactivate(spark: SparkSession, d: str) -> DataFrame:
    return fold.reactivated(V.event_log(spark, d), "LinkCreated", "Revoked", ["entity", "field"], ["value"])


@query(with_sql(EVENTS_SQL) + "select * from (select entity, field, max(seq) as seq, arg_max(cast(floor(value) as int) % 4, seq) as rights from log where kind = 'AclSet' group by entity, field) where rights <> 0")
def fold_delete_on_zero(spark: SparkSession, d: str) -> DataFrame:
    return fold.deleted_on_zero(V.event_log(spark, d).filter("kind = 'AclSet'"), ["entity", "field"], (F.floor("value") % 4).cast("int"))


@query(with_sql(EVENTS_SQL) + "select entity, field, min(seq) as seq, arg_min(value, seq) as value from log where kind = 'NodeCreated' and (entity, field) not in (select (entity, field) from log where kind = 'Revoked') group by entity, field")
def fold_tombstone(spark: SparkSession, d: str) -> DataFrame:
    log = V.event_log(spark, d)
    made = fold.first_wins(log.filter("kind = 'NodeCreated'"), ["entity", "field"], ["value"])
    return fold.without_purged(made, log.filter("kind = 'Revoked'"), ["entity", "field"])


@query(with_sql(EVENTS_SQL) + "select seq, entity, value from log where kind = 'DeviceAuthorized' and seq > coalesce((select max(seq) from log where kind = 'Revoked' and field = 0), -1)")
def fold_global_reset(spark: SparkSession, d: str) -> DataFrame:
    return fold.since_reset(V.event_log(spark, d), "DeviceAuthorized", (F.col("kind") == "Revoked") & (F.col("field") == 0)).select("seq", "entity", "value")


@query(with_sql(EVENTS_SQL) + "select entity, field, count(*) filter (kind = 'NodeCreated') as n_out, count(*) filter (kind = 'LinkCreated') as n_in, bool_or(kind = 'NodeCreated') and bool_or(kind = 'LinkCreated') as complete from log where kind in ('NodeCreated', 'LinkCreated') group by entity, field")
def fold_pairing(spark: SparkSession, d: str) -> DataFrame:
    return fold.pairs(V.event_log(spark, d), "NodeCreated", "LinkCreated", ["entity", "field"])


@query(with_sql(CHAT_SQL) + "select log_id, max(seq) as seq, count(*) as n_rows from log group by log_id")
def applied_marks(spark: SparkSession, d: str) -> DataFrame:
    return log_tips(V.chat_log(spark, d))


@query(with_sql(CHAT_SQL) + "select log_id, seq, kind, body from (select *, row_number() over w as no, coalesce(sum(strlen(body)) over (partition by log_id order by seq rows between unbounded preceding and 1 preceding), 0) as before from log window w as (partition by log_id order by seq)) where no <= 5 and before <= 1500")
def log_range_batch(spark: SparkSession, d: str) -> DataFrame:
    """The next batch of every log: at most five rows, cut once the bodies exceed 1,500 bytes (SRC-01, ORD-07)."""
    return batch_cut(V.chat_log(spark, d), 5, 1500)


@query(with_sql(EVENTS_SQL) + "select seq, at_ms, kind, entity from log where seq >= 100 order by seq limit 512")
def log_scan(spark: SparkSession, d: str) -> DataFrame:
    return log_range(V.event_log(spark, d), 100, 512).select("seq", "at_ms", "kind", "entity")


@query(with_sql(CHAT_SQL) + "select coalesce(cast(sum(seq) as double), 0.0::double) as activity, count(*) as n_logs from (select max(seq) as seq from log group by log_id)")
def log_activity(spark: SparkSession, d: str) -> DataFrame:
    """The sum of all logs' tips, as a float: a change detector (SRC-05, T-18)."""
    return log_tips(V.chat_log(spark, d)).agg(F.coalesce(F.sum("seq").cast("double"), F.lit(0.0)).alias("activity"), F.count("*").alias("n_logs"))


@query(with_sql(EVENTS_SQL) + "select kind, seq, after, seq - after - 1 as missing from (select kind, seq, lag(seq) over (partition by kind order by seq) as after from log) where seq > after + 1")
def contiguity_gaps(spark: SparkSession, d: str) -> DataFrame:
    return fold.gaps(V.event_log(spark, d), ["kind"])


# --- verification ------------------------------------------------------------------------------------------------


@query(with_sql(CHAT_SQL) + f"select log_id, count(*) as n, list_reduce(list_prepend('{SEED}', list(concat_ws('|', seq, kind, body) order by seq)), lambda a, x: sha256(concat_ws('|', a, x))) as head from log group by log_id")
def chain_verify(spark: SparkSession, d: str) -> DataFrame:
    return verify.chain_heads(V.chat_log(spark, d), SEED)


_CHUNK = 1024


@query(f"select doc_id, n::int as chunk, length(text[n * {_CHUNK} + 1:(n + 1) * {_CHUNK}])::int as length, sha256(text[n * {_CHUNK} + 1:(n + 1) * {_CHUNK}]) as hash from (select doc_id, text, unnest(range(0, cast(ceil(length(text) / {_CHUNK}.0) as bigint))) as n from documents)")
def chunk_manifest(spark: SparkSession, d: str) -> DataFrame:
    return verify.chunks(table(spark, d, "documents"), "doc_id", "text", _CHUNK)


@query(f"select doc_id, cast(ceil(length(text) / {_CHUNK}.0) as int) as n_chunks, sha256(coalesce(list_aggregate(list_transform(range(0, cast(ceil(length(text) / {_CHUNK}.0) as bigint)), lambda n: sha256(text[n * {_CHUNK} + 1:(n + 1) * {_CHUNK}])), 'string_agg', ''), '')) as root from documents")
def manifest_root(spark: SparkSession, d: str) -> DataFrame:
    return verify.manifest_roots(table(spark, d, "documents"), "doc_id", "text", _CHUNK)


@query(
    with_sql(
        NODES_SQL, "leaf as (select node_type, sha256(concat_ws('|', id, label)) as h from nodes)",
        "low as (select node_type, h[1:4] as four, count(*) as n, sha256(string_agg(h, '' order by h)) as h from leaf group by all)",
        "mid as (select node_type, four[1:2] as two, sum(n) as n, sha256(string_agg(four || h, '' order by four || h)) as h from low group by node_type, four[1:2])",
    )
    + "select node_type, cast(sum(n) as bigint) as n, sha256(string_agg(two || h, '' order by two || h)) as root from mid group by node_type"
)
def state_root_sections(spark: SparkSession, d: str) -> DataFrame:
    return verify.commitment(V.nodes(spark, d), "node_type", F.concat_ws("|", "id", "label"))


@query("select sha256(text) as hash, count(*) as n, min(doc_id) as first from documents group by 1 having count(*) > 1")
def content_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return verify.duplicates(table(spark, d, "documents"), "doc_id", "text")


_HELD_SQL = """files as (select doc_id as file_id, case when doc_id % 11 = 0 then '' else sha256(text) end as content_hash from documents),
locations as (select doc_id as file_id, 'file:///' || doc_id as uri from documents union all select doc_id, 'copy:///' || doc_id from documents where doc_id % 2 = 0),
stored as (select 'file:///' || doc_id as uri, case when doc_id % 7 = 0 then text || '!' else text end as content from documents where doc_id % 5 <> 0 union all select 'copy:///' || doc_id, text from documents)"""


@query(
    with_sql(_HELD_SQL)
    + "select file_id, uri, status, case status when 'Ok' then 'lift' when 'Mismatch' then 'quarantine' end as action from (select file_id, l.uri, case when content_hash = '' then 'Unhashed' when s.uri is null then 'Missing' when sha256(content) = content_hash then 'Ok' else 'Mismatch' end as status from locations l join files using (file_id) left join stored s on s.uri = l.uri)"
)
def content_verify(spark: SparkSession, d: str) -> DataFrame:
    """Each location's contents against the hash of the file that it should hold (VF-08, RD-17)."""
    docs, key = table(spark, d, "documents"), F.col("doc_id").cast("string")
    files = docs.select(F.col("doc_id").alias("file_id"), F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.sha2("text", 256)).alias("content_hash"))
    at = lambda scheme, df: df.select(F.col("doc_id").alias("file_id"), F.concat(F.lit(scheme), key).alias("uri"))
    places = at("file:///", docs).unionByName(at("copy:///", docs.filter("doc_id % 2 = 0")))
    stored = docs.filter("doc_id % 5 <> 0").select(F.concat(F.lit("file:///"), key).alias("uri"), F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return verify.location_checks(places, files, stored.unionByName(docs.select(F.concat(F.lit("copy:///"), key).alias("uri"), F.col("text").alias("content"))))


# --- authorization -----------------------------------------------------------------------------------------------

_STANDING_SQL = "standing as (select pubkey, case when revoked_at is not null then 'revoked' when device_index = -1 then 'member' else 'owner' end as standing from device_keys)"


@query(with_sql(KEYS_SQL, _STANDING_SQL) + "select pubkey, standing from standing")
def key_standing(spark: SparkSession, d: str) -> DataFrame:
    return authz.standing(V.device_keys(spark, d))


@query(with_sql(KEYS_SQL) + f"select pubkey, authorized_at, revoked_at from device_keys where authorized_at <= {AS_OF // 2} and (revoked_at is null or revoked_at > {AS_OF // 2})")
def author_active_asof(spark: SparkSession, d: str) -> DataFrame:
    return authz.active_at(V.device_keys(spark, d), AS_OF // 2).select("pubkey", "authorized_at", "revoked_at")


_RIGHTS_SQL = f"""pairs as (select 'k' || o_custkey as principal, 'o' || o_orderkey as node_id from orders),
reach as (select principal, node_id, at_, coalesce(standing, 'never') as standing from (select p.*, p.node_id as at_ from pairs p union all select p.*, ancestor from pairs p join closure on node = p.node_id) r left join standing on pubkey = principal),
grants as (select * from acl where expires_at = 0 or expires_at > {AS_OF}),
alive as (select pubkey from standing where standing <> 'revoked'),
hits as (select principal, r.node_id, rights from reach r join grants g on g.node_id = at_ where principal_kind = 2 or (principal_kind = 0 and standing = 'member') or (principal_kind = 1 and principal_id = principal and standing <> 'revoked')
 union all select r.principal, r.node_id, g.rights from reach r join member_tags t on t.member = r.principal join grants g on g.node_id = at_ and principal_kind = 3 and g.principal_id = t.tag and g.authority = t.authority where standing = 'member' and t.authority in (from alive)),
granted as (select principal, node_id, bit_or(rights) as rights from hits group by all),
effective as (select p.principal, p.node_id, case when standing = 'owner' then 7 else coalesce(rights, 0) end as rights from pairs p left join granted using (principal, node_id) left join standing on pubkey = p.principal)"""
_RIGHTS = with_sql(LINKS_SQL, CONTAINS_SQL, _CLOSURE_SQL, KEYS_SQL, TAGS_SQL, ACL_SQL, _STANDING_SQL, _RIGHTS_SQL, recursive=True)


def _rights(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "orders").select(F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("principal"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node_id"))
    return authz.effective_rights(pairs, _closure(spark, d), V.acl(spark, d), V.device_keys(spark, d), V.member_tags(spark, d), AS_OF)


@query(_RIGHTS + "select principal, node_id, rights from effective")
def effective_rights(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's key on every order of the customer (AU-01, AGG-03)."""
    return _rights(spark, d)


@query(_RIGHTS + "select principal, count(*) filter (rights & 1 <> 0) as readable, count(*) as n from effective group by principal")
def readable_children(spark: SparkSession, d: str) -> DataFrame:
    """How many of a customer's orders its key may read (AU-06)."""
    return _rights(spark, d).groupBy("principal").agg(F.count(F.when(F.col("rights").bitwiseAND(1) != 0, 1)).alias("readable"), F.count("*").alias("n"))


def _audit(spark: SparkSession, d: str, name: str) -> DataFrame:
    return authz.audit(V.acl(spark, d), V.device_keys(spark, d), V.member_tags(spark, d), AS_OF)[name]


_ALIVE_SQL = "(select pubkey from device_keys where revoked_at is null)"


@query(with_sql(KEYS_SQL, ACL_SQL) + f"select node_id, principal_id, authority, rights from acl where principal_kind = 3 and authority not in {_ALIVE_SQL}")
def audit_inert_tag_grants(spark: SparkSession, d: str) -> DataFrame:
    return _audit(spark, d, "inert_tag_grants").select("node_id", "principal_id", "authority", "rights")


@query(with_sql(KEYS_SQL, TAGS_SQL) + f"select member, tag, authority from member_tags where authority not in {_ALIVE_SQL}")
def audit_inert_memberships(spark: SparkSession, d: str) -> DataFrame:
    return _audit(spark, d, "inert_memberships").select("member", "tag", "authority")


@query(with_sql(KEYS_SQL, ACL_SQL) + f"select node_id, principal_id, rights from acl where principal_kind = 1 and principal_id in (select pubkey from device_keys) and principal_id not in {_ALIVE_SQL}")
def audit_inert_key_grants(spark: SparkSession, d: str) -> DataFrame:
    return _audit(spark, d, "inert_key_grants").select("node_id", "principal_id", "rights")


@query(with_sql(ACL_SQL) + f"select node_id, principal_kind, principal_id, expires_at from acl where expires_at <> 0 and expires_at <= {AS_OF}")
def audit_expired(spark: SparkSession, d: str) -> DataFrame:
    return _audit(spark, d, "expired").select("node_id", "principal_kind", "principal_id", "expires_at")


@query(with_sql(TAGS_SQL, ACL_SQL) + "select 'member' as kind, member as subject, tag, 'k500' as authority, 0 as rights from member_tags where authority = 'k11' union all select 'grant', node_id, principal_id, 'k500', rights from acl where principal_kind = 3 and authority = 'k11'")
def reissue_authority(spark: SparkSession, d: str) -> DataFrame:
    return authz.reissued(V.acl(spark, d), V.member_tags(spark, d), "k11", "k500")


# --- intervals ---------------------------------------------------------------------------------------------------

_RANGES_SQL = "ranges as (select user_id, event_id as start, event_id + 1 + cast(floor(value / 2) as bigint) as \"end\" from events)"
_ISLANDS_SQL = _RANGES_SQL + """, marked as (select *, case when start <= max("end") over (partition by user_id order by start, "end" rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from ranges),
numbered as (select *, sum(fresh) over (partition by user_id order by start, "end" rows unbounded preceding) as no from marked), islands as (select user_id, min(start) as start, max("end") as "end" from numbered group by user_id, no)"""


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + 1 + F.floor(F.col("value") / 2)).alias("end"))


@query(with_sql(_ISLANDS_SQL) + 'select user_id, start, "end" from islands')
def interval_islands(spark: SparkSession, d: str) -> DataFrame:
    return intervals.islands(_ranges(spark, d), "user_id")


@query(with_sql(_ISLANDS_SQL) + 'select user_id, unnest(range(cast(ceil(start / 8.0) as bigint), cast(floor("end" / 8.0) as bigint))) as chunk from islands')
def chunk_coverage(spark: SparkSession, d: str) -> DataFrame:
    return intervals.covered_chunks(intervals.islands(_ranges(spark, d), "user_id"), "user_id", 8)


@query(with_sql(_ISLANDS_SQL) + 'select user_id, count(*) as n_ranges, cast(sum("end" - start) as bigint) as verified, cast(sum(greatest(0, cast(floor("end" / 8.0) as bigint) - cast(ceil(start / 8.0) as bigint))) as bigint) as chunks_done from islands group by user_id')
def ingest_progress(spark: SparkSession, d: str) -> DataFrame:
    return intervals.progress(intervals.islands(_ranges(spark, d), "user_id"), "user_id", 8)


# --- reconciliation ----------------------------------------------------------------------------------------------

_SCAN_SQL = "seen as (select page_id as key, length(html) % 5 as size from pages where length(html) % 3 <> 0), known as (select doc_id as key, n_chars % 5 as size, n_chars % 4 = 0 as removed from documents where lang <> 'fr')"
_SCAN_SQL += ", diff as (select coalesce(s.key, k.key) as key, case when k.key is null then 'added' when s.key is null then case when removed then 'gone' else 'removed' end when removed then 'reactivated' when s.size <> k.size then 'changed' else 'unchanged' end as action from seen s full join known k on s.key = k.key)"


def _scan(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "pages").filter(F.length("html") % 3 != 0).select(F.col("page_id").alias("key"), (F.length("html") % 5).alias("size"))
    known = table(spark, d, "documents").filter("lang <> 'fr'").select(F.col("doc_id").alias("key"), (F.col("n_chars") % 5).alias("size"), (F.col("n_chars") % 4 == 0).alias("removed"))
    return reconcile.scan_diff(seen, known, "key")


@query(with_sql(_SCAN_SQL) + "select key, action from diff")
def scan_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d)


@query(with_sql(_SCAN_SQL) + "select action, count(*) as n from diff group by action")
def scan_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts by action (AGG-04)."""
    return _scan(spark, d).groupBy("action").agg(F.count("*").alias("n"))


@query("select event_id, coalesce(c_name, '?') as label, event_type from events left join customer on c_custkey = user_id and c_acctbal > 0 where event_type = 'error'")
def pending_changes(spark: SparkSession, d: str) -> DataFrame:
    """Pending changes with their node's label, ? where there is none (JN-03)."""
    names = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), "c_name")
    out = table(spark, d, "events").filter("event_type = 'error'").join(names, "user_id", "left")
    return out.select("event_id", F.coalesce("c_name", F.lit("?")).alias("label"), "event_type")


@query("select 's' || s_suppkey as folder_id, case when r_name = 'AFRICA' then 'mirror' when r_name = 'ASIA' then 'migrate' else 'in-place' end as kind from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey where s_suppkey % 10 <> 0")
def binding_kind(spark: SparkSession, d: str) -> DataFrame:
    """Active bindings by their placement: kept, central or none (JN-12, RC-05)."""
    at = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    at = at.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("folder_id"), (F.col("s_suppkey") % 10 == 0).alias("unbound"), "r_name")
    mode = F.when(F.col("r_name") == "AFRICA", "central-keep").when(F.col("r_name") == "ASIA", "central").otherwise("sync")
    return reconcile.binding_kinds(at, at.select(F.col("folder_id").alias("root"), mode.alias("mode"))).select("folder_id", "kind")


_HOST = "regexp_extract(url, '^[a-z]+://[^/?#]*', 0)"


@query(
    with_sql(f"bound as (select {_HOST} as source, 'host' as policy from pages group by 1 having count(*) > 1 union all select {_HOST} || '/en', 'language' from pages group by 1 having count(*) > 2)")
    + "select page_id, coalesce(arg_max(policy, length(source)), 'lazy') as policy from pages left join bound on url = source or starts_with(url, source || '/') group by page_id"
)
def binding_policy_for_uri(spark: SparkSession, d: str) -> DataFrame:
    """The policy of the longest binding above each address (FLT-03)."""
    pages = table(spark, d, "pages").select("page_id", "url")
    hosts = pages.groupBy(F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0).alias("source")).agg(F.count("*").alias("n"))
    bound = hosts.filter("n > 1").select("source", F.lit("host").alias("policy")).unionByName(hosts.filter("n > 2").select(F.concat("source", F.lit("/en")).alias("source"), F.lit("language").alias("policy")))
    return reconcile.owner_by_prefix(pages, bound, "url", "lazy").select("page_id", "policy")


_PLACES_SQL = "places as (select l_partkey as file, l_suppkey as location, bool_or(l_returnflag <> 'R') as live, bool_or(l_linestatus = 'O') as attested, any_value(s_nationkey < 5) as central from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2)"


def _places(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("location")).agg(F.max(F.col("l_returnflag") != "R").alias("live"), F.max(F.col("l_linestatus") == "O").alias("attested"))
    return per.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("location"), (F.col("s_nationkey") < 5).alias("central")), "location")


@query(with_sql(_PLACES_SQL) + "select file, location, case when not live then 'retire' when central and attested then 'satisfied' when central then 'attest' else 'migrate' end as action from places")
def tier_actions(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.tier_actions(_places(spark, d))


@query(with_sql(_PLACES_SQL) + "select distinct file, location from places where not live and file in (select file from places where live)")
def evict_actions(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.evictable(_places(spark, d))


@query(with_sql("want as (select distinct l_partkey as file, l_suppkey as location from lineitem where l_returnflag = 'N')", "have as (select distinct l_partkey as file, l_suppkey as location from lineitem where l_linestatus = 'F')") + "select *, 'add' as action from (from want except from have) union all select *, 'retract' from (from have except from want)")
def advertise_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("location"), "l_returnflag", "l_linestatus")
    return reconcile.difference(rows.filter("l_returnflag = 'N'"), rows.filter("l_linestatus = 'F'"), ["file", "location"])


@query(
    "with named as (select p_partkey, p_brand, case when p_partkey % 9 = 1 then repeat(p_name || ' ', 40) else p_name end as name, '~' || left(cast(p_partkey as varchar), 8) as tag from part), "
    "cut as (select *, case when strlen(name) > 240 then left(name, 200) || tag else name end as first from named) "
    "select p_partkey, p_brand, case when row_number() over (partition by p_brand, first order by p_partkey) = 1 then first else first || tag end as export_name from cut"
)
def export_names(spark: SparkSession, d: str) -> DataFrame:
    """Names in a folder, too long and taken ones made unique (SNK-04). No name here equals another one's second choice; tests have such."""
    name = F.when(F.col("p_partkey") % 9 == 1, F.expr("repeat(p_name || ' ', 40)")).otherwise(F.col("p_name"))
    return reconcile.claimed_names(table(spark, d, "part").select("p_partkey", "p_brand", "p_name"), "p_brand", name, "p_partkey").drop("p_name")


@query("select distinct url as path, len(string_split(url, '/')) as depth from pages where url not in (select url from pages where contains(html, 'the '))")
def export_prune_diff(spark: SparkSession, d: str) -> DataFrame:
    """Paths of an earlier manifest that the new one lacks, with their depth, deepest first (SNK-05)."""
    pages = table(spark, d, "pages").withColumn("path", F.col("url"))
    return reconcile.export_prune(pages, pages.filter(F.contains("html", F.lit("the "))))


@query("select l_partkey as file, arg_max(l_suppkey, (l_shipdate, l_orderkey, l_linenumber, l_suppkey)) as location from lineitem group by l_partkey")
def latest_location(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("file")).agg(F.max_by("l_suppkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")).alias("location"))


@query("select l_partkey as file, min('s' || l_suppkey) as uri from lineitem where l_suppkey not in (select s_suppkey from supplier where s_acctbal < 0) and l_returnflag <> 'R' group by l_partkey")
def first_readable(spark: SparkSession, d: str) -> DataFrame:
    """The lexicographically least readable location, not the newest (ORD-06, T-23)."""
    flagged = table(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    held = table(spark, d, "lineitem").filter("l_returnflag <> 'R'").join(flagged, "l_suppkey", "left_anti")
    return held.groupBy(F.col("l_partkey").alias("file")).agg(F.min(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("uri"))


# --- scored listings and search ----------------------------------------------------------------------------------


@query("select p_partkey, p_name, p_type from part where contains(lower(p_name), 'ring') and p_type = 'PROMO'")
def media_search(spark: SparkSession, d: str) -> DataFrame:
    return media.search(table(spark, d, "part"), "p_name", "Ring", p_type="PROMO").select("p_partkey", "p_name", "p_type")


_QUALITY = ["PROMO", "LARGE", "MEDIUM", "SMALL"]


@query("select p_brand, x.source, x.quality from (select p_brand, min({'r': coalesce(list_position(['PROMO', 'LARGE', 'MEDIUM', 'SMALL'], p_type), 5), 'source': p_partkey, 'quality': p_type}) as x from part group by p_brand)")
def best_source(spark: SparkSession, d: str) -> DataFrame:
    return media.best_source(table(spark, d, "part"), "p_brand", "p_type", "p_partkey", _QUALITY)


@query("select p_partkey, p_name, count(l_suppkey) as n_sources, p_size < 5 as watched from part left join (select distinct l_partkey, l_suppkey from lineitem) on l_partkey = p_partkey group by all")
def watchlist_join(spark: SparkSession, d: str) -> DataFrame:
    """Titles with their number of sources and whether they are watched (JN-18)."""
    sources = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    out = table(spark, d, "part").join(sources, F.col("l_partkey") == F.col("p_partkey"), "left")
    return out.groupBy("p_partkey", "p_name", (F.col("p_size") < 5).alias("watched")).agg(F.count("l_suppkey").alias("n_sources"))


@query("select p_partkey, p_brand, row_number() over (partition by p_brand order by p_retailprice desc, nullif(p_size, 11) asc nulls first, p_partkey) as position from part")
def score_order(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").withColumn("key", F.when(F.col("p_size") != 11, F.col("p_size")))
    return media.by_score(parts, "p_brand", "p_retailprice", "key", "p_partkey").select("p_partkey", "p_brand", "position")


@query("select c_custkey, round(c_acctbal / 10000 - coalesce(0.3 * sum((c_acctbal / 10000 - o_totalprice / 500000) / (1 + o_totalprice / 500000)) filter (o_totalprice / 500000 < c_acctbal / 10000) / sum(1 / (1 + o_totalprice / 500000)) filter (o_totalprice / 500000 < c_acctbal / 10000), 0), 9) as effective from customer left join orders on o_custkey = c_custkey group by c_custkey, c_acctbal")
def effective_score(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 10000).alias("score"))
    anchors = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_totalprice") / 500000).alias("anchor_score"))
    return media.effective_score(rows, "c_custkey", "score", anchors, 0.3).withColumn("effective", F.round("effective", 9))


@query("select event_id, round(case when event_id % 400 - 5 >= 0 then value / 1000 / ln(event_id % 400 - 5 + 1.0::double + 1e-9) end, 3) as rank, round(case when value / 500 < 1 then -ln(1 - value / 500) end, 9) as impossibility from events")
def truth_rank(spark: SparkSession, d: str) -> DataFrame:
    """Freshness-weighted scores and impossibility of confidences (ORD-12, FN-17)."""
    days = F.col("event_id") % 400 - 5
    return table(spark, d, "events").select("event_id", F.round(media.truth_rank(F.col("value") / 1000, days), 3).alias("rank"), F.round(media.impossibility(F.col("value") / 500), 9).alias("impossibility"))


@query("select c_mktsegment, coalesce(round(avg(case when contains(lower('red building of small machinery'), lower(c_mktsegment)) then 1.0::double else 0.0::double end), 3), 0.5::double) as alignment, count(*) as n from customer group by c_mktsegment")
def alignment(spark: SparkSession, d: str) -> DataFrame:
    """The share of rows whose word occurs in a text (FLT-15, AGG-14)."""
    hit = F.contains(F.lit("red building of small machinery"), F.lower("c_mktsegment")).cast("double")
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.coalesce(F.round(F.avg(hit), 3), F.lit(0.5)).alias("alignment"), F.count("*").alias("n"))


@query("select p_partkey, p_brand, age, days from (select p_partkey, p_brand, p_size * 3 as age, coalesce(case when p_type = 'PROMO' then -1 when p_type = 'SMALL' then 60 end, g, 30) as days from part left join (select p_brand, cast(avg(p_size) as int) as g from part group by p_brand having count(*) % 2 = 0) using (p_brand)) where days >= 0 and age > days")
def prune_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Rows older than the policy that applies: their own, their brand's, or 30 days; never where it is -1 (GR-18)."""
    own = F.when(F.col("p_type") == "PROMO", -1).when(F.col("p_type") == "SMALL", 60)
    parts = table(spark, d, "part")
    policies = parts.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.avg("p_size")).cast("int").alias("group_days")).filter("n % 2 = 0")
    rows = parts.select("p_partkey", "p_brand", own.alias("own_days"), (F.col("p_size") * 3).alias("age"))
    return media.prune_candidates(rows, policies, "p_brand", 30)


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50 offset 100")
def paged_listing(spark: SparkSession, d: str) -> DataFrame:
    return media.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 100, 50)


@query("select event_id, user_id, event_type from events order by ts desc, event_id desc limit 50")
def recent_jobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "event_type")


@query("select event_type as section, cast(json_extract_string(props, '$.k') as int) as key, arg_max(value, event_id) as value from events group by all")
def config_map(spark: SparkSession, d: str) -> DataFrame:
    """The last value of each key of each section, as rows (AGG-18, RC-22)."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("section"), F.get_json_object("props", "$.k").cast("int").alias("key"), "event_id", "value")
    return rows.groupBy("section", "key").agg(F.max_by("value", "event_id").alias("value"))


# --- scalar functions --------------------------------------------------------------------------------------------

_NAMES = ["a.MKV", "b.mp4", "c.m4v", "d.avi", "e.mov", "f.mp3", "g.flac", "h.m4a", "i.wav", "j.jpg", "k.jpeg", "l.png", "m.gif", "n.webp", "o.srt", "p.pdf", "q.tar.txt", "r.md", "s.json", "t.xml", "u.html", "v.HTM", "w.zip", "mp4", "noext", "x.unknown", "y."]


@query(
    "with names as (select ["
    + ", ".join(f"'{x}'" for x in _NAMES)
    + """] as n) select event_id, x as extension, case x when 'mkv' then 'video/x-matroska' when 'mp4' then 'video/mp4' when 'm4v' then 'video/mp4' when 'avi' then 'video/x-msvideo' when 'mov' then 'video/quicktime'
 when 'mp3' then 'audio/mpeg' when 'flac' then 'audio/flac' when 'm4a' then 'audio/mp4' when 'wav' then 'audio/wav' when 'jpg' then 'image/jpeg' when 'jpeg' then 'image/jpeg' when 'png' then 'image/png' when 'gif' then 'image/gif'
 when 'webp' then 'image/webp' when 'srt' then 'application/x-subrip' when 'pdf' then 'application/pdf' when 'txt' then 'text/plain' when 'md' then 'text/markdown' when 'json' then 'application/json' when 'xml' then 'application/xml'
 when 'html' then 'text/html' when 'htm' then 'text/html' when 'zip' then 'application/zip' else 'application/octet-stream' end as mime, x in ('mkv', 'txt') as wanted
 from (select event_id, lower(string_split(n[1 + event_id % len(n)], '.')[-1]) as x from events, names)"""
)
def mime_guess(spark: SparkSession, d: str) -> DataFrame:
    """Media types of every known extension and of names without one (FN-06, FLT-04)."""
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % len(_NAMES) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", S.extension(name).alias("extension"), S.guess_mime(name).alias("mime"), S.has_extension(name, F.lit("mkv, txt")).alias("wanted"))


_RIGHTS_TEXTS = ["", "-", "none", "r", "w", "a", "rw", "aw", "rwa", "rrr", "rx", "R", "r w", "nonee"]


@query(
    "select event_id, case k when 0 then '-' else case when k & 1 <> 0 then 'r' else '' end || case when k & 2 <> 0 then 'w' else '' end || case when k & 4 <> 0 then 'a' else '' end end as letters, [0, 0, 0, 1, 2, 4, 3, 6, 7, 1, null, null, null, null][1 + event_id % 14] as bits from (select event_id, cast(json_extract_string(props, '$.k') as int) % 8 as k from events)"
)
def rights_fmt(spark: SparkSession, d: str) -> DataFrame:
    """Rights as letters, and letters as rights, also foreign ones (FN-07)."""
    text = F.element_at(F.array(*map(F.lit, _RIGHTS_TEXTS)), (F.col("event_id") % 14 + 1).cast("int"))
    letters = S.format_rights(F.get_json_object("props", "$.k").cast("int") % 8)
    return table(spark, d, "events").select("event_id", letters.alias("letters"), S.parse_rights(text).alias("bits"))


_WHO = "case c_custkey % 6 when 0 then 'any' when 1 then 'public' when 2 then 'key:' || md5(c_name) when 3 then 'tag:' || lower(c_mktsegment) when 4 then 'tag:Bad Tag' else 'key:xyz' end"


@query(f"select c_custkey, case when who = 'any' then 0 when regexp_matches(who, '^key:[0-9a-f]+$') then 1 when who = 'public' then 2 when regexp_matches(who, '^tag:[a-z0-9][a-z0-9_-]{{0,63}}$') then 3 end as kind, regexp_matches(split_part(who, ':', 2), '^[a-z0-9][a-z0-9_-]{{0,63}}$') as valid from (select c_custkey, {_WHO} as who from customer)")
def principal_parse(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("c_custkey") % 6
    who = F.when(i == 0, "any").when(i == 1, "public").when(i == 2, F.concat(F.lit("key:"), F.md5("c_name"))).when(i == 3, F.concat(F.lit("tag:"), F.lower("c_mktsegment"))).when(i == 4, "tag:Bad Tag").otherwise("key:xyz")
    rows = table(spark, d, "customer").select("c_custkey", who.alias("who"))
    return rows.select("c_custkey", S.principal_kind(F.col("who")).alias("kind"), S.valid_tag(F.split_part("who", F.lit(":"), F.lit(2))).alias("valid"))


_SPANS = ["45s", "30m", "12h", "7d", "2w", "@17", "@0", "9", "", "s", "-1s", "5x", "99999999999999999999s", "9223372036854775807w", "@99999999999999999999", "15250284452w"]


@query("select event_id, [45000, 1800000, 43200000, 604800000, 1209600000, 17, null, null, null, null, null, null, null, null, null, 9223372036569600000][1 + event_id % 16] as ms from events")
def duration_ms(spark: SparkSession, d: str) -> DataFrame:
    """Durations of every unit, malformed ones and ones beyond 64 bits (FN-10)."""
    text = F.element_at(F.array(*map(F.lit, _SPANS)), (F.col("event_id") % len(_SPANS) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", S.duration_ms(text).alias("ms"))


@query(
    r"select page_id, case when clean in ('', '.', '..') then 'node-' || h[1:8] else clean end as name from (select page_id, sha256(url) as h, regexp_replace(regexp_replace(case page_id % 8 when 0 then ' ' when 1 then '.' when 2 then chr(160) || '..' || chr(12288) when 3 then chr(133) || url when 4 then '  ' || url || ' ' else url || chr(10) end, '[/\x00-\x1F\x7F-\x{9F}]', '_', 'g'), '^\p{Z}+|\p{Z}+$', '', 'g') as clean from pages)"
)
def safe_name(spark: SparkSession, d: str) -> DataFrame:
    """Labels as file names: separators, control characters, wide spaces, and names that vanish (FN-12)."""
    i = F.col("page_id") % 8
    name = F.when(i == 0, " ").when(i == 1, ".").when(i == 2, "\u00a0..\u3000").when(i == 3, F.concat(F.lit("\u0085"), "url")).when(i == 4, F.concat(F.lit("  "), "url", F.lit(" "))).otherwise(F.concat("url", F.lit("\n")))
    return table(spark, d, "pages").select("page_id", S.safe_name(name, F.sha2("url", 256)).alias("name"))


@query("select page_id, regexp_extract(url, '^([a-z][a-z0-9+.-]*)://', 1) as scheme, regexp_extract(url, '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1) as host, regexp_extract(url, '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path, len(list_filter(string_split(url, '/'), lambda x: x <> ''))::int as n_segments from pages")
def uri_parts(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", *[c.alias(k) for k, c in S.uri_parts(url).items()], F.size(S.segments(url)).alias("n_segments"))


@query("select doc_id, h[1:2] || '/' || h as shard from (select doc_id, sha256(text) as h from documents)")
def shard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h")).select("doc_id", S.shard(F.col("h")).alias("shard"))


# --- streaming twins ---------------------------------------------------------------------------------------------


@query(with_sql(EVENTS_SQL) + "select kind, count(*) as n, max(seq) as tip from log group by kind")
def stream_tail_counts(spark: SparkSession, d: str) -> DataFrame:
    return twins.tail_counts(spark, d)


@query(with_sql(EVENTS_SQL) + "select entity, max(seq) as seq, arg_max(kind, seq) as kind, arg_max(value, seq) as value from log group by entity")
def stream_fold_lww(spark: SparkSession, d: str) -> DataFrame:
    return twins.fold_last(spark, d)


@query(with_sql(_ISLANDS_SQL) + 'select user_id, start, "end" from islands')
def stream_islands(spark: SparkSession, d: str) -> DataFrame:
    return twins.islands(spark, d)
