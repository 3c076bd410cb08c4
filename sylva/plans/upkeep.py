"""Registered queries of listings, reconciliation, placement, imports and exports, and streams with state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph, intervals, media, reconcile
from ..sources import tables
from ..sources.tables import table
from ..streaming import twins
from . import forest as V
from .access import _LOG_SQL, _id, _log
from .catalog import _CLOSURE_SQL, _LIVE_SQL, _RANGES_SQL, _REGION_SQL, query
from .forest import CHAT_SQL, CONTAINS_SQL, EVENTS_SQL, LINKS_SQL, NODES_SQL, with_sql

_FOREST = with_sql(NODES_SQL, LINKS_SQL)


def _marks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(_id("n", "n_nationkey").alias("node"))


# --- hierarchy ---------------------------------------------------------------------------------------------------


@query(_FOREST + "select child_id, min(id) as link_id, min(parent_id) as parent_id, false as temp from links where link_type = 'contains' and not removed group by child_id union all select 'o' || o_orderkey, 't' || o_orderkey, 'c' || (o_custkey + 1), true from orders where o_orderkey % 3 = 0 and o_orderstatus = 'F'")
def active_homes(spark: SparkSession, d: str) -> DataFrame:
    """Where each node is at home; removed orders may have a temporary home (RD-01)."""
    moved = table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(_id("t", "o_orderkey").alias("id"), _id("c", F.col("o_custkey") + 1).alias("parent_id"), _id("o", "o_orderkey").alias("child_id"), F.lit("contains").alias("link_type"), F.lit(False).alias("removed"))
    return graph.homes(V.links(spark, d), moved)


@query(_FOREST + "select child_id, parent_id, link_type, label from links join nodes on nodes.id = parent_id where not removed and not suspended")
def live_parents(spark: SparkSession, d: str) -> DataFrame:
    """All live parents of every node (GR-21)."""
    return graph.parents(V.nodes(spark, d), V.links(spark, d))


def _with_roots(spark: SparkSession, d: str) -> DataFrame:
    """The forest's links, and links without a parent for nations."""
    none = F.lit(None).cast("string")
    top = table(spark, d, "nation").filter("n_nationkey % 4 = 0").select(_id("top", "n_nationkey").alias("id"), none.alias("parent_id"), _id("n", "n_nationkey").alias("child_id"), F.lit("contains").alias("link_type"), F.lit("").alias("order_key"), (F.col("n_nationkey") % 8 == 0).alias("removed"), F.lit(False).alias("suspended"))
    return V.links(spark, d).unionByName(top)


_TOPS_SQL = "tops as (select * from links union all select 'top' || n_nationkey, null, 'n' || n_nationkey, 'contains', '', n_nationkey % 8 = 0, false from nation where n_nationkey % 4 = 0)"


@query(with_sql(NODES_SQL, LINKS_SQL, _TOPS_SQL) + "select t.id as link_id, nodes.id, label from tops t join nodes on nodes.id = child_id where parent_id is null")
def root_links(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that a link without a parent makes roots (JN-17)."""
    return graph.root_links(V.nodes(spark, d), _with_roots(spark, d))


@query(
    with_sql(NODES_SQL, LINKS_SQL, _TOPS_SQL, "alive as (select * from tops where not removed and not suspended)", "reach as (select child_id as id from alive where parent_id is null union select a.child_id from reach r join alive a on a.parent_id = r.id)", recursive=True)
    + "select id, id in (select id from reach) as valid, case when id in (select child_id from alive where parent_id is null) then 'root' when id in (select id from reach) then 'reached' when id in (select child_id from alive where parent_id is not null) then 'unreached' else 'no parent' end as reason from nodes"
)
def chains_to_root(spark: SparkSession, d: str) -> DataFrame:
    """Whether any chain of live links leads from a node to a root (GR-14)."""
    return graph.rooted(V.nodes(spark, d), _with_roots(spark, d))


@query(with_sql(NODES_SQL, LINKS_SQL, _TOPS_SQL) + "select id, node_type, label from nodes where id not in (select child_id from tops where not removed and not suspended and (parent_id is null or link_type = 'contains'))")
def rootless_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes without a live home and without a link that makes them a root (GR-15)."""
    return graph.rootless(V.nodes(spark, d), _with_roots(spark, d), ["contains"])


_FILES_SQL = "files as (select 'o' || o_orderkey as id, 'file' as node_type, 'order-' || o_orderkey as label, epoch_ms(o_orderdate) as created_at from orders), places as (select distinct 'o' || l_orderkey as file_id, case when l_suppkey % 2 = 0 then 'file:///s' else 'host://pin/s' end || l_suppkey as uri, l_returnflag = 'R' as removed from lineitem)"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(_id("o", "o_orderkey").alias("id"), F.lit("file").alias("node_type"), _id("order-", "o_orderkey").alias("label"), tables.millis(F.col("o_orderdate")).alias("created_at"))


def _file_places(spark: SparkSession, d: str) -> DataFrame:
    scheme = F.when(F.col("l_suppkey") % 2 == 0, "file:///s").otherwise("host://pin/s")
    return table(spark, d, "lineitem").select(_id("o", "l_orderkey").alias("file_id"), F.concat(scheme, F.col("l_suppkey").cast("string")).alias("uri"), (F.col("l_returnflag") == "R").alias("removed")).distinct()


@query(with_sql(LINKS_SQL, _FILES_SQL) + "select id, label, created_at, coalesce((select list(distinct uri order by uri) from places where file_id = id and not removed), []) as uris from files where id not in (select child_id from links where not removed and not suspended)")
def file_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Files without a live parent, and where they lie (GR-16, ORD-10)."""
    return graph.file_orphans(_files(spark, d), V.links(spark, d), _file_places(spark, d))


@query(
    with_sql(LINKS_SQL, "alive as (select distinct parent_id, child_id as id from links where not removed)", "gone as (select distinct 'c' || c_custkey as id, 0 as round from customer where c_custkey % 3 = 0)", "next as (select distinct a.id, 1 as round from alive a where parent_id in (select id from gone) and a.id like 'o%' and not exists (select 1 from alive b where b.id = a.id and b.parent_id not in (select id from gone)))",
             "all_ as (select * from gone union all select * from next)")
    + "select * from all_ union all select distinct a.id, 2 from alive a where a.parent_id in (select id from next) and a.id like 'p%' and not exists (select 1 from alive b where b.id = a.id and b.parent_id not in (select id from all_))"
)
def purge_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Temporary nodes that go with what was purged: customers' orders, and parts that only these refer to (GR-10)."""
    purged = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(_id("c", "c_custkey").alias("id"))
    temp = table(spark, d, "orders").select(_id("o", "o_orderkey").alias("id")).unionByName(table(spark, d, "part").select(_id("p", "p_partkey").alias("id")))
    return graph.purge_cascade(V.links(spark, d), purged, temp)


_GONE_SQL = "gone as (select 'c' || c_custkey as id from customer where c_custkey % 20 = 0 union all select 'o' || o_orderkey from orders where o_orderkey % 50 = 0), held as (select * from links where not removed)"


@query(
    with_sql(NODES_SQL, LINKS_SQL, _FILES_SQL, _GONE_SQL)
    + "select 'link' as effect, id, child_id as subject, 77::bigint as removed_at from held where child_id in (select id from gone) union all select distinct 'orphaned', child_id, null, null from held where parent_id in (select id from gone) and child_id not in (select id from gone) and child_id in (select id from nodes) and not exists (select 1 from held b where b.child_id = held.child_id and b.parent_id not in (select id from gone)) union all select 'path', file_id, uri[8:], null from places where not removed and uri like 'file://%' and file_id in (select id from gone)"
)
def removal_preview(spark: SparkSession, d: str) -> DataFrame:
    """What removing some customers and orders does (GR-17)."""
    gone = table(spark, d, "customer").filter("c_custkey % 20 = 0").select(_id("c", "c_custkey").alias("id")).unionByName(table(spark, d, "orders").filter("o_orderkey % 50 = 0").select(_id("o", "o_orderkey").alias("id")))
    return graph.removal(V.nodes(spark, d), V.links(spark, d), gone, _file_places(spark, d), 77)


@query(_FOREST + "select id, parent_id, lead(id) over (partition by parent_id order by length(child_id) desc, order_key asc nulls first, id) as next_id from links where not removed and not suspended")
def sibling_list(spark: SparkSession, d: str) -> DataFrame:
    """Each parent's children as a linked list by score (MU-20)."""
    return graph.sibling_list(V.links(spark, d).withColumn("score", F.length("child_id")), "parent_id", "score", "order_key")


@query(with_sql(NODES_SQL, LINKS_SQL, _LIVE_SQL) + "select s.label as section, k.label as key, k.id from live a join nodes s on s.id = a.child_id join live b on b.parent_id = a.child_id join nodes k on k.id = b.child_id where a.parent_id = 'r1'")
def settings_map(spark: SparkSession, d: str) -> DataFrame:
    """Sections and keys below a root of settings (GR-19)."""
    return media.settings(V.nodes(spark, d), V.links(spark, d), "r1")


@query(with_sql(NODES_SQL, LINKS_SQL, _LIVE_SQL) + "select parent_id, child_id, c_acctbal as score, row_number() over (partition by parent_id order by c_acctbal desc nulls last, child_id) as position from live left join customer on 'c' || c_custkey = child_id where parent_id like 'n%'")
def children_scored(spark: SparkSession, d: str) -> DataFrame:
    """Nations' children, best first; suppliers have no score (RD-16)."""
    below = graph.children(V.nodes(spark, d), V.links(spark, d)).filter("parent_id like 'n%'").select("parent_id", "child_id")
    return media.children_by_score(below, table(spark, d, "customer").select(_id("c", "c_custkey").alias("id"), F.col("c_acctbal").alias("score")))


@query(with_sql(NODES_SQL, LINKS_SQL, CONTAINS_SQL, _CLOSURE_SQL, _REGION_SQL, recursive=True) + "select child_id, region from links join regions on regions.id = parent_id where link_type = 'contains' and not removed")
def parent_regions(spark: SparkSession, d: str) -> DataFrame:
    """The region of each node's home (JN-02)."""
    return graph.parent_regions(V.links(spark, d), graph.region_of(V.nodes(spark, d), V.contains(spark, d), _marks(spark, d)))


@query("select 'c' || c_custkey as node_id, 'n' || c_nationkey as region from customer where c_custkey % 7 = 0 union all select 'n' || n_nationkey, 'top' from nation")
def nested_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions that hang below a member of another one: some customers in nations, nations in the top (JN-14)."""
    marks = _marks(spark, d).unionByName(table(spark, d, "customer").filter("c_custkey % 7 = 0").select(_id("c", "c_custkey").alias("node")))
    members = graph.region_of(V.nodes(spark, d), V.contains(spark, d), marks)
    return graph.nested_regions(marks.withColumnRenamed("node", "node_id"), V.contains(spark, d), members)


@query("select a.l as old_link, b.l as new_link, a.c as old_child, b.c as new_child from (select 'x' || o_orderkey as l, 'c' || o_custkey as c, 'x' || (o_orderkey + 1) as by from orders where o_orderkey % 2 = 0) a join (select 'x' || o_orderkey as l, 'c' || o_custkey as c from orders) b on b.l = a.by where a.c <> b.c")
def superseded_links(spark: SparkSession, d: str) -> DataFrame:
    """Links that a link to another child has replaced (JN-04)."""
    i = F.col("o_orderkey")
    return graph.superseded(table(spark, d, "orders").select(_id("x", i).alias("id"), _id("c", "o_custkey").alias("child_id"), F.when(i % 2 == 0, _id("x", i + 1)).alias("superseded_by")))


@query(_FOREST + "select 'primary' as tree, 'p' || p_partkey as file_id from part where 'p' || p_partkey not in (select 'p' || l_partkey from lineitem where l_quantity > 45)")
def backfill(spark: SparkSession, d: str) -> DataFrame:
    """Files that the primary tree doesn't show yet (RC-19, MU-24)."""
    files = table(spark, d, "part").select(_id("p", "p_partkey").alias("id"))
    shown = table(spark, d, "lineitem").select(F.lit("primary").alias("parent_id"), _id("p", "l_partkey").alias("child_id"), (F.col("l_quantity") <= 45).alias("removed"))
    return reconcile.unlinked(files, shown, "primary")


@query("select distinct 'u' || l_suppkey as parent_id, 'p' || p as child_id, case when p not in (select p_partkey from part) then 'unknown' when exists (select 1 from lineitem b where b.l_suppkey = a.l_suppkey and b.l_partkey = a.p and b.l_returnflag <> 'R') then 'exists' else 'add' end as action from (select l_suppkey, l_partkey + case when l_linenumber = 1 then 100000 else 0 end as p from lineitem where l_linestatus = 'F') a")
def user_references(spark: SparkSession, d: str) -> DataFrame:
    """References that users' trees ask for (RC-23)."""
    lines = table(spark, d, "lineitem")
    link = lambda df, part: df.select(_id("u", "l_suppkey").alias("parent_id"), _id("p", part).alias("child_id"), (F.col("l_returnflag") == "R").alias("removed"))
    wanted = link(lines.filter("l_linestatus = 'F'"), F.col("l_partkey") + F.when(F.col("l_linenumber") == 1, 100000).otherwise(0))
    return reconcile.user_refs(wanted, link(lines, F.col("l_partkey")), table(spark, d, "part").select(_id("p", "p_partkey").alias("id")))


# --- logs and addresses ------------------------------------------------------------------------------------------


@query(with_sql(CHAT_SQL) + "select log_id, seq, kind from log where seq = 3")
def log_point(spark: SparkSession, d: str) -> DataFrame:
    """The third row of every log (SRC-02)."""
    return tables.log_row(V.chat_log(spark, d), 3).select("log_id", "seq", "kind")


@query(with_sql(CHAT_SQL) + "select seq, kind, (select max(seq) from log where log_id = 5) as tip from log where log_id = 5 and seq >= 2")
def region_log_scan(spark: SparkSession, d: str) -> DataFrame:
    """One log from its second row on, with its tip (SRC-04)."""
    return tables.region_log(V.chat_log(spark, d), 5, 2).select("seq", "kind", "tip")


@query(with_sql(_LOG_SQL) + "select 'top' as log_id, seq, node_id, root from flog where kind = 'RegionBaseline'")
def log_baselines(spark: SparkSession, d: str) -> DataFrame:
    """The generations of regions that a log begins (SRC-07)."""
    return tables.baselines(_log(spark, d).withColumn("log_id", F.lit("top")))


@query(
    with_sql("logs as (select 'r' || r_regionkey as log_id, 'top' as parent_log from region union all select 'n' || n_nationkey, 'r' || n_regionkey from nation)", "held as (select 'top' as log_id union all select 'r' || r_regionkey from region where r_regionkey <> 2 union all select 'n' || n_nationkey from nation where n_nationkey % 3 <> 0)")
    + "select log_id, case when log_id in (from held) and parent_log in (from held) then 'read' when log_id in (from held) then 'unreached' else 'not_held' end as status from logs union all select 'top', 'read'"
)
def region_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Which logs a sweep from the top reads (ST-04)."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    found = r.select(_id("r", "r_regionkey").alias("log_id"), F.lit("top").alias("parent_log")).unionByName(n.select(_id("n", "n_nationkey").alias("log_id"), _id("r", "n_regionkey").alias("parent_log")))
    top = spark.range(1).select(F.lit("top").alias("log_id"))
    held = top.unionByName(r.filter("r_regionkey <> 2").select(_id("r", "r_regionkey").alias("log_id"))).unionByName(n.filter("n_nationkey % 3 <> 0").select(_id("n", "n_nationkey").alias("log_id")))
    return tables.held_logs(found, held, top)


@query("select * from (select sha256(text) as id, min(doc_id) as doc_id from documents group by 1) where id not in (select sha256(text) from documents where doc_id % 10 = 0)")
def feed_append(spark: SparkSession, d: str) -> DataFrame:
    """What an append-only feed of distinct texts takes of all documents (SRC-16)."""
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("id"), "doc_id")
    return tables.appended(docs.filter("doc_id % 10 = 0"), docs, "id", "doc_id")


@query(
    "with a as (select event_id, sha256(props) as h from events), t as (select event_id, case event_id % 6 when 0 then h || '/g-top-' || (event_id + 1) || '.db' when 1 then h || '/g-' || h[1:8] || '-7.db' when 2 then upper(h) || '/g-top-1.db' when 3 then h || '/g-top-01.db' when 4 then h || '/../g-top-1.db' else h || '/g-' || h[1:9] || '-1.db' end as x, h from a) "
    "select event_id, case when event_id % 6 < 2 then h end as root, case event_id % 6 when 0 then 'top' when 1 then h[1:8] end as host, case event_id % 6 when 0 then event_id + 1 when 1 then 7 end as seq from t"
)
def region_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of generations, well-formed and not (FLT-11)."""
    h, i = F.sha2("props", 256), F.col("event_id")
    tail = F.when(i % 6 == 0, F.concat(F.lit("/g-top-"), (i + 1).cast("string"), F.lit(".db"))).when(i % 6 == 1, F.concat(F.lit("/g-"), F.substring(h, 1, 8), F.lit("-7.db"))).when(i % 6 == 2, "/g-top-1.db").when(i % 6 == 3, "/g-top-01.db").when(i % 6 == 4, "/../g-top-1.db").otherwise(F.concat(F.lit("/g-"), F.substring(h, 1, 9), F.lit("-1.db")))
    text = F.concat(F.when(i % 6 == 2, F.upper(h)).otherwise(h), tail)
    return table(spark, d, "events").select("event_id", *[c.alias(k) for k, c in S.region_address(text).items()])


_ADDRESSES = ["file:///a/b c", "temp:///x", "store:///ab12", "host://pin1/data/x.mkv", "tree://films/a/b", "tree://films@server/a", "tree://films", "http://h/x", "file://relative", "host://pin1", "nothing"]
_PARTS = [("local", None, "/a/b c"), ("temp", None, "/x"), ("store", None, "ab12"), ("remote", "pin1", "/data/x.mkv"), ("tree", "films", "a/b"), ("tree", "films@server", "a"), ("tree", "films", ""), *[(None, None, None)] * 4]
_list = lambda values: "[" + ", ".join("null" if v is None else f"'{v}'" for v in values) + "]"


@query("select event_id, " + ", ".join(f"({_list([p[i] for p in _PARTS])})[1 + event_id % 11] as {name}" for i, name in enumerate(("kind", "owner", "path"))) + " from events")
def location_forms(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of every scheme, and others (FLT-10)."""
    uri = F.element_at(F.array(*map(F.lit, _ADDRESSES)), (F.col("event_id") % 11 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", *[c.alias(k) for k, c in S.location_parts(uri).items()])


@query("select l_partkey as file_id, l_suppkey, case l_suppkey % 3 when 0 then 'local' when 1 then 'remote' else 'local' end as place, case l_suppkey % 3 when 0 then '/f' || l_partkey when 2 then '/srv/store/' || left('k' || l_partkey, 2) || '/k' || l_partkey end as path from (select distinct l_partkey, l_suppkey from lineitem)")
def readable_paths(spark: SparkSession, d: str) -> DataFrame:
    """Where locations can be read from here (RD-07)."""
    at, s = table(spark, d, "lineitem").select(F.col("l_partkey").alias("file_id"), "l_suppkey").distinct(), F.col("l_suppkey") % 3
    uri = F.when(s == 0, _id("file:///f", "file_id")).when(s == 1, _id("host://other/f", "file_id")).otherwise(_id("store:///k", "file_id"))
    return reconcile.local_paths(at.withColumn("uri", uri), "mine", "/srv/store", "/tmp/spool").select("file_id", "l_suppkey", "place", "path")


_PINS_SQL = "own as (select 'pin' || s_suppkey as pin, 'own:' || min(s_suppkey) as address from supplier where s_suppkey % 3 = 0 group by 1), told as (select 'pin' || s_suppkey as pin, 'told:' || s_suppkey as address from supplier where s_suppkey % 4 <> 1)"


@query(with_sql(_PINS_SQL) + "select l_partkey as file_id, 'pin' || l_suppkey as pin, '/f' || l_partkey as path, coalesce(o.address, t.address) as address, case when o.pin is not null then 'registry' when t.pin is not null then 'catalog' end as via from (select distinct l_partkey, l_suppkey from lineitem) left join own o on o.pin = 'pin' || l_suppkey left join told t on t.pin = 'pin' || l_suppkey")
def fetch_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Where remote files may be fetched from, by registry or catalog (JN-15, SRC-19)."""
    at = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    uri = F.concat(F.lit("host://pin"), F.col("l_suppkey").cast("string"), _id("/f", "l_partkey"))
    s, told = table(spark, d, "supplier"), F.when(F.col("s_suppkey") % 8 == 7, " ").otherwise(_id("told:", "s_suppkey"))
    entries = s.filter("s_suppkey % 4 <> 1").select(_id("pin", "s_suppkey").alias("label"), F.encode(_id("told:", "s_suppkey"), "UTF-8").alias("payload"))
    entries = entries.unionByName(s.filter("s_suppkey % 4 <> 1").select(_id("pin", "s_suppkey").alias("label"), F.encode(F.when(told == " ", told), "UTF-8").alias("payload")).filter("payload is not null"))
    registry = s.filter("s_suppkey % 3 = 0").select(_id("pin", "s_suppkey").alias("pin"), _id("own:", "s_suppkey").alias("address"))
    return reconcile.candidates(at.select(F.col("l_partkey").alias("file_id"), uri.alias("uri")), registry, reconcile.endpoints(entries))


@query("select page_id, url from pages where starts_with(url, 'https://www.')")
def under_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Rows under an address prefix (FLT-02)."""
    return reconcile.under_prefix(table(spark, d, "pages").select("page_id", "url"), "url", "https://www.")


@query("select doc_id, case when doc_id % 4 = 0 then text when doc_id % 4 = 3 then null when octet_length(encode(text)) >= doc_id % 50 + 5 then decode(array_slice(encode(text), doc_id % 50 + 1, doc_id % 50 + 5)) end as piece from (select doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') as text from documents)")
def ranged_reads(spark: SparkSession, d: str) -> DataFrame:
    """Byte ranges of contents: whole ones, inner ones, and ones beyond the end (SRC-13, RD-10)."""
    i = F.col("doc_id")
    start, end = F.when(i % 4 == 0, 0).otherwise(i % 50), F.when(i % 4 == 0, 0).when(i % 4 == 3, 1 << 40).otherwise(i % 50 + 5)
    content = F.encode(F.regexp_replace("text", "[^\\x00-\\x7F]", ""), "UTF-8")
    return table(spark, d, "documents").select("doc_id", F.decode(S.ranged(content, start, end), "UTF-8").alias("piece"))


_TYPES = ["user.note", "config.x", "event.y", "file.integrity_failure", "file", "users", ""]


@query("select event_id, case when event_id % 7 < 4 then 'private' else 'public' end as visibility, 'mount' || regexp_replace(lower('/Mnt/' || props), '[^a-z0-9]', '-', 'g') as slug from events")
def default_visibility(spark: SparkSession, d: str) -> DataFrame:
    """Default visibility by type, and slugs of mount points (FN-23, FN-14)."""
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", S.default_visibility(kind, types=("file.integrity_failure",)).alias("visibility"), S.mount_slug(F.concat(F.lit("/Mnt/"), "props")).alias("slug"))


@query("select event_id as node_id, kind, props as payload, length(props) as size, cast(json_extract_string(props, '$.k') as int) as k from (select *, event_type as kind from events where event_type <> 'error')")
def inline_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of readable nodes, and their decoded fields (RD-09, FLT-08, FLT-09)."""
    e = table(spark, d, "events").filter("event_type <> 'error'")
    return e.select(F.col("event_id").alias("node_id"), F.col("event_type").alias("kind"), F.col("props").alias("payload"), F.length("props").alias("size"), F.from_json("props", "k int")["k"].alias("k"))


# --- placement and reconciliation --------------------------------------------------------------------------------

_LINES = ["sync abc", "sync-advertise abc", "central abc /srv/my store", "central-keep abc /srv/k", "served-by abc inst /remote/a b", "central abc", "served-by abc inst", "other abc", "  ", "sync"]
_READ = [("sync", "abc", None, None), ("sync-advertise", "abc", None, None), ("central", "abc", None, "/srv/my store"), ("central-keep", "abc", None, "/srv/k"), ("served-by", "abc", "inst", "/remote/a b"), *[(None, None, None, None)] * 5]


@query("select event_id, " + ", ".join(f"({_list([p[i] for p in _READ])})[1 + event_id % 10] as {name}" for i, name in enumerate(("mode", "root", "instance", "path"))) + ", case when event_id % 10 >= 5 then 'corrupt' end as error from events where event_id % 10 <> 8")
def placement_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of placement files (SRC-15)."""
    line = F.element_at(F.array(*map(F.lit, _LINES)), (F.col("event_id") % 10 + 1).cast("int"))
    return reconcile.placements(table(spark, d, "events").select("event_id", line.alias("line")), "line").drop("line")


@query("select root, mode, path from (select 'n' || (event_id % 37) as root, ['sync', 'central', null][1 + user_id % 3] as mode, props as path, row_number() over (partition by event_id % 37 order by event_id desc) as no from events) where no = 1 and mode is not null")
def placement_state(spark: SparkSession, d: str) -> DataFrame:
    """The placement that edits leave, one mode a root (RC-11)."""
    mode = F.element_at(F.array(F.lit("sync"), F.lit("central"), F.lit(None).cast("string")), (F.col("user_id") % 3 + 1).cast("int"))
    return reconcile.placed(table(spark, d, "events").select(F.col("event_id").alias("seq"), _id("n", F.col("event_id") % 37).alias("root"), mode.alias("mode"), F.col("props").alias("path")))


_TIER_SQL = """roots as (select r_regionkey as root, r_regionkey % 2 = 0 as keep, '/store' || r_regionkey as dest, case when r_regionkey % 2 = 1 then 'file:///stage' end as staging, case when r_regionkey = 3 then 'host://pin2/srv' end as served from region),
files as (select p_partkey as file_id, p_partkey % 5 as root, p_size % 4 <> 0 as hashed from part),
at_ as (select distinct l_partkey as file_id, case l_suppkey % 4 when 0 then '/store' || (l_partkey % 5) || '/x' when 1 then 'file:///stage/' || l_suppkey when 2 then 'host://pin2/srv/' || l_suppkey else 'file:///stages/' || l_suppkey end as uri, l_suppkey % 4 = 2 as foreign_, l_suppkey % 4 <> 2 as readable from lineitem where l_returnflag <> 'R' and l_suppkey % 9 < 5),
met as (select f.*, r.keep, a.uri, a.foreign_, coalesce(a.readable, false) as readable, coalesce(case when keep then starts_with(uri, dest || '/') else not foreign_ and not coalesce(starts_with(uri, staging || '/'), false) end, false) as has,
 coalesce(not keep and (foreign_ and not coalesce(starts_with(uri, served || '/'), false) or coalesce(starts_with(uri, staging || '/'), false)), false) as goes from files f join roots r using (root) left join at_ a using (file_id)),
per as (select file_id, root, hashed, bool_or(has) as has, bool_or(readable) as reach from met group by all)"""


@query(
    with_sql(_TIER_SQL)
    + "select file_id, root, unnest(case when has then ['satisfied'] when not reach then ['fail'] when hashed then ['migrate'] else ['attest', 'migrate'] end) as action, null as uri from per union all select file_id, root, 'retire', uri from met join per using (file_id, root) where goes and (per.has or per.reach)"
)
def tier_plan(spark: SparkSession, d: str) -> DataFrame:
    """What a pass of the mover does (RC-08)."""
    k, p, s = F.col("r_regionkey"), F.col("l_partkey"), F.col("l_suppkey")
    roots = table(spark, d, "region").select(k.cast("long").alias("root"), (k % 2 == 0).alias("keep"), _id("/store", k).alias("dest"), F.when(k % 2 == 1, "file:///stage/").alias("staging"), F.when(k == 3, "host://pin2/srv").alias("served"))
    files = table(spark, d, "part").select(F.col("p_partkey").alias("file_id"), (F.col("p_partkey") % 5).alias("root"), (F.col("p_size") % 4 != 0).alias("hashed"))
    uri = F.when(s % 4 == 0, F.concat(_id("/store", p % 5), F.lit("/x"))).when(s % 4 == 1, _id("file:///stage/", s)).when(s % 4 == 2, _id("host://pin2/srv/", s)).otherwise(_id("file:///stages/", s))
    at = table(spark, d, "lineitem").filter("l_returnflag <> 'R' and l_suppkey % 9 < 5").select(p.alias("file_id"), uri.alias("uri"), (s % 4 == 2).alias("foreign"), (s % 4 != 2).alias("readable")).distinct()
    return reconcile.tier_plan(files, at, roots)


_EVICT_SQL = """retired as (select distinct l_partkey as file_id, case when l_suppkey % 3 = 0 then 'host://me/' else 'file:///d' || (l_suppkey % 3) || '/' end || l_suppkey as uri, l_suppkey * 10 as size from lineitem where l_returnflag = 'R'),
kept as (select distinct l_partkey as file_id from lineitem where l_returnflag = 'N' and l_quantity > 30 and l_suppkey % 2 = 0),
plan as (select file_id, uri, size, case when uri like 'file://%' and uri not like 'file:///d1/%' then 'skip' when file_id in (from kept) then 'evict' else 'keep' end as action from retired)"""


def _evictions(spark: SparkSession, d: str) -> DataFrame:
    lines, s = table(spark, d, "lineitem"), F.col("l_suppkey")
    uri = F.concat(F.when(s % 3 == 0, "host://me/").otherwise(F.concat(_id("file:///d", s % 3), F.lit("/"))), s.cast("string"))
    retired = lines.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("file_id"), uri.alias("uri"), (s * 10).alias("size")).distinct()
    live = lines.filter("l_returnflag = 'N' and l_quantity > 30").select(F.col("l_partkey").alias("file_id"), F.when(s % 2 == 0, "file:///x").otherwise("store:///x").alias("uri"))
    return reconcile.evict_plan(retired, live, spark.range(1).select(F.lit("file:///d1/").alias("source")))


@query(with_sql(_EVICT_SQL) + "select file_id, uri, size, action from plan")
def evict_plan(spark: SparkSession, d: str) -> DataFrame:
    """Retired copies that may be deleted, by consent (RC-09)."""
    return _evictions(spark, d)


@query(with_sql(_EVICT_SQL) + "select action, count(*) as n, cast(sum(size) as bigint) as freed from plan group by action")
def evict_report(spark: SparkSession, d: str) -> DataFrame:
    """How many copies each action takes, and their bytes (AGG-10)."""
    return reconcile.report(_evictions(spark, d), size="size")


_DISK_SQL = """found as (select doc_id % 7 as folder_id, 'file:///' || doc_id as uri, n_chars as size, n_chars % 3 as mtime from documents where doc_id % 5 <> 0),
known as (select doc_id % 7 as folder_id, 'file:///' || doc_id as uri, n_chars - (doc_id % 11 = 0)::int as size, case when doc_id % 13 = 0 then null else n_chars % 3 end as mtime, doc_id % 17 = 0 as removed from documents where doc_id % 6 <> 0)"""


@query(
    with_sql(_DISK_SQL)
    + "select * from (select coalesce(f.folder_id, k.folder_id) as folder_id, coalesce(f.uri, k.uri) as uri, case when k.uri is null then 'new' when f.uri is null then case when not removed then 'removed' end when removed then 'reactivated' when f.size = k.size and f.mtime is not distinct from k.mtime then 'unchanged' else 'changed' end as action from (from found where folder_id <> 3) f full join (from known where folder_id <> 3) k on f.uri = k.uri) where action is not null union all select 3, null, 'source_missing'"
)
def scan_bindings(spark: SparkSession, d: str) -> DataFrame:
    """A scan of bound folders, one of whose sources is missing (RC-01)."""
    i, docs = F.col("doc_id"), table(spark, d, "documents")
    place = [(i % 7).alias("folder_id"), _id("file:///", i).alias("uri")]
    found = docs.filter("doc_id % 5 <> 0").select(*place, F.col("n_chars").alias("size"), (F.col("n_chars") % 3).alias("mtime"))
    known = docs.filter("doc_id % 6 <> 0").select(*place, (F.col("n_chars") - F.when(i % 11 == 0, 1).otherwise(0)).alias("size"), F.when(i % 13 != 0, F.col("n_chars") % 3).alias("mtime"), (i % 17 == 0).alias("removed"))
    bound = spark.range(7).select(F.col("id").alias("folder_id"), (F.col("id") != 3).alias("source_found"))
    return reconcile.scan_bindings(bound, found, known)


@query(
    with_sql("seen as (select event_id, user_id as file_id, 'u' as uri, event_id as detected_at, cast(floor(value) as bigint) as old_size, event_id % 50 as old_mtime, cast(floor(value) as bigint) + 1 as new_size, event_id as new_mtime, event_id % 4 <> 0 as new from events)")
    + "select file_id, uri, arg_min(old_size, (new, detected_at)) as old_size, arg_min(old_mtime, (new, detected_at)) as old_mtime, arg_max(new_size, (new, detected_at)) as new_size, arg_max(new_mtime, (new, detected_at)) as new_mtime, arg_min(detected_at, (new, detected_at)) as detected_at from seen group by all"
)
def pending_flags(spark: SparkSession, d: str) -> DataFrame:
    """Pending changes that keep what was there at first (RC-02)."""
    i, v = F.col("event_id"), F.floor("value").cast("long")
    rows = table(spark, d, "events").select(F.col("user_id").alias("file_id"), F.lit("u").alias("uri"), v.alias("old_size"), (i % 50).alias("old_mtime"), (v + 1).alias("new_size"), i.alias("new_mtime"), i.alias("detected_at"))
    held = rows.filter("detected_at % 4 = 0")
    held = reconcile.flagged_changes(held.limit(0), held)
    return reconcile.flagged_changes(held, rows.filter("detected_at % 4 <> 0"))


_REL = "array_to_string(list_filter(string_split(url, '/'), lambda x: x <> ''), '/')"


@query(
    f"with f as (select page_id % 3 as folder_id, {_REL} as rel from pages), d as (select distinct folder_id, unnest(list_transform(range(1, len(string_split(rel, '/'))), lambda n: array_to_string(string_split(rel, '/')[1:n], '/'))) as rel from f) select folder_id, rel, len(string_split(rel, '/'))::int as depth from d where rel <> 'https:'"
)
def mirror_folders(spark: SparkSession, d: str) -> DataFrame:
    """Folders that a mirror must make (RC-06)."""
    files = table(spark, d, "pages").select((F.col("page_id") % 3).alias("folder_id"), F.array_join(S.segments(F.col("url")), "/").alias("rel"))
    have = files.select("folder_id").distinct().withColumn("rel", F.lit("https:"))
    return reconcile.missing_folders(files, have)


_RELS = ["a/b/c.txt", "a/b", "/abs", "a//b", "a/../b", "", "x.txt", "x.txt", "dir/y", "dir"]


@query(
    f"with s as (select event_id, event_id // 10 as session, {_list(_RELS)}[1 + event_id % 10] as rel, case when event_id % 10 in (1, 9) and event_id // 10 % 2 = 0 then 'dir' when event_id % 30 = 6 then 'link' else 'file' end as kind from events) "
    "select event_id, case when rel = '' then 'empty' when rel = '/abs' then 'absolute' when rel in ('a//b', 'a/../b') then 'segment' when kind = 'link' then 'kind' when count(*) over (partition by session, rel) > 1 then 'twice' when rel in ('a/b', 'dir') and kind = 'file' and count(*) filter (rel in ('a/b/c.txt', 'dir/y')) over (partition by session, left(rel, 1)) > 0 then 'file as folder' end as error from s"
)
def import_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of imports, good and bad (RC-13)."""
    i, session = F.col("event_id"), F.floor(F.col("event_id") / 10)
    kind = F.when((i % 10).isin(1, 9) & (session % 2 == 0), "dir").when(i % 30 == 6, "link").otherwise("file")
    rows = table(spark, d, "events").select("event_id", session.alias("session"), F.element_at(F.array(*map(F.lit, _RELS)), (i % 10 + 1).cast("int")).alias("rel"), kind.alias("kind"))
    return reconcile.importable_paths(rows).select("event_id", "error")


@query("select user_id as job, count(distinct cast(floor(value) as bigint)) as n_found, count(distinct case when cast(floor(value) as bigint) % 3 <> 0 then cast(floor(value) as bigint) end) as n_new, count(distinct case when cast(floor(value) as bigint) % 3 = 0 then cast(floor(value) as bigint) end) as n_known from events group by user_id")
def scan_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Dry runs of scans: what they find and what of it is new (RC-18)."""
    found = table(spark, d, "events").select(F.col("user_id").alias("job"), F.floor("value").cast("long").alias("uri"))
    return reconcile.scan_job(found, found.select("uri").distinct().filter("uri % 3 = 0"))


@query("select p_partkey, 'prune' as action, 'nightly' as by, 99::bigint as at_ms from part where p_size > 40 union all select p_partkey, 'kept', null, null from part where p_size <= 40")
def prune_execution(spark: SparkSession, d: str) -> DataFrame:
    """What pruning leaves, and its audit (RC-21, MU-22)."""
    parts = table(spark, d, "part")
    left, audit = reconcile.pruned(parts, parts.filter("p_size > 40"), "p_partkey", "nightly", 99)
    none = lambda kind: F.lit(None).cast(kind)
    return audit.withColumnRenamed("at", "at_ms").unionByName(left.select("p_partkey", F.lit("kept").alias("action"), none("string").alias("by"), none("long").alias("at_ms")))


@query(
    "select user_id as job, arg_max(event_id % 2 = 0, event_id) as enabled, arg_max(case event_type when 'purchase' then 'ok' when 'error' then 'error' else 'running' end, event_id) as state, max(event_id * 5) filter (event_type = 'purchase') as last_ok, max(event_id * 5) filter (event_type = 'error') as last_error, arg_max(props, event_id) filter (event_type = 'error') as error from events group by user_id"
)
def job_states(spark: SparkSession, d: str) -> DataFrame:
    """The state of each job, its last success and its last failure (RD-14)."""
    kind, i = F.col("event_type"), F.col("event_id")
    state = F.when(kind == "purchase", "ok").when(kind == "error", "error").otherwise("running")
    return reconcile.job_states(table(spark, d, "events").select(F.col("user_id").alias("job"), i.alias("seq"), (i % 2 == 0).alias("enabled"), state.alias("state"), (i * 5).alias("at"), F.col("props").alias("error")))


@query(
    with_sql(NODES_SQL, LINKS_SQL, "homes as (select child_id, parent_id from links where link_type = 'contains' and not removed)", "walk as (select id, parent_id, node_type, label from nodes left join homes on child_id = id)",
             "named as (select *, case when row_number() over (partition by parent_id, label order by id) = 1 then label else label || '~' || left(id, 8) end as name from walk)", "rel as (select id, name as rel from named where parent_id = 'root' union all select n.id, rel || '/' || name from named n join rel r on n.parent_id = r.id)", recursive=True)
    + "select id, rel, case when node_type <> 'file' then 'mkdir' when id in (select 'p' || l_partkey from lineitem where l_quantity > 45) then 'hardlink' else 'skip' end as action, case when node_type = 'file' and id not in (select 'p' || l_partkey from lineitem where l_quantity > 45) then 'no readable source' end as reason from rel join nodes using (id)"
)
def export_plan(spark: SparkSession, d: str) -> DataFrame:
    """A plan that exports the tree as hard links (SNK-03)."""
    homes = V.contains(spark, d).select(F.col("child_id").alias("id"), "parent_id")
    sources = table(spark, d, "lineitem").filter("l_quantity > 45").select(_id("p", "l_partkey").alias("id"), _id("/disk/", "l_suppkey").alias("path"))
    walk = tables.written(tables.paired(V.nodes(spark, d), homes, "id", "left"), "walk")
    below = graph.lifted(homes.select(F.col("id").alias("node"), F.col("parent_id").alias("up"))).filter("top = 'root'").select(F.col("node").alias("id"))
    whole = tables.written(tables.paired(walk, below, "id", "left_semi").unionByName(walk.filter("id = 'root'")), "whole")
    return reconcile.export_plan(whole, sources, "hardlink")


# --- ranges and streams ------------------------------------------------------------------------------------------

_MERGED_SQL = _RANGES_SQL + ', merged as (select user_id, event_id as start, event_id + 10 as "end" from events where event_id % 20 = 0)'


@query(
    with_sql(_MERGED_SQL, "files as (select user_id, max(event_id) + 10 as length, user_id % 5 = 0 as committed from events group by user_id)")
    + """select user_id % 3 as session, user_id as file_id, verified, chunks_done, cast(ceil(length / 8.0) as bigint) as chunks_total, case when committed then 'committed' when verified >= length then 'complete' when verified > 0 then 'running' else 'waiting' end as state
    from (select f.user_id, length, committed, coalesce(cast(sum("end" - start) as bigint), 0) as verified, coalesce(cast(sum(greatest(0, case when "end" >= length then cast(ceil(length / 8.0) as bigint) else "end" // 8 end - cast(ceil(start / 8.0) as bigint))) as bigint), 0) as chunks_done from files f left join merged m on m.user_id = f.user_id group by all)"""
)
def session_progress(spark: SparkSession, d: str) -> DataFrame:
    """How far each file of each import is (AGG-09, RD-13)."""
    e = table(spark, d, "events")
    files = e.groupBy(F.col("user_id").alias("file_id")).agg((F.max("event_id") + 10).alias("length")).select((F.col("file_id") % 3).alias("session"), "file_id", "length", (F.col("file_id") % 5 == 0).alias("committed"))
    merged = e.filter("event_id % 20 = 0").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("start"), (F.col("event_id") + 10).alias("end"))
    return intervals.session_progress(files, merged, 8)


@query("select doc_id as file_id, n::int as chunk, n % 3 = 1 as again from (select doc_id, unnest(range(0, n_chars // 512 + 1)) as n from documents) where n % 3 <> 0")
def chunks_to_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that a resumed transfer still needs: lacking ones, and held ones with another hash (ST-18)."""
    at = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.explode(F.sequence(F.lit(0), F.floor(F.col("n_chars") / 512).cast("int"))).alias("chunk"))
    manifest = at.withColumn("hash", F.concat_ws(":", "file_id", "chunk"))
    held = manifest.filter("chunk % 3 <> 2").withColumn("hash", F.when(F.col("chunk") % 3 == 1, "torn").otherwise(F.col("hash")))
    return intervals.to_fetch(manifest, held)


@query(with_sql(EVENTS_SQL) + "select entity, field, count(*) filter (kind = 'NodeCreated') as n_out, count(*) filter (kind = 'LinkCreated') as n_in, bool_or(kind = 'NodeCreated') and bool_or(kind = 'LinkCreated') as complete from log where kind in ('NodeCreated', 'LinkCreated') group by entity, field")
def stream_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Halves of moves that wait for each other, as a stream's state (ST-07)."""
    return twins.open_pairs(spark, d)


@query(with_sql(EVENTS_SQL) + "select entity, field, max(seq) filter (kind = 'LinkCreated') as seq, arg_max(value, seq) filter (kind = 'LinkCreated') as value, coalesce(max(seq) filter (kind = 'LinkCreated') > max(seq) filter (kind = 'Revoked'), true) as active from log where kind in ('LinkCreated', 'Revoked') group by entity, field having max(seq) filter (kind = 'LinkCreated') is not null")
def stream_links(spark: SparkSession, d: str) -> DataFrame:
    """Links made, revoked and made again, as a stream's state (ST-06)."""
    return twins.fold_links(spark, d)


@query("select event_id % 7 as log_id, event_id // 7 + 1 as seq, sha256(props) as hash, 'append' as action from events")
def stream_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Shipped log rows, judged as they arrive (ST-03)."""
    path = f"{d}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("recursiveFileLookup", "true").parquet(f"{d}/events.parque[t]")
    return twins.arrivals(rows.select((F.col("event_id") % 7).alias("log_id"), (F.floor(F.col("event_id") / 7) + 1).alias("seq"), F.sha2("props", 256).alias("hash")))


@query(
    "with g as (select user_id, ts, case when ts - lag(ts) over w >= interval 30 minute then 1 else 0 end as fresh from events window w as (partition by user_id order by ts)), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as no from g) select user_id, min(ts) as opened, max(ts) + interval 30 minute as due, count(*) as n from s group by user_id, no"
)
def change_bursts(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of changes that each ask for one scan once they have been quiet (ST-09)."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = twins.debounced(e, "user_id", "ts", "30 minutes")
    return out.select("user_id", F.col("opened").cast("timestamp_ntz").alias("opened"), F.col("due").cast("timestamp_ntz").alias("due"), "n")
