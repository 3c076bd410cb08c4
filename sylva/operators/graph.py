"""Queries over a forest of nodes and links: children, walks, ancestors, paths, orphans, regions, cascades.

Relations: nodes(id, node_type, label) with distinct ids; links(id, parent_id, child_id, link_type, order_key, removed,
suspended). Other columns are ignored. A link without a parent makes its child a root. Null ids match nothing. Repeated links count as one each
where rows are listed, and don't change sets. Empty tables give no rows. Whatever follows pointers doubles its distance in each round, so a depth of
n takes log2(n) joins, and cycles are reported as ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import met, paired, spread, written


def live(links: DataFrame) -> DataFrame:
    """Links that children show: neither removed nor suspended (FLT-01)."""
    return links.filter("not removed and not suspended")


def children(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Live children of each parent in order of (order_key, child_id); links to missing nodes are dropped (GR-01, T-02, T-04).

    All children of one parent are numbered in one task.
    """
    place = F.row_number().over(Window.partitionBy("parent_id").orderBy("order_key", "child_id"))
    found = live(links).join(nodes.select(F.col("id").alias("child_id"), "node_type", "label"), "child_id")
    return found.select("parent_id", "child_id", "link_type", "node_type", "label", "order_key", place.cast("long").alias("position"))


def lifted(edges: DataFrame, join: Column | None = None) -> DataFrame:
    """edges(node, up) -> node, top, depth: where the chain of ups from node ends, and after how many steps.

    Every node of edges has one row for each way up (one, in a forest). With join, an expression over the columns high and low, edges
    also have `path`, and what join makes of the paths of all steps, from the top down, is returned as path. Each round joins every
    pointer with the one it points to, so n rows are written log2(depth) times. Tops that very many pointers share are met by broadcast.
    """
    also = ["path"] if join is not None else []
    known = written(edges.filter("node is not null and up is not null").select("node", F.col("up").alias("top"), F.lit(1).cast("long").alias("depth"), *also), "lifted")
    most = known.count()
    reach = 1
    while True:
        far = known.select(F.col("node").alias("top"), F.col("top").alias("_top"), F.col("depth").alias("_depth"), *[F.col("path").alias("high") for _ in also])
        step = met(known.withColumnsRenamed({"path": "low"}), far, "top", "left")
        moved = F.col("_top").isNotNull()
        path = [F.when(moved, join).otherwise(F.col("low")).alias("path") for _ in also]
        step = step.select("node", F.coalesce("_top", "top").alias("top"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), *path, moved.alias("_met"))
        step = written(step, "lifted")
        known = step.drop("_met")
        if step.filter("_met").isEmpty():
            return known
        reach *= 2
        if reach > 2 * most:
            raise ValueError("the links have a cycle")


def walk(nodes: DataFrame, links: DataFrame, root: str, most_depth: int | None = None) -> DataFrame:
    """id, depth, link_type, sort_path of the walk from root: sorting by sort_path gives its pre-order (GR-02, GR-03).

    Sort paths of contained nodes are doubled; references, given where they stand and not descended, are joined once. So a node can
    occur more than once. The separator sorts below all characters of order keys, whose width may vary (T-33).
    A cycle among live contains links anywhere is an error; an unknown root gives no rows.
    """
    below = written(live(links).filter("parent_id is not null").select("parent_id", "child_id", "link_type", "order_key"), "below")
    below = written(met(below, nodes.select(F.col("id").alias("child_id")), "child_id", "inner"), "below")
    own = F.concat(F.lit("/"), F.coalesce("order_key", F.lit("")), F.lit("/"), F.col("child_id"))
    held = below.filter("link_type = 'contains'").select(F.col("child_id").alias("node"), F.col("parent_id").alias("up"), own.alias("path"))
    start = nodes.filter(F.col("id") == root).select("id", F.lit(0).alias("depth"), F.lit("contains").alias("link_type"), F.lit("").alias("sort_path"))
    cut = held.filter(F.col("node") != root)
    found = lifted(cut, F.concat("high", "low")).filter(F.col("top") == root)
    if not held.filter(F.col("node") == root).isEmpty():
        lifted(held.select("node", "up"))  # a root that lies below itself
    found = found.join(F.broadcast(start.select(F.col("id").alias("top"))), "top", "left_semi")
    inside = start.unionByName(found.select(F.col("node").alias("id"), F.col("depth").cast("int").alias("depth"), F.lit("contains").alias("link_type"), F.col("path").alias("sort_path")))
    refs = below.filter("link_type <> 'contains'").withColumnRenamed("link_type", "_type")
    refs = met(refs.withColumnRenamed("parent_id", "id"), inside, "id", "inner").select(F.col("child_id").alias("id"), (F.col("depth") + 1).alias("depth"), F.col("_type").alias("link_type"), F.concat("sort_path", own).alias("sort_path"))
    out = inside.unionByName(refs)
    return out if most_depth is None else out.filter(F.col("depth") <= most_depth)


def ancestors(contains: DataFrame) -> DataFrame:
    """node, ancestor, distance (from 1) for every node of a forest of contains links (GR-04).

    The pairs known so far are joined with themselves, so a forest of depth n takes log2(n) joins; the result has
    depth rows for each node. A cycle is an error.
    """
    near = contains.filter("parent_id is not null and child_id is not null").select(F.col("child_id").alias("node"), F.col("parent_id").alias("ancestor"), F.lit(1).alias("distance"))
    known, reach = written(near, "near"), 1
    while True:
        if not known.filter(F.col("node") == F.col("ancestor")).isEmpty():
            raise ValueError("the links have a cycle")
        top = known.filter(F.col("distance") == reach)
        if top.isEmpty():
            return known
        far = known.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_far"), F.col("distance").alias("_d"))
        step = met(top, far, "ancestor", "inner").select("node", F.col("_far").alias("ancestor"), (F.col("distance") + F.col("_d")).alias("distance"))
        known = written(known.unionByName(step), "ancestors")
        reach *= 2


def paths(nodes: DataFrame, contains: DataFrame) -> DataFrame:
    """id, path: the labels from the root down, joined by slashes (GR-07). Null labels are empty; ancestors without a node have no label."""
    named = nodes.select(F.col("id").alias("node"), F.coalesce("label", F.lit("")).alias("path"))
    edges = paired(contains.select(F.col("child_id").alias("node"), F.col("parent_id").alias("up")), named, "node", "inner")
    up = met(lifted(edges, F.concat("high", F.lit("/"), "low")), named.select(F.col("node").alias("top"), F.col("path").alias("_top")), "top", "left")
    up = up.select(F.col("node").alias("id"), F.concat_ws("/", "_top", "path").alias("path"))
    return paired(nodes.select("id", F.coalesce("label", F.lit("")).alias("_own")), up, "id", "left").select("id", F.coalesce("path", "_own").alias("path"))


def resolved(lookups: DataFrame, nodes: DataFrame, links: DataFrame, root: str) -> DataFrame:
    """lookups(path) with id: the node that each path of labels leads to from root, null if none (GR-06).

    At each segment a contained child of that label goes first, then any other child, in the order of children. One join a
    segment, for all paths together, so the longest path sets the number of rounds; empty segments are skipped, the empty path is the root.
    """
    parts = F.filter(F.split(F.coalesce("path", F.lit("")), "/"), lambda x: x != "")
    at = lookups.select("path").distinct().filter("path is not null").select("path", parts.alias("_rest"), F.lit(root).alias("id"))
    at = written(at.join(nodes.filter(F.col("id") == root).select("id"), "id", "left_semi").select("path", "_rest", "id"), "resolved")
    n = at.count()
    below = live(links).join(nodes.select(F.col("id").alias("child_id"), "label").hint("merge"), "child_id")
    below = below.groupBy("parent_id", "label").agg(F.min(F.struct((F.col("link_type") != "contains").alias("other"), "order_key", "child_id")).alias("_x"))
    below = written(below.select(F.struct("parent_id", "label").alias("_at"), F.col("_x.child_id").alias("_child")), "below")
    done = at.filter("size(_rest) = 0").select("path", "id")
    while not at.filter("size(_rest) > 0").isEmpty():
        step = at.filter("size(_rest) > 0").withColumn("_at", F.struct(F.col("id").alias("parent_id"), F.col("_rest")[0].alias("label")))
        step = met(step, below, "_at", "inner")
        at = written(step.select("path", F.expr("slice(_rest, 2, size(_rest))").alias("_rest"), F.col("_child").alias("id")), "resolved")
        done = done.unionByName(at.filter("size(_rest) = 0").select("path", "id"))
    return paired(lookups.select("path").distinct(), done, "path", "left", n)


def orphans(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes that no unremoved link points to; suspended ones count as links (GR-09, T-01)."""
    return nodes.join(links.filter("not removed").select(F.col("child_id").alias("id")), "id", "left_anti")


def rootless(nodes: DataFrame, links: DataFrame, types: list[str]) -> DataFrame:
    """Nodes without a live inbound link of one of types and without a link that makes them a root (GR-15)."""
    held = live(links).filter(F.col("parent_id").isNull() | F.col("link_type").isin(types))
    return nodes.join(held.select(F.col("child_id").alias("id")), "id", "left_anti")


def file_orphans(nodes: DataFrame, links: DataFrame, locations: DataFrame, node_type: str = "file") -> DataFrame:
    """id, label, created_at, uris: nodes of a type without a live parent, newest first, and their live addresses in order (GR-16, ORD-10).

    nodes have created_at; locations(file_id, uri, removed). A file's addresses are one row's array. Files that tie stand by id, null dates last.
    """
    alone = nodes.filter(F.col("node_type") == node_type).join(live(links).filter("parent_id is not null").select(F.col("child_id").alias("id")), "id", "left_anti")
    held = locations.filter("not removed").groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_set("uri")).alias("uris"))
    out = alone.join(held, "id", "left").select("id", "label", "created_at", F.coalesce("uris", F.array().cast("array<string>")).alias("uris"))
    return out.orderBy(F.desc_nulls_last("created_at"), "id")


def parents(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """child_id, parent_id, link_type, label of the parent, for all live inbound links (GR-21)."""
    return live(links).join(nodes.select(F.col("id").alias("parent_id"), "label"), "parent_id").select("child_id", "parent_id", "link_type", "label")


def root_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """link_id, id, label of nodes that a link without a parent makes roots (JN-17)."""
    return links.filter("parent_id is null").select(F.col("id").alias("link_id"), F.col("child_id").alias("id")).join(nodes.select("id", "label"), "id").select("link_id", "id", "label")


def rooted(nodes: DataFrame, links: DataFrame, root_type: str = "root") -> DataFrame:
    """id, valid, reason: whether any chain of live links leads from a node up to a root (GR-14).

    Roots are nodes of root_type and children of links without a parent. The frontier of reached nodes grows by joins from
    the roots down, each node being reached once, so cycles end. reason is root, reached, no parent, or unreached (it has parents, none of which is reached).
    """
    up = written(live(links).filter("parent_id is not null").select("parent_id", "child_id").distinct(), "up")
    top = nodes.filter(F.col("node_type") == root_type).select("id").unionByName(live(links).filter("parent_id is null").select(F.col("child_id").alias("id"))).distinct()
    n = nodes.count()
    top = written(paired(nodes.select("id"), top, "id", "left_semi", n), "roots")
    reached, frontier = top, top
    while True:
        below = met(up, frontier.select(F.col("id").alias("parent_id")), "parent_id", "left_semi", few=True).select(F.col("child_id").alias("id"))
        below = written(below.filter("id is not null"), "below")
        most = max(below.count(), reached.count())
        frontier = written(spread(below, "id", rows=most).distinct().join(spread(reached, "id", rows=most).hint("merge"), "id", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        reached = written(reached.unionByName(frontier), "reached")
    out = spread(nodes.select("id"), "id", rows=n)
    for marked, name in ((top, "_root"), (reached, "_ok"), (up.select(F.col("child_id").alias("id")), "_up")):
        out = out.join(spread(marked, "id", rows=n).distinct().withColumn(name, F.lit(True)).hint("merge"), "id", "left")
    reason = F.when(F.col("_root"), "root").when(F.col("_ok"), "reached").when(F.col("_up"), "unreached").otherwise("no parent")
    return out.select("id", F.coalesce("_ok", F.lit(False)).alias("valid"), reason.alias("reason"))


def purge_cascade(links: DataFrame, purged: DataFrame, temp: DataFrame) -> DataFrame:
    """id, round: nodes of temp(id) that go with purged(id), round 0: those left without an unremoved inbound link once their parents have gone (GR-10).

    Each round takes the children of what has gone last and keeps those without another parent; nodes that aren't in temp stay. Nothing but the keys
    that very many links share is broadcast, so the driver's memory doesn't grow with the rows.
    """
    inbound = written(links.filter("not removed").select("parent_id", F.col("child_id").alias("id")), "inbound")
    temp = written(temp.select("id"), "temp")
    gone = written(purged.select("id").distinct().select("id", F.lit(0).alias("round")), "gone")
    last, number, n_temp = gone, 0, temp.count()
    while True:
        number += 1
        below = written(met(inbound, last.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id"), "below")
        most = max(below.count(), n_temp, gone.count())
        near = paired(below, temp, "id", "left_semi", most).distinct().join(spread(gone, "id", rows=most).hint("merge"), "id", "left_anti")
        near = written(near, "near")
        others = written(met(inbound, near, "id", "left_semi"), "others")
        kept = met(others, gone.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("id")
        last = written(paired(near, kept, "id", "left_anti", others.count()).select("id", F.lit(number).alias("round")), "last")
        if last.isEmpty():
            return gone
        gone = written(gone.unionByName(last), "gone")


def removal(nodes: DataFrame, links: DataFrame, targets: DataFrame, locations: DataFrame, at: int) -> DataFrame:
    """What removing targets(id) does, one row an effect (GR-17): effect, id, subject, removed_at.

    link: each unremoved inbound link of a target, which is removed at `at`; orphaned: each node whose unremoved inbound links all come from
    targets; path: each live local address of a target. locations(file_id, uri, removed). A preview: nothing is written.
    """
    target = targets.select("id").distinct()
    held = links.filter("not removed")
    cut = held.join(target.select(F.col("id").alias("child_id")), "child_id", "left_semi").select(F.lit("link").alias("effect"), "id", F.col("child_id").alias("subject"), F.lit(at).cast("long").alias("removed_at"))
    below = held.join(target.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("child_id").distinct().join(target.select(F.col("id").alias("child_id")), "child_id", "left_anti")
    other = held.filter("parent_id is null").select("child_id").unionByName(held.filter("parent_id is not null").join(target.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("child_id"))
    alone = below.join(other, "child_id", "left_anti").join(nodes.select(F.col("id").alias("child_id")), "child_id", "left_semi")
    alone = alone.select(F.lit("orphaned").alias("effect"), F.col("child_id").alias("id"), F.lit(None).cast("string").alias("subject"), F.lit(None).cast("long").alias("removed_at"))
    local = locations.filter("not removed and uri like 'file://%'").join(target.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    return cut.unionByName(alone).unionByName(local.select(F.lit("path").alias("effect"), F.col("file_id").alias("id"), F.expr("substring(uri, 8)").alias("subject"), F.lit(None).cast("long").alias("removed_at")))


def would_cycle(moves: DataFrame, closure: DataFrame) -> DataFrame:
    """Moves (child, new_parent) that would put a node under itself or its own descendant (GR-08), with distance and path.

    path has the nodes from new_parent up to child; it is gathered for rejected moves alone and is as long as the forest is deep.
    """
    up = closure.select(F.col("node").alias("new_parent"), F.col("ancestor").alias("child"), "distance")
    bad = moves.select("child", "new_parent").distinct().join(up.hint("merge"), ["new_parent", "child"], "left").filter((F.col("child") == F.col("new_parent")) | F.col("distance").isNotNull())
    bad = bad.select("child", "new_parent", F.coalesce("distance", F.lit(0)).alias("distance"))
    steps = bad.join(closure.select(F.col("node").alias("new_parent"), "ancestor", F.col("distance").alias("_d")).hint("merge"), "new_parent").filter("_d <= distance")
    steps = steps.groupBy("child", "new_parent").agg(F.array_sort(F.collect_set(F.struct("_d", "ancestor"))).alias("_up"))
    out = bad.join(steps, ["child", "new_parent"], "left")
    above = F.coalesce(F.transform("_up", lambda x: x["ancestor"]), F.array().cast(f"array<{dict(bad.dtypes)['child']}>"))
    return out.select("child", "new_parent", "distance", F.concat(F.array("new_parent"), above).alias("path"))


def region_of(nodes: DataFrame, contains: DataFrame, marks: DataFrame) -> DataFrame:
    """id, region: the nearest marked node at or above each node, or top (GR-12, GR-05). marks: node.

    Links above marked nodes are cut, so what a chain ends in is the region, if it is marked.
    """
    marked = marks.select(F.col("node").alias("id")).distinct()
    edges = contains.select(F.col("child_id").alias("node"), F.col("parent_id").alias("up")).join(marked.withColumnRenamed("id", "node"), "node", "left_anti")
    ends = paired(nodes.select("id"), lifted(edges).select(F.col("node").alias("id"), "top"), "id", "left").select("id", F.coalesce("top", "id").alias("_end"))
    found = ends.join(marked.select(F.col("id").alias("_end"), F.col("id").alias("region")), "_end", "left")
    return found.select("id", F.coalesce("region", F.lit("top")).alias("region"))


def nested_regions(regions: DataFrame, contains: DataFrame, members: DataFrame) -> DataFrame:
    """node_id, region: marked nodes that hang below a member of another region (JN-14). regions: node_id; members(id, region)."""
    above = contains.select(F.col("child_id").alias("node_id"), F.col("parent_id").alias("id")).join(regions.select("node_id"), "node_id", "left_semi")
    return above.join(members.select("id", "region"), "id").filter(F.col("region") != F.col("node_id")).select("node_id", "region").distinct()


def parent_regions(links: DataFrame, members: DataFrame) -> DataFrame:
    """child_id, region of each node's home, the parent of its unremoved contains link (JN-02, AGG-05). members(id, region)."""
    home = links.filter("link_type = 'contains' and not removed and parent_id is not null").select("child_id", F.col("parent_id").alias("id"))
    return met(home, members.select("id", "region"), "id", "inner").select("child_id", "region")


def homes(links: DataFrame, temp: DataFrame) -> DataFrame:
    """child_id, link_id, parent_id, temp: the unremoved contains link of each node, a durable one before a temporary one (RD-01).

    Both have the columns of links. Of several, which a sound catalog hasn't, the least id counts.
    """
    one = lambda df, flag: df.filter("link_type = 'contains' and not removed and parent_id is not null").select("child_id", F.lit(flag).alias("temp"), F.col("id").alias("link_id"), "parent_id")
    both = one(links, False).unionByName(one(temp, True))
    return both.groupBy("child_id").agg(F.min(F.struct("temp", "link_id", "parent_id")).alias("_x")).select("child_id", "_x.link_id", "_x.parent_id", "_x.temp")


def superseded(links: DataFrame) -> DataFrame:
    """old_link, new_link, old_child, new_child: links replaced by a link to another child (JN-04). links have superseded_by."""
    old = links.filter("superseded_by is not null").select(F.col("id").alias("old_link"), F.col("superseded_by").alias("new_link"), F.col("child_id").alias("old_child"))
    return old.join(links.select(F.col("id").alias("new_link"), F.col("child_id").alias("new_child")), "new_link").filter("old_child <> new_child").select("old_link", "new_link", "old_child", "new_child")


def chains(edges: DataFrame) -> DataFrame:
    """edges(node, next): node, head, position along each chain (GR-20, ORD-04); a head is what no edge points to.

    One pointer a node, doubled until none moves, so a chain of n takes log2(n) joins of n rows. A cycle is an error.
    """
    up = lifted(edges.filter("next is not null").select(F.col("next").alias("node"), F.col("node").alias("up")))
    out = paired(edges.select("node"), up.select("node", F.col("top").alias("head"), F.col("depth").alias("position")), "node", "left")
    return out.select("node", F.coalesce("head", "node").alias("head"), F.coalesce("position", F.lit(0)).cast("long").alias("position"))


def sibling_list(links: DataFrame, parent: str, score: str, sort_key: str) -> DataFrame:
    """id, next_id: each parent's live links as a list by score falling, then sort key, then id (MU-20); the last one has no next.

    Inserting or removing a link is taking it into the table or out of it; the list follows.
    """
    w = Window.partitionBy(parent).orderBy(F.desc(score), F.asc_nulls_first(sort_key), "id")
    return live(links).select("id", parent, F.lead("id").over(w).alias("next_id"))
