"""Declarative folds of an event log into relations: one grouping a relation, never a pass in order over all events.

Each takes a log(seq, kind, ...) and gives the relation that replaying it in order of seq leaves. All are grouped aggregates, so
they combine before the shuffle and can be kept by a stream (see sylva.streaming). seq must tell events of one key apart; repeated rows
change nothing. Events with a null key form a group of their own; columns that a fold doesn't name are ignored; an empty log gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(log: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The fields of the last event of each key (SecureBlobUpdated, SubRegionHead, ChunkManifestRecorded)."""
    return log.groupBy(*keys).agg(F.max(F.struct("seq", *fields)).alias("_x")).select(*keys, "_x.*")


def first_wins(log: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The fields of the first event of each key; later ones are ignored (DeviceAuthorized, NodeCreated, T-10)."""
    return log.groupBy(*keys).agg(F.min(F.struct("seq", *fields)).alias("_x")).select(*keys, "_x.*")


def reactivated(log: DataFrame, create: str, remove: str, keys: list[str], fields: list[str]) -> DataFrame:
    """Keys that were created, with the fields of their last creation and whether it outlasts the last removal (LinkCreated, T-11)."""
    made = F.max(F.when(F.col("kind") == create, F.struct("seq", *fields)))
    gone = F.max(F.when(F.col("kind") == remove, F.col("seq")))
    out = log.filter(F.col("kind").isin(create, remove)).groupBy(*keys).agg(made.alias("_x"), gone.alias("_gone")).filter("_x is not null")
    return out.select(*keys, "_x.*", (F.col("_gone").isNull() | (F.col("_gone") < F.col("_x.seq"))).alias("active"))


def deleted_on_zero(log: DataFrame, keys: list[str], rights: Column) -> DataFrame:
    """The last rights of each key; rights 0 remove the row (AclSet, T-09)."""
    return last_wins(log.withColumn("rights", rights), keys, ["rights"]).filter("rights <> 0")


def without_purged(relation: DataFrame, purges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key was never purged, whatever the order of events (FD-06)."""
    return relation.join(purges.select(*keys), keys, "left_anti")


def since_reset(log: DataFrame, kind: str, reset: Column) -> DataFrame:
    """Events of a kind after the last reset of their log (RootRotated clears recovery keys, T-15). One row a log is joined."""
    last = log.filter(reset).groupBy("log_id").agg(F.max("seq").alias("_reset"))
    return log.filter(F.col("kind") == kind).join(last, "log_id", "left").filter("_reset is null or seq > _reset").drop("_reset")


def pairs(log: DataFrame, out_kind: str, in_kind: str, keys: list[str]) -> DataFrame:
    """Halves of moves by key, and whether both were seen (FD-05, ST-07)."""
    halves = log.filter(F.col("kind").isin(out_kind, in_kind)).groupBy(*keys)
    counted = halves.agg(F.count(F.when(F.col("kind") == out_kind, 1)).alias("n_out"), F.count(F.when(F.col("kind") == in_kind, 1)).alias("n_in"))
    return counted.withColumn("complete", (F.col("n_out") > 0) & (F.col("n_in") > 0))


#: Rows of one block in which gaps looks for skips.
BLOCK = 1 << 16


def gaps(log: DataFrame, by: list[str], block: int = BLOCK) -> DataFrame:
    """Places where seq skips within a log: after, seq, missing (VF-04).

    A log is cut into blocks of numbers, each of which is looked through by itself; between blocks only their first and last numbers
    meet. Repeated numbers are no skip.
    """
    rows = log.select(*by, "seq", F.floor(F.col("seq") / block).alias("_block"))
    inner = rows.select(*by, "seq", F.lag("seq").over(Window.partitionBy(*by, "_block").orderBy("seq")).alias("after"))
    ends = rows.groupBy(*by, "_block").agg(F.min("seq").alias("seq"), F.max("seq").alias("_last"))
    outer = ends.select(*by, "seq", F.lag("_last").over(Window.partitionBy(*by).orderBy("_block")).alias("after"))
    return inner.unionByName(outer).filter("after is not null and seq > after + 1").withColumn("missing", F.col("seq") - F.col("after") - 1)


# --- the relations of a catalog ----------------------------------------------------------------------------------
#
# The log has seq, kind and, where an event has them, the columns that each function names.


def _at(kinds: tuple[str, ...], value: Column | str) -> Column:
    """The last event among kinds: its seq and value."""
    return F.max(F.when(F.col("kind").isin(*kinds), F.struct("seq", F.expr(value).alias("v") if isinstance(value, str) else value.alias("v"))))


def _after(event: str, other: str) -> Column:
    """The value of event where it follows other; else null."""
    return F.when(F.col(f"{event}.seq") > F.col(f"{other}.seq"), F.col(f"{event}.v"))


def devices(log: DataFrame) -> DataFrame:
    """pubkey, device_index, authorized_at, revoked_at from DeviceAuthorized (the first counts) and DeviceRevoked (the last after it): pubkey, device_index, at."""
    made = F.min(F.when(F.col("kind") == "DeviceAuthorized", F.struct("seq", "device_index", "at")))
    out = log.filter(F.col("kind").isin("DeviceAuthorized", "DeviceRevoked")).groupBy("pubkey").agg(made.alias("_x"), _at(("DeviceRevoked",), "at").alias("_gone")).filter("_x is not null")
    return out.select("pubkey", "_x.device_index", F.col("_x.at").alias("authorized_at"), _after("_gone", "_x").alias("revoked_at"))


def recovery_keys(log: DataFrame) -> DataFrame:
    """pubkey, registered_at of keys registered after their last revocation and after the last RootRotated, which clears all; the first such registration counts."""
    reset = log.filter("kind = 'RootRotated'").agg(F.max("seq").alias("_reset"))  # one row
    rows = log.filter(F.col("kind").isin("RecoveryKeyRegistered", "RecoveryKeyRevoked")).crossJoin(F.broadcast(reset)).filter("_reset is null or seq > _reset")
    gone = rows.filter("kind = 'RecoveryKeyRevoked'").groupBy("pubkey").agg(F.max("seq").alias("_gone"))
    made = rows.filter("kind = 'RecoveryKeyRegistered'").join(gone, "pubkey", "left").filter("_gone is null or seq > _gone")
    return made.groupBy("pubkey").agg(F.min_by("at", "seq").alias("registered_at"))


def grants(log: DataFrame) -> DataFrame:
    """node_id, principal_kind, principal_id, authority, rights, set_at, expires_at from AclSet: the last of each key, if it grants anything. Only tag grants (kind 3) keep their author as authority."""
    rows = log.filter("kind = 'AclSet'").withColumn("authority", F.when(F.col("principal_kind") == 3, F.col("author")).otherwise(F.lit("")))
    out = last_wins(rows.withColumn("set_at", F.col("at")), ["node_id", "principal_kind", "principal_id", "authority"], ["rights", "set_at", "expires_at"])
    return out.filter("rights <> 0").drop("seq")


def memberships(log: DataFrame) -> DataFrame:
    """pubkey, tag, authority, set_at from MemberTagged: pairs whose last event grants."""
    rows = log.filter("kind = 'MemberTagged'").withColumn("authority", F.col("author"))
    return last_wins(rows, ["pubkey", "tag", "authority"], ["at", "granted"]).filter("granted").select("pubkey", "tag", "authority", F.col("at").alias("set_at"))


def created_nodes(log: DataFrame) -> DataFrame:
    """node_id, node_type, label, created_at from NodeCreated (the first counts), without those ever purged by NodePurged."""
    made = first_wins(log.filter("kind = 'NodeCreated'").withColumn("created_at", F.col("at")), ["node_id"], ["node_type", "label", "created_at"])
    return without_purged(made, log.filter("kind = 'NodePurged'"), ["node_id"]).drop("seq")


def created_links(log: DataFrame) -> DataFrame:
    """link_id, parent_id, child_id, link_type, order_key, created_at, removed_at, superseded_by, suspended_at of every link.

    LinkCreated and NodeMovedIn make a link and, made again, bring it back as new. LinkRemoved and NodeMovedOut end it, LinkReordered changes its order_key,
    LinkSuperseded names its other_id, LinkSuspended and LinkUnsuspended turn it off and on; all need a link that stands. NodeMovedIn also ends the link
    that it names as other_id; where that one is made only later and the other half of the move hasn't come by then, it comes in ended at the move's time. A link's own events, which are few, are
    put in order by a window to see which halves stood open.
    """
    own = log.filter(F.col("kind").isin("LinkCreated", "LinkRemoved", "LinkReordered", "LinkSuperseded", "LinkSuspended", "LinkUnsuspended", "NodeMovedIn", "NodeMovedOut"))
    columns = ["seq", "kind", "link_id", "parent_id", "child_id", "link_type", "order_key", "at", "other_id"]
    left = own.filter("kind = 'NodeMovedIn' and other_id is not null").select("seq", F.lit("Left").alias("kind"), F.col("other_id").alias("link_id"), *[F.lit(None).cast(own.schema[c].dataType).alias(c) for c in columns[3:7]], "at", F.lit(None).cast("string").alias("other_id"))
    rows = own.select(*columns).unionByName(left)
    before = Window.partitionBy("link_id").orderBy("seq", "kind").rowsBetween(Window.unboundedPreceding, -1)
    n_of = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).over(before)
    when = F.last(F.when(F.col("kind") == "Left", F.col("at")), ignorenulls=True).over(before)
    rows = rows.withColumn("_late", F.when((F.col("kind") == "LinkCreated") & (n_of("Left") > n_of("NodeMovedOut")), when))
    made, ended = ("LinkCreated", "NodeMovedIn"), ("LinkRemoved", "NodeMovedOut", "Left")
    out = rows.groupBy("link_id").agg(
        F.max(F.when(F.col("kind").isin(*made), F.struct("seq", "parent_id", "child_id", "link_type", "order_key", "at", "_late"))).alias("_x"),
        _at(ended, "at").alias("_gone"), _at(("LinkReordered",), "order_key").alias("_order"), _at(("LinkSuperseded",), "other_id").alias("_by"),
        _at(("LinkSuspended", "LinkUnsuspended"), F.when(F.col("kind") == "LinkSuspended", F.col("at"))).alias("_off"),
    ).filter("_x is not null")
    return out.select(
        "link_id", "_x.parent_id", "_x.child_id", "_x.link_type", F.coalesce(_after("_order", "_x"), F.col("_x.order_key")).alias("order_key"), F.col("_x.at").alias("created_at"),
        F.coalesce(_after("_gone", "_x"), F.col("_x._late")).alias("removed_at"), _after("_by", "_x").alias("superseded_by"), _after("_off", "_x").alias("suspended_at"),
    )


def locations(log: DataFrame) -> DataFrame:
    """file_id, uri, added_at, removed_at from FileLocationAdded and FileLocationRemoved (node_id, uri, at). NodePurged drops what a file had; a location may be added after it."""
    rows = log.filter(F.col("kind").isin("FileLocationAdded", "FileLocationRemoved"))
    purged = log.filter("kind = 'NodePurged'").groupBy("node_id").agg(F.max("seq").alias("_purged"))
    rows = rows.join(purged, "node_id", "left").filter("_purged is null or seq > _purged")
    out = rows.groupBy("node_id", "uri").agg(_at(("FileLocationAdded",), "at").alias("_x"), _at(("FileLocationRemoved",), "at").alias("_gone")).filter("_x is not null")
    return out.select(F.col("node_id").alias("file_id"), "uri", F.col("_x.v").alias("added_at"), _after("_gone", "_x").alias("removed_at"))


def bindings(log: DataFrame) -> DataFrame:
    """folder_id, uri, bound_at, unbound_at from FolderBound (the last counts) and FolderUnbound (node_id, uri, at)."""
    rows = log.filter(F.col("kind").isin("FolderBound", "FolderUnbound")).groupBy("node_id")
    out = rows.agg(F.max(F.when(F.col("kind") == "FolderBound", F.struct("seq", "uri", "at"))).alias("_x"), _at(("FolderUnbound",), "at").alias("_gone")).filter("_x is not null")
    return out.select(F.col("node_id").alias("folder_id"), "_x.uri", F.col("_x.at").alias("bound_at"), _after("_gone", "_x").alias("unbound_at"))


def regions(log: DataFrame) -> DataFrame:
    """node_id, marked_at, baseline_seq, state_root, committed_seq, committed_head of regions that are marked.

    RegionUnmarked ends a region and what it was; RegionMarked again moves its marked_at. RegionBaseline (root) starts a generation and clears its head; SubRegionHead
    (head_seq, root) commits one. A baseline or head counts from the mark on that it follows.
    """
    ends = log.filter("kind = 'RegionUnmarked'").groupBy("node_id").agg(F.max("seq").alias("_end"))
    rows = log.filter(F.col("kind").isin("RegionMarked", "RegionBaseline", "SubRegionHead")).join(ends, "node_id", "left").filter("_end is null or seq > _end")
    out = rows.groupBy("node_id").agg(
        F.min(F.when(F.col("kind") == "RegionMarked", F.col("seq"))).alias("_first"), _at(("RegionMarked",), "at").alias("_x"),
        _at(("RegionBaseline",), "root").alias("_base"), _at(("SubRegionHead",), F.struct("head_seq", "root")).alias("_head"),
    ).filter("_x is not null")
    base = F.col("_base.seq") > F.col("_first")
    head = (F.col("_head.seq") > F.col("_first")) & (F.col("_base").isNull() | (F.col("_head.seq") > F.col("_base.seq")))
    return out.select(
        "node_id", F.col("_x.v").alias("marked_at"), F.when(base, F.col("_base.seq")).alias("baseline_seq"), F.when(base, F.col("_base.v")).alias("state_root"),
        F.when(head, F.col("_head.v.head_seq")).alias("committed_seq"), F.when(head, F.col("_head.v.root")).alias("committed_head"),
    )


def open_moves(log: DataFrame) -> DataFrame:
    """link_id, node_id, at, half: moves of which one half alone was seen (FD-05). NodeMovedOut has link_id, NodeMovedIn the same as other_id."""
    out = log.filter("kind = 'NodeMovedOut'").select("link_id", "node_id", "at", F.lit("out").alias("half"))
    into = log.filter("kind = 'NodeMovedIn' and other_id is not null").select(F.col("other_id").alias("link_id"), F.col("child_id").alias("node_id"), "at", F.lit("in").alias("half"))
    both = out.unionByName(into).groupBy("link_id").agg(F.min("node_id").alias("node_id"), F.max("at").alias("at"), F.min("half").alias("half"), F.count_distinct("half").alias("_n"))
    return both.filter("_n = 1").drop("_n")


def projection(log: DataFrame) -> dict[str, DataFrame]:
    """All relations that the log leaves (FD-01), each a fold of its own over the events that it needs.

    Which region a node is in, and which region encloses another, follow from the links and marks: see graph.region_of. To bring relations
    up to date with a log's tail, fold the whole log again, or keep the folds as a stream.
    """
    last = lambda kind, keys, fields: last_wins(log.filter(F.col("kind") == kind), keys, fields).drop("seq")
    return {
        "device_keys": devices(log), "recovery_keys": recovery_keys(log), "acl": grants(log), "member_tags": memberships(log), "nodes": created_nodes(log), "links": created_links(log),
        "file_locations": locations(log), "folder_bindings": bindings(log), "regions": regions(log), "pending_moves": open_moves(log),
        "secure_blobs": last("SecureBlobUpdated", ["node_id"], ["root", "at", "author"]), "chunk_manifests": last("ChunkManifestRecorded", ["node_id"], ["root"]),
        "purged_nodes": log.filter("kind = 'NodePurged'").select("node_id").distinct(),
    }


def replayed(log: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """log(log_id, seq, ...) with error: the first of the named checks that a row fails, and rows after a failed one stopped (FD-02).

    checks: name and a condition over the row that must hold, in order; null fails. A log ends at its first bad row, whose seq is one row a log.
    """
    error = F.lit(None).cast("string")
    for name, good in reversed(checks):
        error = F.when(~F.coalesce(good, F.lit(False)), name).otherwise(error)
    marked = log.withColumn("_error", error)
    ends = marked.filter("_error is not null").groupBy("log_id").agg(F.min("seq").alias("_end"))
    out = marked.join(ends, "log_id", "left").withColumn("error", F.when(F.col("seq") > F.col("_end"), "stopped").otherwise(F.col("_error")))
    return out.select(*log.columns, "error")


def replay_order(log: DataFrame, generations: DataFrame) -> DataFrame:
    """log(log_id, seq) with place: an order in which a tree of logs can be replayed in one go (FD-03).

    generations(log_id, parent_log, baseline_seq): a log's events stand right after the parent's event that begins it and before the parent's next one.
    place is the seqs down from the top log, so it sorts as an array; a log without a row in generations is a top log.
    """
    from .graph import lifted

    step = generations.filter("parent_log is not null").select(F.col("log_id").alias("node"), F.col("parent_log").alias("up"), F.array(F.col("baseline_seq")).alias("path"))
    above = lifted(step, F.concat("high", "low")).select(F.col("node").alias("log_id"), F.col("path").alias("_above"))
    return log.join(above, "log_id", "left").withColumn("place", F.concat(F.coalesce("_above", F.array().cast("array<long>")), F.array(F.col("seq")))).drop("_above")
