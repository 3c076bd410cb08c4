"""Authorization over a forest: key standing, effective rights of many principals at once, event checks, and audits.

Relations: acl(node_id, principal_kind, principal_id, authority, rights, expires_at), where expires_at 0 is never; keys(pubkey,
device_index, revoked_at), device_index -1 for members; tags(member, tag, authority). Null keys match nothing; repeated rows count once;
empty tables give no rights. Every test is an equi-join, so hot folders and keys are split by adaptive joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import met, paired, spread, written

READ, WRITE, ADMIN = 1, 2, 4
ANY, KEY, PUBLIC, TAG = range(4)


def standing(keys: DataFrame) -> DataFrame:
    """pubkey, standing: owner, member or revoked (AU-02); keys without a row were never authorized."""
    out = F.when(F.col("revoked_at").isNotNull(), "revoked").when(F.col("device_index") == -1, "member").otherwise("owner")
    return keys.select("pubkey", out.alias("standing"))


def active_at(keys: DataFrame, t: int) -> DataFrame:
    """Keys authorized at t and not revoked by then (FLT-05)."""
    return keys.filter((F.col("authorized_at") <= t) & (F.col("revoked_at").isNull() | (F.col("revoked_at") > t)))


def effective_rights(pairs: DataFrame, closure: DataFrame, acl: DataFrame, keys: DataFrame, tags: DataFrame, t: int) -> DataFrame:
    """principal, node_id, rights for all pairs (principal, node_id) of keys and nodes (AU-01).

    Active owners have all rights. Others have the union of unexpired grants on the node and its ancestors: public ones
    always, any-grants as active members, key grants unless revoked, tag grants as active members who hold the tag from
    the grant's own authority, if that is not revoked. closure(node, ancestor) needs the pairs' nodes alone.

    Public and any-grants are united once a node, whoever asks. Key grants are joined on node and key, tag grants on node, tag and authority, each only
    for principals that have one, so a folder with very many grants meets only those who hold them.
    """
    of = standing(keys)
    live = of.filter("standing <> 'revoked'").select(F.col("pubkey").alias("authority"))
    grants = acl.filter((F.col("expires_at") == 0) | (F.col("expires_at") > t))
    wanted = pairs.select("principal", "node_id").distinct()
    wanted = written(wanted, "wanted")
    own = written(wanted.select("node_id").distinct(), "own")
    above = closure.select(F.col("node").alias("node_id"), F.col("ancestor").alias("_at")).join(own.hint("merge"), "node_id", "left_semi").unionByName(own.select("node_id", F.col("node_id").alias("_at")))
    above = written(above, "above")  # it is used four times
    n = wanted.count()
    depth = -(-above.count() // max(1, own.count()))
    upward = lambda df: paired(df, above, "node_id", "inner", n)
    by_principal = lambda df: spread(df, "_at", "principal", rows=n * depth)
    open_ = grants.filter(F.col("principal_kind").isin(PUBLIC, ANY)).groupBy(F.col("node_id").alias("_at"), (F.col("principal_kind") == PUBLIC).alias("_public")).agg(F.bit_or("rights").alias("rights"))
    bits = lambda c: F.coalesce(F.bit_or(F.when(c, F.col("rights"))), F.lit(0))
    open_ = above.join(open_, "_at").groupBy("node_id").agg(bits(F.col("_public")).alias("_all"), bits(~F.col("_public")).alias("_members"))
    by_key = grants.filter(F.col("principal_kind") == KEY).groupBy(F.col("node_id").alias("_at"), F.col("principal_id").alias("principal")).agg(F.bit_or("rights").alias("rights"))
    by_tag = grants.filter(F.col("principal_kind") == TAG).join(live, "authority", "left_semi").groupBy(F.col("node_id").alias("_at"), F.col("principal_id").alias("_tag"), "authority").agg(F.bit_or("rights").alias("rights"))
    held = tags.join(live, "authority", "left_semi").select(F.col("member").alias("principal"), F.col("tag").alias("_tag"), "authority").distinct()
    known = met(wanted, of.withColumnRenamed("pubkey", "principal"), "principal", "inner")
    keyed = known.filter("standing <> 'revoked'").join(by_key.select("principal").distinct(), "principal", "left_semi")
    keyed = by_principal(upward(keyed)).join(by_key, ["_at", "principal"]).select("principal", "node_id", "rights")
    # A key may be granted rights before it is ever authorized.
    strange = met(wanted, of.select(F.col("pubkey").alias("principal")), "principal", "left_anti").join(by_key.select("principal").distinct(), "principal", "left_semi")
    strange = by_principal(upward(strange)).join(by_key, ["_at", "principal"]).select("principal", "node_id", "rights")
    tagged = upward(known.filter("standing = 'member'").join(held, "principal")).join(by_tag, ["_at", "_tag", "authority"]).select("principal", "node_id", "rights")
    granted = keyed.unionByName(strange).unionByName(tagged).groupBy("principal", "node_id").agg(F.bit_or("rights").alias("_own"))
    out = wanted.join(granted, ["principal", "node_id"], "left").join(open_, "node_id", "left").join(of.withColumnRenamed("pubkey", "principal"), "principal", "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(0))
    rights = some("_own").bitwiseOR(some("_all")).bitwiseOR(F.when(F.col("standing") == "member", some("_members")).otherwise(0))
    return out.select("principal", "node_id", F.when(F.col("standing") == "owner", READ | WRITE | ADMIN).otherwise(rights).alias("rights"))


def audit(acl: DataFrame, keys: DataFrame, tags: DataFrame, t: int) -> dict[str, DataFrame]:
    """Rows without effect: tag grants and memberships of dead authorities, grants to revoked keys, expired grants (AU-08)."""
    live = keys.filter("revoked_at is null").select(F.col("pubkey").alias("authority"))
    as_key = lambda df: df.select(F.col("pubkey").alias("principal_id"))
    key_grants = acl.filter(F.col("principal_kind") == KEY)
    return {
        "inert_tag_grants": acl.filter(F.col("principal_kind") == TAG).join(live, "authority", "left_anti"),
        "inert_memberships": tags.join(live, "authority", "left_anti"),
        "inert_key_grants": key_grants.join(as_key(keys), "principal_id", "left_semi").join(as_key(keys.filter("revoked_at is null")), "principal_id", "left_anti"),
        "expired": acl.filter((F.col("expires_at") != 0) & (F.col("expires_at") <= t)),
    }


def reissued(acl: DataFrame, tags: DataFrame, old: str, new: str) -> DataFrame:
    """The memberships and tag grants of authority old, as new would author them again (AU-09): kind, subject, tag, authority, rights."""
    own = F.col("authority") == old
    members = tags.filter(own).select(F.lit("member").alias("kind"), F.col("member").alias("subject"), "tag", F.lit(new).alias("authority"), F.lit(0).alias("rights"))
    grants = acl.filter((F.col("principal_kind") == TAG) & own).select(F.lit("grant").alias("kind"), F.col("node_id").alias("subject"), F.col("principal_id").alias("tag"), F.lit(new).alias("authority"), "rights")
    return members.unionByName(grants)


#: What a member's event of each kind must hold, and where: on its own node, or on the parent of its link.
NEEDS_ADMIN = ("AclSet", "RegionMarked", "RegionUnmarked", "RegionBaseline", "SubRegionHead", "ChunkManifestRecorded")
NEEDS_WRITE = ("FileLocationAdded", "SecureBlobUpdated")
ON_PARENT = ("LinkCreated", "NodeMovedIn")
ON_OLD_PARENT = ("LinkRemoved", "NodeMovedOut")


def required(events: DataFrame, links: DataFrame) -> DataFrame:
    """events with target and needed: the node on which an event's author needs a right, and which; null if none is needed (AU-03).

    events: kind, node_id, parent_id (of the link that the event makes), link_id (of the link that it ends). links(id, parent_id, child_id), each id
    once, are those that stood before the event. Making a link needs write on its parent, unless it makes a root; ending
    one needs write on its parent, or admin on what a root link shows. Ending an unknown link is free, but a move out of one needs admin on the node.
    """
    before = links.select(F.col("id").alias("link_id"), F.col("parent_id").alias("_parent"), F.col("child_id").alias("_child"), F.lit(True).alias("_there"))
    out = events.join(before, "link_id", "left")
    kind, ends = F.col("kind"), F.col("kind").isin(*ON_OLD_PARENT)
    target = (
        F.when(kind.isin(*NEEDS_ADMIN, *NEEDS_WRITE), F.col("node_id")).when(kind.isin(*ON_PARENT), F.col("parent_id"))
        .when(ends & F.col("_parent").isNotNull(), F.col("_parent")).when(kind == "NodeMovedOut", F.col("node_id")).when(ends & F.col("_there"), F.col("_child"))
    )
    needed = F.when(target.isNull(), F.lit(None)).when(kind.isin(*NEEDS_ADMIN), ADMIN).when(kind.isin(*NEEDS_WRITE, *ON_PARENT) | F.col("_parent").isNotNull(), WRITE).otherwise(ADMIN)
    return out.withColumn("target", target).withColumn("needed", needed).select(*events.columns, "target", "needed")


def checked(events: DataFrame, links: DataFrame, rights: DataFrame, keys: DataFrame) -> DataFrame:
    """events with verdict: ok, inactive or forbidden (AU-03). events are as for required, with author and at.

    rights(principal, node_id, rights) must have the pairs of authors and targets; see effective_rights. An author must have been
    authorized by the event's time and not revoked by then.
    """
    return judged(required(events, links), rights, keys)


def judged(needs: DataFrame, rights: DataFrame, keys: DataFrame) -> DataFrame:
    """What required gives, with verdict; see checked."""
    own = keys.select(F.col("pubkey").alias("author"), "authorized_at", "revoked_at")
    has = rights.select(F.col("principal").alias("author"), F.col("node_id").alias("target"), F.col("rights").alias("_rights"))
    out = needs.join(own, "author", "left").join(has, ["author", "target"], "left")
    active = (F.col("authorized_at") <= F.col("at")) & (F.col("revoked_at").isNull() | (F.col("revoked_at") > F.col("at")))
    enough = F.col("needed").isNull() | (F.coalesce("_rights", F.lit(0)).bitwiseAND(F.col("needed")) == F.col("needed"))
    verdict = F.when(~F.coalesce(active, F.lit(False)), "inactive").when(enough, "ok").otherwise("forbidden")
    return out.withColumn("verdict", verdict).select(*needs.columns, "verdict")


def old_ground(targets: DataFrame, born: DataFrame) -> DataFrame:
    """targets(id) with ground: the nearest node at or above each that a batch hasn't made itself (AU-04). born(id, parent_id): what it makes, and under what.

    Rights on nodes of a batch are judged there, as nothing has been granted on them yet.
    """
    from .graph import lifted

    ends = lifted(born.select(F.col("id").alias("node"), F.col("parent_id").alias("up"))).select(F.col("node").alias("id"), "top")
    return paired(targets, ends, "id", "left").select(*targets.columns, F.coalesce("top", "id").alias("ground"))


def certified(events: DataFrame, roots: DataFrame, rights: DataFrame, root_node: str) -> DataFrame:
    """Device certificates events(seq, author, ...) with valid: signed by the root key of their time, or by an admin of the forest's root (AU-05).

    roots(seq, root, until) as root_lineage gives them, few and not overlapping; rights(principal, node_id, rights).
    """
    admins = rights.filter((F.col("node_id") == root_node) & (F.col("rights").bitwiseAND(ADMIN) != 0)).select(F.col("principal").alias("author")).distinct().withColumn("_admin", F.lit(True))
    spans = roots.select(F.col("root").alias("author"), F.col("seq").alias("_from"), F.col("until").alias("_until"))
    inside = (F.col("seq") > F.col("_from")) & (F.col("_until").isNull() | (F.col("seq") <= F.col("_until")))
    by_root = events.join(spans, "author").filter(inside).select(*events.columns).distinct().withColumn("_root", F.lit(True))
    out = events.join(admins, "author", "left").join(by_root.select("seq", "author", "_root"), ["seq", "author"], "left")
    return out.select(*events.columns, F.coalesce("_root", "_admin", F.lit(False)).alias("valid"))


def root_lineage(log: DataFrame) -> DataFrame:
    """log_id, seq, root, until: the root keys of a forest by the event that set each, and the event that replaced it (AU-11).

    log(log_id, seq, kind, key, valid): ForestCreated and valid RootRotated events count. until is null for the current root. All of one log's
    rotations, which are few, are put in order in one task.
    """
    from pyspark.sql import Window

    set_ = log.filter((F.col("kind") == "ForestCreated") | ((F.col("kind") == "RootRotated") & F.col("valid")))
    until = F.lead("seq").over(Window.partitionBy("log_id").orderBy("seq"))
    return set_.select("log_id", "seq", F.col("key").alias("root"), until.alias("until"))


def listed(acl: DataFrame, nodes: DataFrame) -> DataFrame:
    """The entries on nodes(node_id) themselves, not those inherited, with letters of their rights (AU-07), for display in order of kind, id and authority."""
    from ..functions.scalars import format_rights

    return acl.join(nodes.select("node_id").distinct(), "node_id", "left_semi").withColumn("letters", format_rights(F.col("rights")))


def may(rights: DataFrame, needed: int | Column) -> DataFrame:
    """rights with allowed: whether all needed bits are held (RD-04)."""
    bits = F.lit(needed) if isinstance(needed, int) else needed
    return rights.withColumn("allowed", F.col("rights").bitwiseAND(bits) == bits)


def may_replicate(requests: DataFrame, rights: DataFrame, root_node: str) -> DataFrame:
    """requests(principal, region) with allowed: admin on the forest's root, or on the region's root where a region is asked for (AU-10)."""
    admin = rights.filter(F.col("rights").bitwiseAND(ADMIN) != 0).select("principal", "node_id").distinct()
    whole = admin.filter(F.col("node_id") == root_node).select("principal", F.lit(True).alias("_whole"))
    part = admin.select("principal", F.col("node_id").alias("region"), F.lit(True).alias("_part"))
    out = requests.join(whole, "principal", "left").join(part, ["principal", "region"], "left")
    return out.select(*requests.columns, F.coalesce("_whole", "_part", F.lit(False)).alias("allowed"))


def readable_children(children: DataFrame, rights: DataFrame) -> DataFrame:
    """children(parent_id, child_id) that each principal may see: it reads the parent and the child (RD-08). rights(principal, node_id, rights)."""
    can = rights.filter(F.col("rights").bitwiseAND(READ) != 0).select("principal", "node_id").distinct()
    below = children.join(can.select("principal", F.col("node_id").alias("child_id")), "child_id")
    return below.join(can.select("principal", F.col("node_id").alias("parent_id")), ["principal", "parent_id"], "left_semi").select("principal", *children.columns)
