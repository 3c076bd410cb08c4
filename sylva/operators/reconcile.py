"""Reconciliation: scan diffs, placement rules, export plans and names, prefix ownership, addresses.

Keys that are null match nothing. Repeated rows of what is looked up (bindings, placements, registries) are taken once where that is said, else each.
Empty tables give what an absence means: all added, all removed, or no rows. Columns beyond those named are ignored unless rows are returned whole; columns that are added replace
those of their name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import location_parts, safe_name
from ..sources.tables import counted, met, paired, spread, written


def scan_diff(seen: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """key, action of seen(key, size) against known(key, size, removed): added, reactivated, changed, unchanged, removed (RC-01)."""
    s, k = seen.select(key, F.col("size").alias("_seen")), known.select(key, F.col("size").alias("_known"), F.col("removed").alias("_gone"), F.lit(True).alias("_there"))
    action = (
        F.when(F.col("_there").isNull(), "added")
        .when(F.col("_seen").isNull(), F.when(F.col("_gone"), "gone").otherwise("removed"))
        .when(F.col("_gone"), "reactivated").when(F.col("_seen") != F.col("_known"), "changed").otherwise("unchanged")
    )
    return s.join(k, key, "full").select(key, action.alias("action"))


def scan_bindings(bindings: DataFrame, seen: DataFrame, known: DataFrame) -> DataFrame:
    """folder_id, uri, action of a scan of bindings(folder_id, source_found) (RC-01).

    seen(folder_id, uri, size, mtime) are the files found; known(folder_id, uri, size, mtime, removed) what was recorded. A file is unchanged if size and mtime are as
    recorded, changed if not, reactivated if it was removed, new if unknown; what isn't found is removed. A binding whose source is missing gives one row with action
    source_missing and a null uri, and nothing of it is removed.
    """
    good = bindings.filter("source_found").select("folder_id").distinct()
    s = seen.join(good, "folder_id", "left_semi").select("folder_id", "uri", F.col("size").alias("_s"), F.col("mtime").alias("_m"), F.lit(True).alias("_seen"))
    k = known.join(good, "folder_id", "left_semi").select("folder_id", "uri", "size", "mtime", "removed", F.lit(True).alias("_known"))
    same = F.col("_s").eqNullSafe(F.col("size")) & F.col("_m").eqNullSafe(F.col("mtime"))
    action = F.when(F.col("_known").isNull(), "new").when(F.col("_seen").isNull(), F.when(~F.col("removed"), "removed")).when(F.col("removed"), "reactivated").when(same, "unchanged").otherwise("changed")
    out = s.join(k, ["folder_id", "uri"], "full").select("folder_id", "uri", action.alias("action")).filter("action is not null")
    lost = bindings.filter("not source_found").select("folder_id", F.lit(None).cast("string").alias("uri"), F.lit("source_missing").alias("action"))
    return out.unionByName(lost)


def flagged_changes(pending: DataFrame, found: DataFrame) -> DataFrame:
    """pending(file_id, uri, old_size, old_mtime, new_size, new_mtime, detected_at) after the changes found, with the same columns (RC-02).

    A change that is pending already keeps its old values and the time of its first detection, and takes the new values of the latest.
    """
    both = pending.select("*", F.lit(0).alias("_new")).unionByName(found.select("*", F.lit(1).alias("_new")))
    order = F.struct("_new", "detected_at", "new_mtime", "new_size")
    first, last = ("old_size", "old_mtime", "detected_at"), ("new_size", "new_mtime")
    out = both.groupBy("file_id", "uri").agg(F.min_by(F.struct(*first), order).alias("_a"), F.max_by(F.struct(*last), order).alias("_b"))
    return out.select("file_id", "uri", "_a.old_size", "_a.old_mtime", "_b.new_size", "_b.new_mtime", "_a.detected_at")


def missing_folders(files: DataFrame, folders: DataFrame) -> DataFrame:
    """folder_id, rel, depth: folders above files(folder_id, rel) that folders(folder_id, rel) lacks, to be made from depth 1 on (RC-06)."""
    parts = F.split("rel", "/")
    dirs = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))
    wanted = files.select("folder_id", F.explode(dirs).alias("rel")).distinct().join(folders.select("folder_id", "rel"), ["folder_id", "rel"], "left_anti")
    return wanted.withColumn("depth", F.size(F.split("rel", "/")))


def importable_paths(paths: DataFrame) -> DataFrame:
    """paths(session, rel, kind, ...) with error, null for good ones, before an import begins (RC-13).

    An address must be relative, have no empty, . or .. segment, and stand once in its session; no file may stand where another path needs a folder.
    """
    parts = F.split("rel", "/")
    shape = F.when(F.coalesce("rel", F.lit("")) == "", "empty").when(F.col("rel").startswith("/"), "absolute").when(F.exists(parts, lambda x: x.isin("", ".", "..")), "segment").when(~F.coalesce(F.col("kind").isin("file", "dir"), F.lit(False)), "kind")
    counts = paths.groupBy("session", "rel").agg(F.count("*").alias("_n"))
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    under = paths.filter(F.size(parts) > 1).select("session", F.explode(above).alias("rel")).distinct().withColumn("_under", F.lit(True))
    out = paths.withColumn("_shape", shape).join(counts, ["session", "rel"], "left").join(under, ["session", "rel"], "left")
    error = F.coalesce("_shape", F.when(F.col("_n") > 1, "twice"), F.when(F.col("_under") & (F.col("kind") == "file"), "file as folder"))
    return out.withColumn("error", error).select(*paths.columns, "error")


def owner_by_prefix(uris: DataFrame, bindings: DataFrame, uri: str, default: str) -> DataFrame:
    """uris with the policy of the longest binding(source, policy) that is a whole-segment prefix (FLT-03, JN-20).

    Each address is exploded into its prefixes and joined by equality, so no pair of address and binding is tested.
    """
    parts = F.split("_uri", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    step = uris.select(F.col(uri).alias("_uri")).distinct().withColumn("_prefix", F.explode(prefixes))
    found = step.join(bindings.select(F.col("source").alias("_prefix"), F.col("policy").alias("_policy")), "_prefix")
    best = found.groupBy("_uri").agg(F.max_by("_policy", F.struct(F.length("_prefix"), F.col("_policy"))).alias("_best"))
    out = uris.join(best, F.col(uri) == F.col("_uri"), "left").withColumn("policy", F.coalesce("_best", F.lit(default)))
    return out.drop("_uri", "_best")


def under_prefix(rows: DataFrame, uri: str, prefix: str) -> DataFrame:
    """Rows whose address begins with prefix, character by character; % and _ have no meaning (FLT-02, T-21). The condition reaches the scan."""
    return rows.filter(F.col(uri).startswith(prefix))


#: Modes of a placement line and their number of fields.
PLACEMENTS = {"sync": 1, "sync-advertise": 1, "central": 2, "central-keep": 2, "served-by": 3}


def placements(lines: DataFrame, text: str) -> DataFrame:
    """lines with mode, root, instance, path and error, for the lines of placement files after their header (SRC-15).

    The path is what remains, so it may hold spaces. Blank lines are left out; error is null, or corrupt.
    """
    rows = lines.filter(F.trim(text) != "")
    mode = F.regexp_extract(text, "^([a-z-]+) ", 1)
    one, two, three = "^(?:sync|sync-advertise) (.+)$", "^(?:central|central-keep) ([^ ]*) (.*)$", "^served-by ([^ ]*) ([^ ]*) (.*)$"
    t = F.col(text)
    good = t.rlike(one) | t.rlike(two) | t.rlike(three)
    root = F.when(t.rlike(one), F.regexp_extract(text, one, 1)).when(t.rlike(two), F.regexp_extract(text, two, 1)).when(t.rlike(three), F.regexp_extract(text, three, 1))
    path = F.when(t.rlike(two), F.regexp_extract(text, two, 2)).when(t.rlike(three), F.regexp_extract(text, three, 3))
    return rows.withColumn("mode", F.when(good, mode)).withColumn("root", root).withColumn("instance", F.when(t.rlike(three), F.regexp_extract(text, three, 2))).withColumn("path", path).withColumn("error", F.when(~good, "corrupt"))


def placed(edits: DataFrame) -> DataFrame:
    """root, mode, path: the placement that edits(seq, root, mode, path) leave; one mode a root, the last, and none where it is null (RC-11)."""
    last = edits.groupBy("root").agg(F.max(F.struct("seq", "mode", "path")).alias("_x"))
    return last.select("root", "_x.mode", "_x.path").filter("mode is not null")


def binding_kinds(bindings: DataFrame, placement: DataFrame) -> DataFrame:
    """Active bindings(folder_id, unbound, ...) with kind by their root's placement: mirror if kept, migrate if central, else in-place (JN-12, RC-05)."""
    central = placement.filter("mode in ('central', 'central-keep')").groupBy(F.col("root").alias("folder_id")).agg(F.max(F.col("mode") == "central-keep").alias("_keep"))
    out = bindings.filter("not unbound").join(central, "folder_id", "left")
    return out.withColumn("kind", F.when(F.col("_keep"), "mirror").when(F.col("_keep").isNotNull(), "migrate").otherwise("in-place")).drop("_keep")


def tier_actions(files: DataFrame) -> DataFrame:
    """files(file, location, central, live, attested) -> action by the placement ladder (RC-08)."""
    action = F.when(~F.col("live"), "retire").when(F.col("central") & F.col("attested"), "satisfied").when(F.col("central"), "attest").otherwise("migrate")
    return files.select("file", "location", action.alias("action"))


def tier_plan(files: DataFrame, locations: DataFrame, roots: DataFrame) -> DataFrame:
    """file_id, root, action, uri: what one pass of the mover does for files under central roots (RC-08).

    files(file_id, root, hashed); locations(file_id, uri, foreign, readable): live ones, foreign if another instance's; roots(root, keep, dest, staging, served): served is
    the prefix of rows that name the store's own server. A file is satisfied by a copy in dest, if the root keeps its source, else by any own copy
    outside staging. If it isn't: fail without a readable copy; else attest first if it has no hash, and migrate. Once a copy stands, foreign addresses but served ones
    and those in staging retire, unless the root keeps its source. Prefixes end at a segment; null ones match nothing.
    """
    inside = lambda prefix: F.coalesce(F.col("uri").startswith(F.concat(F.rtrim(F.col(prefix), F.lit("/")), F.lit("/"))), F.lit(False))
    placed_ = files.select("file_id", "root", "hashed").join(roots, "root")
    at = placed_.join(locations.select("file_id", "uri", "foreign", "readable"), "file_id", "left")
    own = F.coalesce(~F.col("foreign"), F.lit(False))
    has = F.when(F.col("keep"), inside("dest")).otherwise(own & ~inside("staging"))
    at = at.withColumn("_has", F.coalesce(has, F.lit(False))).withColumn("_out", ~F.col("keep") & ((F.col("foreign") & ~inside("served")) | inside("staging")))
    per = at.groupBy("file_id", "root", "hashed").agg(F.max("_has").alias("_has"), F.max(F.coalesce("readable", F.lit(False))).alias("_reach"))
    steps = F.when(F.col("_has"), F.array(F.lit("satisfied"))).when(~F.col("_reach"), F.array(F.lit("fail"))).when(F.col("hashed"), F.array(F.lit("migrate"))).otherwise(F.array(F.lit("attest"), F.lit("migrate")))
    done = per.select("file_id", "root", F.explode(steps).alias("action"), F.lit(None).cast("string").alias("uri"))
    fine = per.filter("_has or _reach").select("file_id", "root")
    gone = at.filter("_out").join(fine, ["file_id", "root"], "left_semi").select("file_id", "root", F.lit("retire").alias("action"), "uri").distinct()
    return done.unionByName(gone)


def evictable(locations: DataFrame) -> DataFrame:
    """Retired locations(file, location, live) whose file has a live one elsewhere (RC-09, JN-10)."""
    live = locations.filter("live")
    return locations.filter("not live").select("file", "location").distinct().join(live, ["file", "location"], "left_anti").join(live.select("file"), "file", "left_semi")


def evict_plan(retired: DataFrame, live: DataFrame, consents: DataFrame, store: str = "store://") -> DataFrame:
    """file_id, uri, size, action of the instance's own retired locations(file_id, uri, size) (RC-09): evict, keep (no other live location), or skip.

    A plain file goes only below a prefix(source) whose binding consented to draining; live(file_id, uri) addresses of the store don't count, as they are what a file falls back to.
    """
    held = live.filter(~F.col("uri").startswith(store)).select("file_id").distinct().withColumn("_held", F.lit(True))
    allowed = consents.select(F.rtrim(F.col("source"), F.lit("/")).alias("source"), F.lit("yes").alias("policy")).distinct()
    out = owner_by_prefix(retired.select("file_id", "uri", "size"), allowed, "uri", "no").join(held, "file_id", "left")
    action = F.when(F.col("uri").startswith("file://") & (F.col("policy") == "no"), "skip").when(F.col("_held"), "evict").otherwise("keep")
    return out.select("file_id", "uri", "size", action.alias("action"))


def report(actions: DataFrame, by: str = "action", size: str | None = None) -> DataFrame:
    """by, n and, with size, freed: how often each action is taken, and its bytes (AGG-10)."""
    freed = [F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("freed")] if size else []
    return actions.groupBy(by).agg(F.count("*").alias("n"), *freed)


def missing_bytes(files: DataFrame, held: DataFrame) -> DataFrame:
    """files(file_id, root) under placed roots that have no readable location in held(file_id): what a pull must fetch (GR-13, RC-07)."""
    return files.join(held.select("file_id"), "file_id", "left_anti")


def difference(want: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to add and to retract so that have becomes want (RC-10, SET-05)."""
    side = lambda df, is_want: df.select(*keys, F.lit(is_want).alias("_want"))
    both = spread(side(want, True).unionByName(side(have, False)), *keys, rows=want.count() + have.count())
    per = both.groupBy(*keys).agg(F.max("_want").alias("_add"), F.max(~F.col("_want")).alias("_retract"))
    unlike = reduce(Column.__or__, [F.col(k).isNull() for k in keys])  # null keys match nothing
    add, retract = F.when(F.col("_add") & (~F.col("_retract") | unlike), "add"), F.when(F.col("_retract") & (~F.col("_add") | unlike), "retract")
    return per.select(*keys, F.explode(F.array_compact(F.array(add, retract))).alias("action"))


def claimed_names(rows: DataFrame, parent: str, name: Column, key: str, most_bytes: int = 240) -> DataFrame:
    """rows with export_name, unique within a parent (SNK-04, T-32). Rows claim names in the order of key, which tells them apart.

    A name of more than most_bytes UTF-8 bytes is cut to most_bytes - 40, at a character, and gets ~ and the first eight characters of key. A taken name gets these, then, as
    long as that is taken too, the first name gets them and a number from 1. All rows claim at once and the first claimant of
    a name keeps it; the others claim their next name, until none is refused. That gives what claims one after the other give, in as many rounds as the
    longest series of refusals.
    """
    tag = F.concat(F.lit("~"), F.substring(F.col(key).cast("string"), 1, 8))
    # The longest run of whole characters within the limit.
    long = F.octet_length("_base") > most_bytes
    cut = F.expr(f"decode(unhex(regexp_replace(substring(hex(encode(_base, 'UTF-8')), 1, {2 * (most_bytes - 40)}), '(?:F[0-9A-F](?:[89AB][0-9A-F]){{0,2}}|E[0-9A-F](?:[89AB][0-9A-F]){{0,1}}|[CD][0-9A-F])$', '')), 'UTF-8')")
    base = rows.withColumn("_base", name).withColumn("_tag", tag)
    state = base.select(F.col(parent).alias("_parent"), F.col(key).alias("_key"), "_base", "_tag", F.when(long, F.concat(cut, "_tag")).otherwise(F.col("_base")).alias("_first"), F.lit(0).alias("_try"))
    claim = F.when(F.col("_try") == 0, F.col("_first")).when(F.col("_try") == 1, F.concat("_first", "_tag")).otherwise(F.concat("_base", "_tag", F.lit("-"), (F.col("_try") - 1).cast("string")))
    state = written(state.withColumn("_name", claim), "names")
    while True:
        holders = written(state.groupBy("_parent", "_name").agg(F.min("_key").alias("_holder"), F.count("*").alias("_n")).filter("_n > 1"), "holders")
        if holders.isEmpty():
            break
        joined = state.join(counted(holders.select(F.col("_parent").alias("_p"), F.col("_name").alias("_m"), "_holder")), F.col("_parent").eqNullSafe(F.col("_p")) & (F.col("_name") == F.col("_m")), "left")
        moved = joined.withColumn("_try", F.col("_try") + F.when(F.col("_holder") < F.col("_key"), 1).otherwise(0)).select("_parent", "_key", "_base", "_tag", "_first", "_try")
        state = written(moved.withColumn("_name", claim), "names")
    return rows.drop("export_name").join(state.select("_parent", "_key", F.col("_name").alias("export_name")).hint("merge"), F.col(parent).eqNullSafe(F.col("_parent")) & (F.col(key) == F.col("_key")), "left").drop("_parent", "_key")


def export_plan(walk: DataFrame, sources: DataFrame, mode: str) -> DataFrame:
    """id, rel, action, reason of an export of walk(id, parent_id, node_type, label), one row a place, as links, hard links or copies (SNK-03).

    Folders are made (mkdir), files are linked or copied (mode) from a readable path of sources(id, path), the least of several; others are skipped with reason
    no readable source, or same path (an earlier place of the same file and path). Names are safe and unique in their folder. rel is the path of names below the export's folder; the root,
    whose parent isn't in walk, is that folder and has none.
    """
    from .graph import lifted

    named = claimed_names(walk.select("id", "parent_id", "node_type", "label"), "parent_id", safe_name(F.coalesce("label", F.lit("")), F.col("id")), "id")
    inner = written(met(written(named, "named"), walk.select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_semi"), "inner")
    rel = lifted(inner.select(F.col("id").alias("node"), F.col("parent_id").alias("up"), F.col("export_name").alias("path")), F.concat("high", F.lit("/"), "low"))
    found = sources.filter("path is not null").groupBy("id").agg(F.min("path").alias("path"))
    out = paired(inner.select("id", "node_type"), rel.select(F.col("node").alias("id"), F.col("path").alias("rel")), "id", "inner").join(found.hint("merge"), "id", "left")
    file = F.col("node_type") == "file"
    action = F.when(~file, "mkdir").when(F.col("path").isNull(), "skip").otherwise(mode)
    return out.select("id", "rel", action.alias("action"), F.when(file & F.col("path").isNull(), "no readable source").alias("reason"))


def export_prune(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, depth of an earlier manifest's paths that the new one lacks, deepest first (SNK-05)."""
    gone = old.select("path").distinct().join(new.select("path"), "path", "left_anti")
    return gone.withColumn("depth", F.size(F.split("path", "/")).cast("long")).orderBy(F.desc("depth"), "path")


def routed(events: DataFrame, members: DataFrame, links: DataFrame, marks: DataFrame) -> DataFrame:
    """events with log_id: the region whose log takes each event, or top (SNK-02).

    events: kind, node_id, parent_id and link_id as each kind has them; members(id, region) of nodes that stand; links(id, parent_id, child_id); marks(node_id, enclosing). An
    event goes where its node is; a new link and a move in where the parent is, or is marked; what ends or changes a link where that link's parent is, for a root link where its child is; marking,
    unmarking, baselines and heads of a region go one level up, into the log that encloses it.
    """
    old = links.select(F.col("id").alias("link_id"), F.coalesce("parent_id", "child_id").alias("_old"))
    boundary = F.col("kind").isin("RegionMarked", "RegionUnmarked", "RegionBaseline", "SubRegionHead")
    made = F.col("kind").isin("LinkCreated", "NodeMovedIn") & F.col("parent_id").isNotNull()
    ended = F.col("kind").startswith("Link") | (F.col("kind") == "NodeMovedOut")
    place = F.when(made, F.col("parent_id")).when(ended, F.coalesce("_old", "node_id")).otherwise(F.col("node_id"))
    out = events.join(old, "link_id", "left").withColumn("_place", place)
    mark = marks.select(F.col("node_id").alias("_place"), F.coalesce("enclosing", F.lit("top")).alias("_up"), F.lit(True).alias("_marked"))
    out = out.join(mark, "_place", "left").join(members.select(F.col("id").alias("_place"), F.col("region").alias("_in")), "_place", "left")
    log_id = F.when(boundary, F.coalesce("_up", "_in")).when(F.col("_marked"), F.col("_place")).otherwise(F.col("_in"))
    return out.select(*[c for c in events.columns if c != "log_id"], F.coalesce(log_id, F.lit("top")).alias("log_id"))


def endpoints(entries: DataFrame) -> DataFrame:
    """pin, address of entries(label, payload): children of the endpoints folder, whose payload is an address in UTF-8 (SRC-19). Of several with one pin the least counts."""
    address = F.trim(F.decode("payload", "UTF-8"))
    return entries.select(F.col("label").alias("pin"), address.alias("address")).filter("address <> ''").groupBy("pin").agg(F.min("address").alias("address"))


def candidates(locations: DataFrame, registry: DataFrame, catalog: DataFrame) -> DataFrame:
    """file_id, pin, path, address, via of remote locations(file_id, uri) (JN-15): where each may be fetched.

    registry(pin, address) goes before catalog(pin, address), as endpoints gives it; pins that neither knows have no address and via null.
    """
    parts = location_parts(F.col("uri"))
    away = locations.select("file_id", parts["kind"].alias("_kind"), parts["owner"].alias("pin"), parts["path"].alias("path")).filter("_kind = 'remote'").drop("_kind")
    one = lambda df, name: df.groupBy("pin").agg(F.min("address").alias(name))
    out = away.join(one(registry, "_own"), "pin", "left").join(one(catalog, "_told"), "pin", "left")
    return out.select("file_id", "pin", "path", F.coalesce("_own", "_told").alias("address"), F.when(F.col("_own").isNotNull(), "registry").when(F.col("_told").isNotNull(), "catalog").alias("via"))


def local_paths(locations: DataFrame, own_pin: str, store_dir: str, spool_dir: str) -> DataFrame:
    """locations(file_id, uri, ...) with path and place: local, remote or unknown (RD-07).

    Files here, in the spool and in the store, and those of the own pin, have a path; another pin's are remote and have none.
    """
    p = location_parts(F.col("uri"))
    kind, here = p["kind"], p["kind"].isin("local") | ((p["kind"] == "remote") & (p["owner"] == own_pin))
    path = F.when(here, p["path"]).when(kind == "temp", F.concat(F.lit(spool_dir.rstrip("/")), p["path"])).when(kind == "store", F.concat_ws("/", F.lit(store_dir.rstrip("/")), F.substring(p["path"], 1, 2), p["path"]))
    place = F.when(path.isNotNull(), "local").when(kind == "remote", "remote").otherwise("unknown")
    return locations.withColumn("path", path).withColumn("place", place)


def unlinked(files: DataFrame, links: DataFrame, tree: str) -> DataFrame:
    """tree, file_id: files(id) that no live link of tree(parent_id) shows yet: what a backfill links, and a second run doesn't again (RC-19, MU-24)."""
    have = links.filter((F.col("parent_id") == tree) & ~F.col("removed")).select(F.col("child_id").alias("id"))
    return files.select("id").distinct().join(have, "id", "left_anti").select(F.lit(tree).alias("tree"), F.col("id").alias("file_id"))


def user_refs(wanted: DataFrame, links: DataFrame, files: DataFrame) -> DataFrame:
    """parent_id, child_id, action of wanted(parent_id, child_id), references from users' trees to files(id) (RC-23): add, exists, or unknown for no such file; each once."""
    have = links.filter("not removed").select("parent_id", "child_id").distinct().withColumn("_have", F.lit(True))
    known = files.select(F.col("id").alias("child_id")).distinct().withColumn("_known", F.lit(True))
    out = wanted.select("parent_id", "child_id").distinct().join(have, ["parent_id", "child_id"], "left").join(known, "child_id", "left")
    return out.select("parent_id", "child_id", F.when(F.col("_known").isNull(), "unknown").when(F.col("_have"), "exists").otherwise("add").alias("action"))


def scan_job(found: DataFrame, known: DataFrame) -> DataFrame:
    """job, n_found, n_new, n_known of a dry run over found(job, uri) against known(uri) (RC-18). Each address counts once a job."""
    have = known.select("uri").distinct().withColumn("_have", F.lit(True))
    out = found.select("job", "uri").distinct().join(have, "uri", "left")
    return out.groupBy("job").agg(F.count("*").alias("n_found"), F.count(F.when(F.col("_have").isNull(), 1)).alias("n_new"), F.count("_have").alias("n_known"))


def pruned(rows: DataFrame, candidates_: DataFrame, key: str, by: str, at: int) -> tuple[DataFrame, DataFrame]:
    """What is left of rows without candidates, and an audit row (key, action, by, at) for each that goes (RC-21, MU-22)."""
    gone = rows.join(candidates_.select(key).distinct(), key, "left_semi").select(key).distinct()
    audit = gone.select(key, F.lit("prune").alias("action"), F.lit(by).alias("by"), F.lit(at).cast("long").alias("at"))
    return rows.join(candidates_.select(key), key, "left_anti"), audit


def job_states(reports: DataFrame) -> DataFrame:
    """job, enabled, state, last_ok, last_error, error from reports(job, seq, enabled, state, at, error) (RD-14): the last report, the last success and the last failure of each job."""
    ok, bad = F.col("state") == "ok", F.col("state") == "error"
    last = F.max(F.struct("seq", "enabled", "state")).alias("_x")
    out = reports.groupBy("job").agg(last, F.max(F.when(ok, F.struct("seq", "at"))).alias("_ok"), F.max(F.when(bad, F.struct("seq", "at", "error"))).alias("_bad"))
    return out.select("job", "_x.enabled", "_x.state", F.col("_ok.at").alias("last_ok"), F.col("_bad.at").alias("last_error"), F.col("_bad.error").alias("error"))

