"""Folds against a plain replay, deep forests, names claimed in turn, streams that stop and go on, and awkward tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sylva.functions import scalars as S
from sylva.operators import authz, fold, graph, intervals, reconcile, sets, verify
from sylva.sources import tables
from sylva.streaming import twins

LOG = "seq long, kind string, at long, link_id string, other_id string, parent_id string, child_id string, link_type string, order_key string, node_id string, pubkey string, device_index long, principal_kind int, principal_id string, rights int, expires_at long, author string, tag string, granted boolean, uri string, root string, head_seq long, node_type string, label string"
NAMES = [c.split()[0] for c in LOG.split(", ")]
KINDS = [
    "LinkCreated", "LinkCreated", "LinkRemoved", "LinkReordered", "LinkSuperseded", "LinkSuspended", "LinkUnsuspended", "NodeMovedIn", "NodeMovedOut", "DeviceAuthorized", "DeviceRevoked", "RecoveryKeyRegistered", "RecoveryKeyRevoked", "RootRotated",
    "AclSet", "MemberTagged", "NodeCreated", "NodePurged", "FileLocationAdded", "FileLocationRemoved", "FolderBound", "FolderUnbound", "RegionMarked", "RegionUnmarked", "RegionBaseline", "SubRegionHead",
]


def random_log(rng, n):
    moves, rows = 0, []
    for seq in range(1, n + 1):
        kind = rng.choice(KINDS)
        if kind == "RootRotated" and rng.random() < 0.8:
            kind = "LinkCreated"
        row = dict.fromkeys(NAMES)
        row |= {"seq": seq, "kind": kind, "at": seq * 10, "link_id": f"l{rng.randrange(12)}", "parent_id": f"n{rng.randrange(4)}", "child_id": f"n{rng.randrange(9)}", "link_type": "contains", "order_key": f"o{seq}", "node_id": f"n{rng.randrange(9)}", "pubkey": f"k{rng.randrange(6)}"}
        row |= {"device_index": seq % 3 - 1, "principal_kind": rng.randrange(4), "principal_id": f"p{rng.randrange(3)}", "rights": rng.randrange(4), "expires_at": seq, "author": f"k{rng.randrange(3)}", "tag": "t", "granted": rng.random() < 0.6, "uri": f"u{rng.randrange(4)}", "root": f"h{seq}", "head_seq": seq, "node_type": "f", "label": f"x{seq}"}
        if kind == "LinkSuperseded":
            row["other_id"] = "l99"
        if kind == "NodeMovedIn":  # each move's halves come once
            moves += 1
            row["other_id"] = f"m{moves}"
        if kind == "NodeMovedOut" and moves and rng.random() < 0.7:
            row["link_id"] = f"m{rng.randrange(1, moves + 2)}"
            if any(r["kind"] == kind and r["link_id"] == row["link_id"] for r in rows):
                row["kind"] = "LinkReordered"
        if kind == "LinkCreated" and moves and rng.random() < 0.4:
            row["link_id"] = f"m{rng.randrange(1, moves + 1)}"
        rows.append(row)
    return rows


def replay(rows):
    """What each event does, one after the other."""
    links, pending, devices, recovery, acl, tags, nodes, purged, places, bound, regions = {}, {}, {}, {}, {}, {}, {}, set(), {}, {}, {}
    for e in rows:
        k, link = e["kind"], links.get(e["link_id"])

        def create(removed=None, e=e):
            links[e["link_id"]] = [e["parent_id"], e["child_id"], e["link_type"], e["order_key"], e["at"], removed, None, None]

        def half(key, side):
            pending.setdefault(key, set()).add(side)
            if len(pending[key]) == 2:
                del pending[key]

        if k == "LinkCreated":
            create(next((r["at"] for r in reversed(rows[: e["seq"] - 1]) if r["kind"] == "NodeMovedIn" and r["other_id"] == e["link_id"]), None) if "in" in pending.get(e["link_id"], ()) else None)
        elif k == "NodeMovedIn":
            if e["other_id"] in links:
                links[e["other_id"]][5] = e["at"]
            half(e["other_id"], "in")
            create()
        elif k == "NodeMovedOut":
            if link:
                link[5] = e["at"]
            half(e["link_id"], "out")
        elif k == "LinkRemoved" and link:
            link[5] = e["at"]
        elif k == "LinkReordered" and link:
            link[3] = e["order_key"]
        elif k == "LinkSuperseded" and link:
            link[6] = e["other_id"]
        elif k == "LinkSuspended" and link:
            link[7] = e["at"]
        elif k == "LinkUnsuspended" and link:
            link[7] = None
        elif k == "DeviceAuthorized":
            devices.setdefault(e["pubkey"], [e["device_index"], e["at"], None])
        elif k == "DeviceRevoked" and e["pubkey"] in devices:
            devices[e["pubkey"]][2] = e["at"]
        elif k == "RecoveryKeyRegistered":
            recovery.setdefault(e["pubkey"], e["at"])
        elif k == "RecoveryKeyRevoked":
            recovery.pop(e["pubkey"], None)
        elif k == "RootRotated":
            recovery.clear()
        elif k == "AclSet":
            key = (e["node_id"], e["principal_kind"], e["principal_id"], e["author"] if e["principal_kind"] == 3 else "")
            acl.pop(key, None)
            if e["rights"]:
                acl[key] = (e["rights"], e["at"], e["expires_at"])
        elif k == "MemberTagged":
            tags.pop((e["pubkey"], e["tag"], e["author"]), None)
            if e["granted"]:
                tags[e["pubkey"], e["tag"], e["author"]] = e["at"]
        elif k == "NodeCreated" and e["node_id"] not in purged:
            nodes.setdefault(e["node_id"], (e["node_type"], e["label"], e["at"]))
        elif k == "NodePurged":
            purged.add(e["node_id"])
            nodes.pop(e["node_id"], None)
            places = {p: v for p, v in places.items() if p[0] != e["node_id"]}
        elif k == "FileLocationAdded":
            places[e["node_id"], e["uri"]] = [e["at"], None]
        elif k == "FileLocationRemoved" and (e["node_id"], e["uri"]) in places:
            places[e["node_id"], e["uri"]][1] = e["at"]
        elif k == "FolderBound":
            bound[e["node_id"]] = [e["uri"], e["at"], None]
        elif k == "FolderUnbound" and e["node_id"] in bound:
            bound[e["node_id"]][2] = e["at"]
        elif k == "RegionMarked":
            regions.setdefault(e["node_id"], [None] * 5)[0] = e["at"]
        elif k == "RegionUnmarked":
            regions.pop(e["node_id"], None)
        elif k == "RegionBaseline" and e["node_id"] in regions:
            regions[e["node_id"]][1:] = [e["seq"], e["root"], None, None]
        elif k == "SubRegionHead" and e["node_id"] in regions:
            regions[e["node_id"]][3:] = [e["head_seq"], e["root"]]
    flat = lambda d: {(*(k if isinstance(k, tuple) else (k,)), *(v if isinstance(v, (list, tuple)) else (v,))) for k, v in d.items()}
    return {"links": flat(links), "device_keys": flat(devices), "recovery_keys": flat(recovery), "acl": flat(acl), "member_tags": flat(tags), "nodes": flat(nodes), "file_locations": flat(places), "folder_bindings": flat(bound), "regions": flat(regions), "pending_moves": {(k, next(iter(v))) for k, v in pending.items()}, "purged_nodes": {(n,) for n in purged}}


def test_folds_equal_a_plain_replay(spark):
    for seed in (1, 2):
        rows = random_log(random.Random(seed), 700)
        log = spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], LOG).repartition(3)
        got, want = fold.projection(log), replay(rows)
        for name, relation in want.items():
            found = got[name].select("link_id", "half") if name == "pending_moves" else got[name]
            assert {tuple(r) for r in found.collect()} == relation, name


def test_folds_of_an_empty_log(spark):
    log = spark.createDataFrame([], LOG)
    assert all(df.count() == 0 for df in fold.projection(log).values())
    assert fold.gaps(log.withColumn("log_id", F.lit("x")), ["log_id"]).count() == 0
    nulls = spark.createDataFrame([(1, "LinkCreated", *[None] * 22), (2, None, *[None] * 22)], LOG)
    assert fold.projection(nulls)["links"].count() == 1


def test_gaps_across_blocks(spark):
    seqs = [1, 2, 5, 6, 7, 8, 20, 21, 40]
    log = spark.createDataFrame([("a", s) for s in seqs] + [("b", 3)], "log_id string, seq long")
    want = {("a", 5, 2, 2), ("a", 20, 8, 11), ("a", 40, 21, 18)}
    for block in (1, 4, 7, 1000):
        assert {(r.log_id, r.seq, r.after, r.missing) for r in fold.gaps(log, ["log_id"], block).collect()} == want


def test_replay_stops_at_the_first_bad_row(spark):
    log = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 3, -1), ("b", 1, 7)], "log_id string, seq long, v int")
    got = {(r.log_id, r.seq): r.error for r in fold.replayed(log, [("known", F.col("v").isNotNull()), ("positive", F.col("v") > 0)]).collect()}
    assert got == {("a", 1): None, ("a", 2): "known", ("a", 3): "stopped", ("b", 1): None}


# --- depth -------------------------------------------------------------------------------------------------------


def test_a_chain_of_ten_thousand(spark):
    n = 10_000
    edges = spark.range(1, n + 1).select(F.col("id").alias("node"), F.when(F.col("id") < n, F.col("id") + 1).alias("next"))
    got = graph.chains(edges)
    assert got.filter("head = 1 and position = node - 1").count() == n


def test_a_forest_of_depth_three_hundred(spark):
    n = 300
    nodes = spark.range(n + 1).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("folder").alias("node_type"), F.col("id").cast("string").alias("label"))
    links = spark.range(n).select(F.concat(F.lit("l"), "id").alias("id"), F.concat(F.lit("n"), "id").alias("parent_id"), F.concat(F.lit("n"), F.col("id") + 1).alias("child_id"), F.lit("contains").alias("link_type"), F.lit("V").alias("order_key"), F.lit(False).alias("removed"), F.lit(False).alias("suspended"))
    assert graph.walk(nodes, links, "n0").filter(f"id = 'n{n}' and depth = {n}").count() == 1
    assert graph.walk(nodes, links, "n100", most_depth=3).count() == 4
    assert graph.paths(nodes, links).filter(f"id = 'n{n}'").first().path == "/".join(map(str, range(n + 1)))
    closure = graph.ancestors(links)
    assert closure.count() == n * (n + 1) // 2 and closure.filter(f"node = 'n{n}' and ancestor = 'n0' and distance = {n}").count() == 1
    deep = spark.createDataFrame([("/".join(map(str, range(1, 41))),), ("1/3",), ("//1//2/",), (None,)], "path string")
    assert {r.path: r.id for r in graph.resolved(deep, nodes, links, "n0").collect()} == {"/".join(map(str, range(1, 41))): "n40", "1/3": None, "//1//2/": "n2", None: None}


def test_graphs_of_nothing(spark):
    nodes = spark.createDataFrame([], "id string, node_type string, label string")
    links = spark.createDataFrame([], "id string, parent_id string, child_id string, link_type string, order_key string, removed boolean, suspended boolean")
    places = spark.createDataFrame([], "file_id string, uri string, removed boolean")
    ids = spark.createDataFrame([], "id string")
    for df in (graph.walk(nodes, links, "r"), graph.ancestors(links), graph.paths(nodes, links), graph.rooted(nodes, links), graph.region_of(nodes, links, spark.createDataFrame([], "node string")), graph.purge_cascade(links, ids, ids), graph.removal(nodes, links, ids, places, 1), graph.homes(links, links)):
        assert df.count() == 0
    odd = spark.createDataFrame([(None, None, None, "contains", None, False, False), ("1", "a", None, "contains", None, False, False), ("2", None, "b", "contains", None, False, False)], links.schema)
    some = spark.createDataFrame([("b", "folder", None), ("c", None, None)], nodes.schema)
    assert {(r.id, r.valid, r.reason) for r in graph.rooted(some, odd).collect()} == {("b", True, "root"), ("c", False, "no parent")}
    assert graph.walk(some, odd, "b").count() == 1 and {r.path for r in graph.paths(some, odd).collect()} == {""}


# --- names, scans, rights ----------------------------------------------------------------------------------------


def claimed(rows):
    used, out = set(), {}
    for key, base in sorted(rows):
        tag = f"~{key[:8]}"
        name = base
        if len(base.encode()) > 60:
            name = base.encode()[:20].decode("utf-8", "ignore") + tag
        if name in used:
            name += tag
            n = 1
            while name in used:
                name = f"{base}{tag}-{n}"
                n += 1
        used.add(name)
        out[key] = name
    return out


def test_names_are_claimed_as_if_in_turn(spark):
    rng = random.Random(3)
    bases = ["a", "b", "a~k0000001", "a~k0000002", "b~k0000005~k0000009", "é" * 40, "日本" * 11, "🙂" * 16, "a~k0000003-1"]
    rows = [(f"k{i:07}", rng.choice(bases)) for i in range(60)]
    df = spark.createDataFrame([(None if i % 2 else "p", k, b, "x") for i, (k, b) in enumerate(rows)], "parent string, k string, n string, _name string")
    got = {r.k: r.export_name for r in reconcile.claimed_names(df, "parent", F.col("n"), "k", most_bytes=60).collect()}
    assert got == claimed(rows[::2]) | claimed(rows[1::2])


def test_scalars_refuse_what_is_malformed(spark):
    value = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [value(S.parse_rights(F.lit(x))) for x in ("rwa", "rx", "", "-")] == [7, None, 0, 0]
    assert [value(S.duration_ms(F.lit(x))) for x in ("99999999999999999999s", "9223372036854775807w", "@0")] == [None, None, None]
    assert value(S.byte_range(F.lit("99999999999999999999-"))["start"]) is None and value(S.byte_range(F.lit("1-2"))["end"]) == 2
    assert [value(S.safe_name(F.lit(x), F.lit("0123456789"))) for x in (".", "..", " a ", "a/b")] == ["node-01234567", "node-01234567", "a", "a_b"]
    assert S.pi_hex(16) == "243F6A8885A308D3" and value(S.checkpoint(F.lit(1), "0123456789ABCDEF" * 8)) == ("0123456789ABCDEF" * 8)[32:64]
    none = F.lit(None).cast("string")
    assert all(value(c) is None for c in (S.guess_mime(none), S.parse_rights(none), S.duration_ms(none), S.safe_name(none, F.lit("k")), S.default_visibility(none), S.location_parts(none)["kind"]))


def test_rights_of_hot_folders_and_strangers(spark):
    keys = spark.createDataFrame([("m", -1, 1, None), ("gone", -1, 1, 2)], "pubkey string, device_index long, authorized_at long, revoked_at long")
    acl = spark.createDataFrame([("f", authz.KEY, f"k{i}", "", 1, 0) for i in range(50)] + [("f", authz.KEY, "m", "", 4, 0), ("f", authz.KEY, "gone", "", 4, 0), ("f", authz.ANY, "", "", 2, 0), (None, authz.PUBLIC, None, None, 1, 0)], "node_id string, principal_kind int, principal_id string, authority string, rights int, expires_at long")
    tags = spark.createDataFrame([], "member string, tag string, authority string")
    closure = spark.createDataFrame([("x", "f", 1)], "node string, ancestor string, distance int")
    pairs = spark.createDataFrame([(p, "x") for p in ("m", "gone", "k7", "k99", None)] + [("m", None)], "principal string, node_id string")
    got = {(r.principal, r.node_id): r.rights for r in authz.effective_rights(pairs, closure, acl, keys, tags, 5).collect() if r.principal and r.node_id}
    assert got == {("m", "x"): 6, ("gone", "x"): 0, ("k7", "x"): 1, ("k99", "x"): 0}


def test_a_missing_source_removes_nothing(spark):
    seen = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 2, 1)], "folder_id int, uri string, size int, mtime int")
    known = spark.createDataFrame([(1, "a", 1, 1, False), (1, "c", 1, 1, False), (1, "d", 1, 1, True), (2, "z", 1, 1, False)], "folder_id int, uri string, size int, mtime int, removed boolean")
    bound = spark.createDataFrame([(1, True), (2, False)], "folder_id int, source_found boolean")
    assert {tuple(r) for r in reconcile.scan_bindings(bound, seen, known).collect()} == {(1, "a", "unchanged"), (1, "b", "new"), (1, "c", "removed"), (2, None, "source_missing")}


def test_files_of_a_folder(spark, tmp_path):
    for name in ("a.txt", "d/b.MKV", "d/.hidden", ".h/c.txt", "d/e/f.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    assert {r.rel for r in tables.files(spark, str(tmp_path)).collect()} == {"a.txt", "d/b.MKV", "d/e/f.txt"}
    found = tables.files(spark, str(tmp_path), "mkv", content=True).collect()
    assert [(r.rel, r.name, r.length, bytes(r.content)) for r in found] == [("d/b.MKV", "b.MKV", 7, b"x" * 7)]


def test_chain_heads_stream_through_long_logs(spark):
    import hashlib

    rows = [("a", i, "k", "b" * (i % 7)) for i in range(1, 3000)] + [("b", 1, "k", None)]
    log = spark.createDataFrame(rows, "log_id string, seq long, kind string, body string").repartition(5)
    want = {}
    for log_id, seq, kind, body in rows:
        line = "|".join(str(x) for x in (seq, kind, body) if x is not None)
        want[log_id] = hashlib.sha256(f"{want.get(log_id, '0')}|{line}".encode()).hexdigest()
    assert {r.log_id: r.head for r in verify.chain_heads(log, "0").collect()} == want
    assert verify.chain_heads(log.limit(0), "0").count() == 0


def test_intervals_and_progress_with_nulls(spark):
    ranges = spark.createDataFrame([("f", 0, 4), ("f", 2, None), (None, 1, 2), ("f", 3, 9)], "k string, start long, end long")
    assert {tuple(r) for r in intervals.islands(ranges, "k").select("k", "start", "end").collect()} == {("f", 0, 9), (None, 1, 2)}
    files = spark.createDataFrame([("s", "f", 10, False), ("s", "g", 5, None)], "session string, file_id string, length long, committed boolean")
    merged = spark.createDataFrame([("f", 0, 4), ("f", 7, 10)], "file_id string, start long, end long")
    assert {(r.file_id, r.verified, r.chunks_done, r.chunks_total, r.state) for r in intervals.session_progress(files, merged, 4).collect()} == {("f", 7, 2, 3, "running"), ("g", 0, 0, 2, "waiting")}


# --- streams -----------------------------------------------------------------------------------------------------


def events_in_parts(spark, folder, parts):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").filter("event_id < 300")
    for i in parts:
        rows.filter(f"event_id % 3 = {i}").coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


@pytest.mark.parametrize("run", [twins.fold_last, twins.open_pairs, twins.fold_links, twins.islands])
def test_streams_go_on_where_they_stopped(spark, tmp_path, run):
    base, d = twins.new_base(spark), str(tmp_path)
    events_in_parts(spark, d, [0])
    first = run(spark, d, base, 1).count()
    events_in_parts(spark, d, [1, 2])
    later = sorted(map(tuple, run(spark, d, base, 1).collect()), key=str)
    again = sorted(map(tuple, run(spark, d, base, 1).collect()), key=str)
    whole = sorted(map(tuple, run(spark, d).collect()), key=str)
    assert 0 < first and later == again == whole


def test_arrivals_in_several_batches(spark, tmp_path):
    d, base = str(tmp_path), twins.new_base(spark)
    schema = "log_id string, seq long, hash string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{d}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")
    put([("a", 1, "h1"), ("a", 2, "h2"), ("b", 1, "x")])
    assert twins.arrivals(stream(), base).count() == 3
    put([("a", 2, "h2"), ("a", 3, "h3"), ("b", 3, "z")])
    put([("a", 2, "other"), ("b", 2, "y")])
    got = {(r.log_id, r.seq, r.hash, r.action) for r in twins.arrivals(stream(), base).collect()}
    assert got == {("a", 1, "h1", "append"), ("a", 2, "h2", "append"), ("b", 1, "x", "append"), ("a", 2, "h2", "skip"), ("a", 3, "h3", "append"), ("b", 3, "z", "broken"), ("a", 2, "other", "broken"), ("b", 2, "y", "broken")}


def test_hot_ranges_expire(spark, tmp_path):
    import datetime

    d, base = str(tmp_path), twins.new_base(spark)
    schema = "user_id long, ts timestamp, start long, end long"
    t = lambda minute: datetime.datetime(2024, 1, 1, 12, 0) + datetime.timedelta(minutes=minute)
    stream = lambda: spark.readStream.schema(schema).parquet(f"{d}/in")
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{d}/in")
    read = lambda: {tuple(r) for r in twins.hot_ranges(stream(), "10 minutes", "1 minute", base).collect()}
    put([(1, t(0), 0, 5), (1, t(1), 5, 9), (2, t(0), 3, 4)])
    assert read() == {(1, 0, 9), (2, 3, 4)}
    put([(1, t(30), 20, 30)])
    assert (1, 20, 30) in read()
    put([(3, t(31), 1, 2)])
    assert read() == {(1, 20, 30), (3, 1, 2)}


def test_added_columns_replace_their_namesakes(spark):
    rows = spark.createDataFrame([(1, "x")], "id long, temp string")
    assert sets.durable_and_temp(rows, rows).select("temp").distinct().count() == 2
    lines = spark.createDataFrame([("central a /b c", "old")], "line string, mode string")
    assert reconcile.placements(lines, "line").first().asDict() == {"line": "central a /b c", "mode": "central", "root": "a", "instance": None, "path": "/b c", "error": None}


# --- tables of one hot key ---------------------------------------------------------------------------------------


def test_joins_on_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 16)
    left = tables.written(spark.createDataFrame([("hot" if i < 60 else None if i < 80 else f"k{i % 30}" if i < 110 else "alone", i) for i in range(150)], "key string, i int"), "left")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 30, 2)] + [(None, 5)], "key string, v int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        got = tables.met(left, right, "key", how)
        assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "key", how).collect()))


def test_a_cascade_broadcasts_no_table(spark, monkeypatch):
    plans, write = [], tables.written

    def written(df, name):
        plans.append(f"{name}: {df._jdf.queryExecution().executedPlan().toString()}")
        return write(df, name)

    monkeypatch.setattr(tables, "written", written)
    monkeypatch.setattr(graph, "written", written)
    link = lambda *rows: spark.createDataFrame([(None, p, c, "contains", None, gone, False) for p, c, gone in rows], "id string, parent_id string, child_id string, link_type string, order_key string, removed boolean, suspended boolean")
    links = link(("a", "x", False), ("a", "x", False), ("b", "x", True), ("a", "y", False), ("b", "y", False), ("x", "z", False), ("z", "deep", False), ("x", "kept", False), ("a", "a", False), (None, "x2", False), ("a", "x2", False), ("a", None, False))
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "id string")
    gone = graph.purge_cascade(links, ids("a", "a"), ids("a", "x", "x", "x2", "y", "z", "deep", None))
    assert sorted(map(tuple, gone.collect())) == [("a", 0), ("deep", 3), ("x", 1), ("z", 2)]
    assert len(plans) > 10 and not [x for x in plans if "Broadcast" in x]
    pair = tables.paired(links.withColumnRenamed("child_id", "key"), ids("x", "y").withColumnRenamed("id", "key"), "key", "left_semi")
    assert pair.count() == 5 and "Broadcast" not in pair._jdf.queryExecution().executedPlan().toString()


def test_walks_broadcast_no_table(spark, monkeypatch):
    plans, write = [], tables.written
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def written(df, name):
        plans.append(f"{name}: {plan(df)}")
        return write(df, name)

    monkeypatch.setattr(tables, "written", written)
    monkeypatch.setattr(graph, "written", written)
    links = write(spark.range(9).select(F.concat(F.lit("n"), "id").alias("parent_id"), F.concat(F.lit("n"), F.col("id") + 1).alias("child_id"), F.lit("contains").alias("link_type"), F.lit("V").alias("order_key"), F.lit(False).alias("removed"), F.lit(False).alias("suspended")), "links")
    nodes = write(spark.range(10).select(F.concat(F.lit("n"), "id").alias("id"), F.when(F.col("id") == 0, "root").otherwise("folder").alias("node_type"), F.col("id").cast("string").alias("label")), "nodes")
    closure = graph.ancestors(links)
    moves = spark.createDataFrame([("n2", "n5"), ("n5", "n2")], "child string, new_parent string")
    assert closure.count() == 45 and [(r.child, r.distance, r.path) for r in graph.would_cycle(moves, closure).collect()] == [("n2", 3, ["n5", "n4", "n3", "n2"])]
    edges = write(nodes.select(F.col("id").alias("node")).join(links.select(F.col("parent_id").alias("node"), F.col("child_id").alias("next")), "node", "left"), "edges")
    chains = graph.chains(edges)
    assert {(r.head, r.position) for r in chains.collect()} == {("n0", i) for i in range(10)}
    assert "Broadcast" not in plan(graph.rooted(nodes, links)) and "Broadcast" not in plan(closure)
    plans = [x for x in plans if not x.startswith("below:")]  # few last ones go to all links
    assert len(plans) > 10 and not [x for x in plans if "Broadcast" in x]
    paths = spark.createDataFrame([("1/2/3",), ("1/3",)], "path string")
    found = graph.resolved(paths, nodes, links, "n0")
    assert {r.path: r.id for r in found.collect()} == {"1/2/3": "n3", "1/3": None} and "Broadcast" not in plan(found)


def test_rows_of_one_task_do_not_grow(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 100)
    n = 4000
    nodes = spark.range(n + 1).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("folder").alias("node_type"), F.col("id").cast("string").alias("label"))
    parent = F.when(F.col("id") < 3, F.lit(0)).otherwise(F.lit(1))  # one folder holds nearly all
    links = spark.range(1, n + 1).select(F.concat(F.lit("n"), parent.cast("string")).alias("parent_id"), F.concat(F.lit("n"), "id").alias("child_id"), F.lit("contains").alias("link_type"), F.lit("V").alias("order_key"), F.lit(False).alias("removed"), F.lit(False).alias("suspended"))
    most = lambda df: max(len(p) for p in df.rdd.glom().collect())
    known = graph.lifted(links.select(F.col("child_id").alias("node"), F.col("parent_id").alias("up")))
    assert known.filter("top = 'n0'").count() == n
    assert graph.walk(nodes, links, "n0").count() == n + 1
    assert {r.id: r.path for r in graph.paths(nodes, links).filter("id in ('n1', 'n9')").collect()} == {"n1": "0/1", "n9": "0/1/9"}
    want = spark.range(n).select(F.col("id").alias("file"))
    found = reconcile.difference(want.filter("file % 2 = 0"), want.filter("file % 3 = 0"), ["file"])
    assert most(found) < 300
    assert most(tables.paired(nodes, links.withColumnRenamed("child_id", "id"), "id", "left")) < 300


def test_difference_with_nulls(spark):
    rows = lambda *xs: spark.createDataFrame(list(xs), "a string, b int")
    got = reconcile.difference(rows(("x", 1), ("x", 1), ("y", 2), (None, 3)), rows(("y", 2), ("z", 4), ("z", 4), (None, 3)), ["a", "b"])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [("x", 1, "add"), (None, 3, "add"), ("z", 4, "retract"), (None, 3, "retract")]))
