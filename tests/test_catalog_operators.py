"""Small cases of the catalog operators: order, cycles, ties, nulls, empty tables."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from sylva.functions import scalars as S
from sylva.operators import authz, fold, graph, intervals, media, reconcile, verify
from sylva.sources.tables import batch_cut, log_tips

LINKS = "id string, parent_id string, child_id string, link_type string, order_key string, removed boolean, suspended boolean"
NODES = "id string, node_type string, label string"


@pytest.fixture(scope="module")
def forest(spark):
    """root holds b before a before c; a refers to c; x lies under c by a suspended link, y by a removed one."""
    nodes = spark.createDataFrame([(x, "folder", x.upper()) for x in ("root", "a", "b", "c", "in", "x", "y")], NODES)
    links = spark.createDataFrame(
        [
            ("1", "root", "a", "contains", "V", False, False), ("2", "root", "b", "contains", "G", False, False), ("3", "root", "c", "contains", "k", False, False),
            ("4", "a", "in", "contains", "V", False, False), ("5", "a", "c", "ref", "W", False, False), ("6", "c", "x", "contains", "V", False, True),
            ("7", "c", "y", "contains", "V", True, False), ("8", "b", "lost", "contains", "V", False, False),
        ],
        LINKS,
    )
    return nodes, links


def test_walk_is_pre_order_and_does_not_descend_references(forest):
    found = graph.walk(*forest, "root").orderBy("sort_path").collect()
    assert [(r.id, r.depth, r.link_type) for r in found] == [("root", 0, "contains"), ("b", 1, "contains"), ("a", 1, "contains"), ("in", 2, "contains"), ("c", 2, "ref"), ("c", 1, "contains")]
    assert graph.walk(*forest, "root", most_depth=0).count() == 1
    assert graph.walk(*forest, "nowhere").count() == 0


def test_a_cycle_is_an_error(spark):
    nodes = spark.createDataFrame([("a", "folder", "a"), ("b", "folder", "b")], NODES)
    links = spark.createDataFrame([("1", "a", "b", "contains", "V", False, False), ("2", "b", "a", "contains", "V", False, False)], LINKS)
    with pytest.raises(ValueError):
        graph.walk(nodes, links, "a")
    with pytest.raises(ValueError):
        graph.ancestors(links)
    ring = spark.createDataFrame([(i, i % 7 + 1) for i in range(1, 8)], "node long, next long")
    with pytest.raises(ValueError):
        graph.chains(ring)


def test_children_order_and_positions(forest):
    found = graph.children(*forest).filter("parent_id = 'root'").orderBy("position").collect()
    assert [(r.child_id, r.position) for r in found] == [("b", 1), ("a", 2), ("c", 3)]


def test_closure_paths_and_orphans(forest):
    nodes, links = forest
    closure = graph.ancestors(links.filter("link_type = 'contains' and not removed"))
    assert {(r.ancestor, r.distance) for r in closure.filter("node = 'x'").collect()} == {("c", 1), ("root", 2)}
    paths = {r.id: r.path for r in graph.paths(nodes, links.filter("link_type = 'contains' and not removed")).collect()}
    assert paths["in"] == "ROOT/A/IN" and paths["root"] == "ROOT"
    assert {r.id for r in graph.orphans(nodes, links).collect()} == {"root", "y"}


def test_cycles_regions_and_chains(spark, forest):
    nodes, links = forest
    contains = links.filter("link_type = 'contains' and not removed")
    closure = graph.ancestors(contains)
    moves = spark.createDataFrame([("a", "in"), ("a", "a"), ("a", "b")], "child string, new_parent string")
    assert {(r.child, r.new_parent, r.distance, tuple(r.path)) for r in graph.would_cycle(moves, closure).collect()} == {("a", "in", 1, ("in", "a")), ("a", "a", 0, ("a",))}
    marks = spark.createDataFrame([("a",), ("root",)], "node string")
    regions = {r.id: r.region for r in graph.region_of(nodes, contains, marks).collect()}
    assert regions["in"] == "a" and regions["a"] == "a" and regions["x"] == "root" and regions["y"] == "top"
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, None), (9, None)], "node long, next long")
    assert {tuple(r) for r in graph.chains(edges).select("node", "head", "position").collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 2), (9, 9, 0)}


def test_folds(spark):
    log = spark.createDataFrame(
        [("top", 1, "C", 1, 5), ("top", 2, "D", 1, None), ("top", 3, "C", 2, 7), ("top", 4, "C", 1, 0), ("top", 6, "D", 2, None)],
        "log_id string, seq long, kind string, entity long, value int",
    )
    assert {tuple(r) for r in fold.last_wins(log, ["entity"], ["kind"]).collect()} == {(1, 4, "C"), (2, 6, "D")}
    assert {tuple(r) for r in fold.first_wins(log, ["entity"], ["value"]).collect()} == {(1, 1, 5), (2, 3, 7)}
    assert {tuple(r) for r in fold.reactivated(log, "C", "D", ["entity"], ["value"]).collect()} == {(1, 4, 0, True), (2, 3, 7, False)}
    assert {r.entity for r in fold.deleted_on_zero(log.filter("kind = 'C'"), ["entity"], F.col("value")).collect()} == {2}
    assert [(r.seq, r.after, r.missing) for r in fold.gaps(log, ["log_id"]).collect()] == [(6, 4, 1)]
    assert [r.seq for r in fold.since_reset(log, "C", F.col("kind") == "D").collect()] == []
    assert fold.last_wins(log.limit(0), ["entity"], ["kind"]).count() == 0
    assert {tuple(r) for r in log_tips(log).collect()} == {("top", 6, 5)}


def test_batches_end_after_the_row_that_fills_them(spark):
    log = spark.createDataFrame([("l", i, "x" * 10) for i in range(1, 8)], "log_id string, seq long, body string")
    assert [r.seq for r in batch_cut(log, 5, 25).orderBy("seq").collect()] == [1, 2, 3]
    assert [r.seq for r in batch_cut(log, 5, 20).orderBy("seq").collect()] == [1, 2, 3]  # filled to the byte goes on
    assert [r.seq for r in batch_cut(log, 5, 19).orderBy("seq").collect()] == [1, 2]
    assert [r.seq for r in batch_cut(log, 2, 1000).orderBy("seq").collect()] == [1, 2]


def test_intervals_merge_when_they_touch(spark):
    ranges = spark.createDataFrame([("f", 0, 4), ("f", 4, 6), ("f", 5, 5), ("f", 8, 17), ("g", 3, 3), ("f", 1, 2)], "k string, start long, end long")
    merged = intervals.islands(ranges, "k")
    assert {tuple(r) for r in merged.select("k", "start", "end").collect()} == {("f", 0, 6), ("f", 8, 17)}
    assert {tuple(r) for r in intervals.covered_chunks(merged, "k", 8).collect()} == {("f", 1)}
    assert intervals.progress(merged, "k", 8).first().asDict() == {"k": "f", "n_ranges": 2, "verified": 15, "chunks_done": 1}


def test_chains_show_a_flipped_byte(spark):
    seed, rows, head = "0" * 64, [], "0" * 64
    for i, body in enumerate(["one", "two", "three"], 1):
        head = hashlib.sha256(f"{head}|{i}|k|{body}".encode()).hexdigest()
        rows.append(("l", i, "k", body, head))
    schema = "log_id string, seq long, kind string, body string, chain_hash string"
    log = spark.createDataFrame(rows, schema)
    assert verify.chain_heads(log, seed).first().head == head
    assert verify.broken_links(log, seed).count() == 0
    rows[1] = ("l", 2, "k", "tvo", rows[1][4])
    assert [r.seq for r in verify.broken_links(spark.createDataFrame(rows, schema), seed).collect()] == [2]


def test_commitments_ignore_the_order_of_rows(spark):
    rows = [(f"n{i}", i % 2) for i in range(50)]
    root = lambda x: {tuple(r) for r in verify.commitment(spark.createDataFrame(x, "id string, s int").repartition(3), "s", F.col("id")).collect()}
    assert root(rows) == root(rows[::-1]) != root(rows[1:])


def test_manifests_of_empty_content(spark):
    files = spark.createDataFrame([(1, ""), (2, "abcde"), (3, None)], "k int, t string")
    assert [(r.k, r.chunk, r.length) for r in verify.chunks(files, "k", "t", 2).orderBy("k", "chunk").collect()] == [(2, 0, 2), (2, 1, 2), (2, 2, 1)]
    roots = {r.k: (r.n_chunks, r.root) for r in verify.manifest_roots(files, "k", "t", 2).collect()}
    assert roots[1] == roots[3] == (0, hashlib.sha256(b"").hexdigest()) and roots[2][0] == 3


def test_rights(spark):
    keys = spark.createDataFrame([("own", 0, 1, None), ("mem", -1, 1, None), ("out", -1, 1, 5), ("auth", 0, 1, None), ("dead", 0, 1, 5)], "pubkey string, device_index long, authorized_at long, revoked_at long")
    acl = spark.createDataFrame(
        [
            ("root", 2, "", "", 1, 0), ("a", 0, "", "", 2, 0), ("a", 1, "mem", "", 4, 100), ("in", 3, "t", "auth", 4, 0), ("in", 3, "u", "dead", 2, 0),
        ],
        "node_id string, principal_kind int, principal_id string, authority string, rights int, expires_at long",
    )
    tags = spark.createDataFrame([("mem", "t", "auth"), ("mem", "u", "dead")], "member string, tag string, authority string")
    closure = spark.createDataFrame([("in", "a", 1), ("in", "root", 2), ("a", "root", 1)], "node string, ancestor string, distance int")
    pairs = spark.createDataFrame([(p, n) for p in ("own", "mem", "out", "who") for n in ("in", "a")], "principal string, node_id string")
    at = lambda t: {(r.principal, r.node_id): r.rights for r in authz.effective_rights(pairs, closure, acl, keys, tags, t).collect()}
    assert at(50) == {("own", "in"): 7, ("own", "a"): 7, ("mem", "in"): 7, ("mem", "a"): 7, ("out", "in"): 1, ("out", "a"): 1, ("who", "in"): 1, ("who", "a"): 1}
    assert at(100)[("mem", "a")] == 3  # a grant ends when its time comes
    audits = {k: v.count() for k, v in authz.audit(acl, keys, tags, 100).items()}
    assert audits == {"inert_tag_grants": 1, "inert_memberships": 1, "inert_key_grants": 0, "expired": 1}


def test_reconciliation(spark):
    seen = spark.createDataFrame([(1, 5), (2, 6), (3, 7), (4, 8)], "k int, size int")
    known = spark.createDataFrame([(1, 5, False), (2, 5, False), (3, 7, True), (9, 1, False), (8, 1, True)], "k int, size int, removed boolean")
    assert {tuple(r) for r in reconcile.scan_diff(seen, known, "k").collect()} == {(1, "unchanged"), (2, "changed"), (3, "reactivated"), (4, "added"), (9, "removed"), (8, "gone")}
    want, have = (spark.createDataFrame(x, "f int, l int") for x in ([(1, 1), (1, 1), (2, 1)], [(2, 1), (3, 1)]))
    assert {tuple(r) for r in reconcile.difference(want, have, ["f", "l"]).collect()} == {(1, 1, "add"), (3, 1, "retract")}
    names = spark.createDataFrame([(1, "p", "a"), (2, "p", "a"), (3, "q", "a")], "k int, parent string, n string")
    assert [r.export_name for r in reconcile.claimed_names(names, "parent", F.col("n"), "k").orderBy("k").collect()] == ["a", "a~2", "a"]
    uris = spark.createDataFrame([(1, "file:///x/y/z"), (2, "file:///x/yy"), (3, "http://h")], "i int, uri string")
    bound = spark.createDataFrame([("file:///x", "short"), ("file:///x/y", "long")], "source string, policy string")
    assert {r.i: r.policy for r in reconcile.owner_by_prefix(uris, bound, "uri", "lazy").collect()} == {1: "long", 2: "short", 3: "lazy"}


def test_scores(spark):
    rows = spark.createDataFrame([(1, 0.8), (2, 0.5)], "k int, score double")
    anchors = spark.createDataFrame([(1, 0.4), (1, 0.6), (1, 0.9), (2, 0.7)], "k int, anchor_score double")
    found = {r.k: round(r.effective, 9) for r in media.effective_score(rows, "k", "score", anchors, 0.5).collect()}
    # Weights 1 / 1.4 and 1 / 1.6: the nearer anchor, which is the worse one, pulls less.
    assert found == {1: round(0.8 - 0.5 * (0.4 / 1.4 + 0.2 / 1.6) / (1 / 1.4 + 1 / 1.6), 9), 2: 0.5}
    listing = spark.range(600)
    assert media.page(listing, [F.col("id")], -5, 0).count() == 1 and media.page(listing, [F.col("id")], 0, 9999).count() == 500


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert [value(S.duration_ms(F.lit(x))) for x in ("45s", "2w", "@17", "9", "")] == [45_000, 1_209_600_000, 17, None, None]
    assert [value(S.principal_kind(F.lit(x))) for x in ("any", "key:0af", "public", "tag:a-b", "tag:-b", "key:")] == [0, 1, 2, 3, None, None]
    assert [value(S.format_rights(F.lit(x))) for x in (0, 5, 7)] == ["-", "ra", "rwa"]
    assert value(S.safe_name(F.lit(" /\n"), F.lit("k"))) == "__" and value(S.safe_name(F.lit("  "), F.lit("k"))) == "node-k"
    assert value(S.guess_mime(F.lit("A.MKV"))) == "video/x-matroska" and value(S.guess_mime(F.lit("none"))) == "application/octet-stream"
