"""Each operator on awkward tables, against plain versions."""

import hashlib
import random
import re
import zlib
from itertools import combinations
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.llm.op1_mpegts import access_units, demux, media_features, mux, stored
from sylva.llm.op2_brown import scored
from sylva.llm.op3_bytes import byte_shards
from sylva.llm.op4_license import RULES, license_scan
from sylva.llm.op5_harmonic import cuts, default_tokenizer, pack
from sylva.llm.op6_suffix import SuffixFamily, without_repeats
from sylva.llm.op7_langid import identified, in_a_language, page_evidence
from sylva.llm.op8_pivotal import mix, mixed_copies, pivot, source_targets
from sylva.llm.op9_parsing import edited, fingerprints, likeness, parsed
from sylva.llm.op10_oddsketch import most_odd_bits, near_duplicates, odd_sketches, without_near_duplicates

CLASH = ["size", "shard", "slot", "start", "key", "node", "row", "label", "evidence", "copies", "doc", "n", "h", "bin", "target", "kept", "score", "fold", "media"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "tion", "and", "ere", "Zebra", "apple.", "Être", "漢字", "x"]) + str(rng.randrange(400)) for _ in range(n))


def awkward():
    """Nulls in any column, empty and long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(5)
    base = words(rng, 160)
    near = base.split()
    near[80] = "changed"
    long = words(rng, 9000)
    texts = [base, base, " ".join(near), "", None, " \n\t ", "one", "one two", "ONE  TWO", long, long[:5000] + words(rng, 50), "mit license and Apache License, Version 2.0; CC-BY", "a" * 900, "ab" * 400, words(rng, 300), "GNU General\nPublic License v3 or later", "<|endoftext|> in the text", "\n lead and trail \n"]
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "src0", "src1", "ß"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], rows[9], (2, "another text of document two " + words(rng, 30), "en", None, 3), (None, base, None, None, None), (None, None, None, None, None)]
    return [(*r, *["x"] * len(CLASH)) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def plain(spark):
    """Documents with distinct ids, as the plain versions below want them."""
    rows = {r[0]: r for r in awkward() if r[0] is not None}
    return spark.createDataFrame(list(rows.values()), SCHEMA).repartition(3).cache()


def test_empty_tables(empty):
    for f in (media_features, scored, byte_shards, license_scan, lambda d: pack(d, default_tokenizer()), without_repeats, identified, mixed_copies, parsed, near_duplicates, mix, in_a_language, without_near_duplicates):
        assert f(empty).count() == 0


def test_filters_keep_the_columns_and_clean_documents(docs):
    for f in (in_a_language, without_near_duplicates, mix):
        assert f(docs).columns == docs.columns
    gone = {r.text for r in docs.select("text").subtract(in_a_language(docs).select("text")).collect()}
    assert gone <= {"a" * 900, "ab" * 400}
    assert without_repeats(docs).columns == [*docs.columns, "n_bytes", "n_removed", "n_spans", "kept_sha256"]


# --- 1 -----------------------------------------------------------------------------------------------------------


def test_transport_stream_round_trip(docs):
    for n in (64, 128, 176, 162, 163, 184, 346, 347, 32768, 32769, 100_000):
        data = bytes(random.Random(n).randrange(256) for _ in range(n))
        got = demux(mux(data))
        assert b"".join(u.data for u in got.units) == data and not got.gaps and not got.errors and not got.bad_sections
        assert got.programs == {1: (0x100, 0x101, {0x101: 6})} and all(u.complete and u.random_access for u in got.units)
        assert [u.pts for u in got.units] == [3600 * i for i in range(len(got.units))]
        assert [u.clock for u in got.units] == [3600 * 300 * i for i in range(len(got.units))]
    for r in media_features(docs).collect():
        assert r.payload_bytes % 64 == 0 and r.payload_bytes >= max(64, r.n_bytes) and r.media_bytes % 188 == 0
    for r in media_features(docs.filter("doc_id = 0")).collect():
        text = docs.filter("doc_id = 0").first().text.encode()
        payload = text + bytes(-len(text) % 64)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])


def test_transport_stream_faults():
    data = bytes(range(256)) * 8
    media = mux(data)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    assert demux(b"".join(packets[:4] + packets[3:])).repeats == 1
    lost = demux(b"".join(packets[:5] + packets[6:]))
    assert lost.gaps == 1 and not lost.units[0].complete
    assert demux(b"junk" + media).units[0].data == data and demux(b"junk" + media).sync_losses == 1
    null = bytes([0x47, 0x1F, 0xFF, 0x10]) + b"\xff" * 184
    assert demux(packets[0] + null + b"".join(packets[1:])).units[0].data == data
    bad = bytearray(media)
    bad[15] ^= 1
    assert demux(bytes(bad)).bad_sections == 1
    assert demux(b"").units == [] and demux(b"nothing").units == []


def test_access_units(spark, docs):
    got = access_units(stored(docs)).collect()
    assert {r.stream_type for r in got} == {6} and all(r.random_access and r.complete for r in got)
    assert access_units(spark.createDataFrame([(1, None), (2, b"xx")], "doc_id long, media binary")).count() == 0


# --- 2 -----------------------------------------------------------------------------------------------------------


def _tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["\0end"]


def test_base_scores(docs):
    rows = docs.select("doc_id", "text").collect()
    held = lambda i: zlib.crc32((str(i) if i is not None else "").encode()) % 5 == 1
    train = [t for r in rows if not held(r.doc_id) for t in _tokens(r.text)]
    counts = {t: train.count(t) for t in set(train)}
    norm = log10(len(train) + 0.5 * (len(counts) + 1))
    want = sorted((len(t := _tokens(r.text)), sum(x in counts for x in t), round(sum(log10(counts.get(x, 0) + 0.5) - norm for x in t), 6)) for r in rows)
    got = scored(docs).collect()
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == len(train) and r.score < 0 and np.isfinite(r.score) and r.held_out == held(r.doc_id) for r in got)


def test_classes_beat_the_base_on_held_out_texts(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        own = "aeiou"[i % 5]
        rows.append((i, " ".join(f"{own}{int(rng.paretovariate(0.6)) % 300}{own}" for _ in range(60))))
    got = scored(spark.createDataFrame(rows, "doc_id long, text string")).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > 0.9 * got.b


def _bigrams(rng, n_words, n_tokens):
    """Counts of words 0.. and of the symbols of rest classes and the end, which follow them."""
    import sylva.llm.op2_brown as op

    tokens = np.minimum(rng.geometric(0.08, n_tokens) - 1, n_words + op.REST)
    tokens[1::5] = tokens[::5]  # some words follow themselves
    code, n = np.unique(tokens[:-1] * 1000 + tokens[1:], return_counts=True)
    return code // 1000, code % 1000, n.astype(float)


def _class_matrix(a, b, n, classes):
    import sylva.llm.op2_brown as op

    m = np.zeros((op._TOTAL, op._TOTAL))
    np.add.at(m, (classes[a], classes[b]), n)
    return m


def test_exchange_settles_where_no_move_helps():
    import sylva.llm.op2_brown as op

    rng = np.random.default_rng(3)
    a, b, n = _bigrams(rng, 30, 2000)
    start = np.concatenate([rng.integers(0, 4, 30), op.CLASSES + np.arange(op.REST + 1)])
    history = []
    classes = op.exchange(a, b, n, start, 30, history=history)
    levels = [op.likelihood(_class_matrix(a, b, n, start)), *[x for _, x, _ in history]]
    assert all(y >= x - 1e-6 for x, y in zip(levels, levels[1:])) and history[-1][2] == 0
    assert abs(levels[-1] - op.likelihood(_class_matrix(a, b, n, classes))) < 1e-6
    for w in range(30):
        for k in range(op.CLASSES):
            other = classes.copy()
            other[w] = k
            assert op.likelihood(_class_matrix(a, b, n, other)) <= levels[-1] + 1e-4


def test_moves_are_the_best_single_moves():
    import sylva.llm.op2_brown as op

    rng = np.random.default_rng(4)
    a, b, n = _bigrams(rng, 30, 1500)
    classes = np.concatenate([rng.integers(0, 5, 20), op.CLASSES + rng.integers(0, op.REST, 10), op.CLASSES + np.arange(op.REST + 1)])
    matrix = _class_matrix(a, b, n, classes)
    out, into, own = np.zeros((30, op._TOTAL)), np.zeros((30, op._TOTAL)), np.zeros(30)
    for x, y, k in zip(a, b, n):
        if x == y and x < 30:
            own[x] += k
            continue
        if x < 30:
            out[x, classes[y]] += k
        if y < 30:
            into[y, classes[x]] += k
    found = op.moves(np.arange(30), out, into, own, classes[:30], matrix)
    for w in range(30):
        level = []
        for k in [*range(op.CLASSES), found[w]]:
            other = classes.copy()
            other[w] = k
            level.append(op.likelihood(_class_matrix(a, b, n, other)))
        assert level[-1] >= max(level) - 1e-4


@pytest.mark.parametrize("head", [1 << 18, 60])
def test_scores_equal_a_plain_model(docs, monkeypatch, head):
    """The plain model counts classes and words of all training texts from what fit says of the words' classes."""
    import sylva.llm.op2_brown as op

    monkeypatch.setattr(op, "HEAD", head)
    monkeypatch.setattr(op, "CORE", 25)
    rows = op.split(docs).collect()
    model = op.fit(op.split(docs).filter("not held_out"))
    stages = [x for s, x, _ in model.history if s == "all"]
    assert max(stages) == pytest.approx(op.likelihood(model.matrix)) and [k for s, _, k in model.history if s == "core"][-1] == 0

    def hashed(w):
        return int(op._words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0])

    place, end = {int(h): i for i, h in enumerate(model.head)}, op._TOTAL - 1
    assert len(place) < head + 30  # a step of frequency is cut by hash
    of, counts = {"\0end": end}, {}
    for r in rows:
        for t in _tokens(r.text):
            if t not in of:
                h = hashed(t)
                of[t] = int(model.classes[place[h]]) if h in place else op.CLASSES + h % op.REST
            if not r.held_out:
                counts[t] = counts.get(t, 0) + 1
    matrix, mass = np.zeros((op._TOTAL, op._TOTAL)), np.zeros(op._TOTAL)
    for r in rows:
        if not r.held_out:
            classes = [end, *[of[t] for t in _tokens(r.text)]]
            np.add.at(matrix, (classes[:-1], classes[1:]), 1)
    assert (matrix == model.matrix).all()
    for t, k in counts.items():
        mass[of[t]] += k + 0.5
    mass[op.CLASSES : end] += 0.5  # a place for unseen words
    step = np.log10((matrix + 0.5) / (matrix.sum(1, keepdims=True) + 0.5 * op._TOTAL))

    def score(text):
        total, before = 0.0, end
        for t in _tokens(text):
            total += step[before, of[t]] + (0.0 if of[t] == end else log10(counts.get(t, 0) + 0.5) - log10(mass[of[t]]))
            before = of[t]
        return round(total, 5)

    assert sorted(round(r.score, 5) for r in op.scored(docs).collect()) == sorted(score(r.text) for r in rows)


# --- 3 -----------------------------------------------------------------------------------------------------------


def test_byte_shards(docs):
    got = byte_shards(docs, 3).collect()
    assert len(got) == docs.count()
    total, order = sum(r.size for r in got), sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == list(np.cumsum([0, *[r.size for r in order]])[:-1])
    assert all(r.shard == min(2, r.start * 3 // total) for r in got)
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    want = sorted((len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((r.size, r.text_crc32) for r in got) == want


# --- 4 -----------------------------------------------------------------------------------------------------------


def _licenses(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    marked = "".join(f" {w} " for w in found)
    hits = [(m.start(), m.end(), r.priority, r.label, i) for i, r in enumerate(RULES) for m in re.finditer(r.pattern, marked)]
    before = lambda n: marked[:n].count(" ") // 2
    hits = [(before(s), before(e), p, label, i) for s, e, p, label, i in hits]
    kept = [d for d in hits if not any(o[0] <= d[0] and o[1] >= d[1] and o[2] >= d[2] and (o[2] > d[2] or (o[0], o[1]) != (d[0], d[1]) or o[4] < d[4]) for o in hits)]
    base = [d for d in hits if d[2] == 0]
    return len(found), len(base), ",".join(sorted({d[3] for d in base})), ",".join(sorted({d[3] for d in kept + base}))


def test_license_scan(spark, docs):
    texts = ["MIT License; mit license", "gnu general public license gnu  general-public license version 3 or any later version", "SPDX-License-Identifier: Apache-2.0", "Licensed under the BSD 3-Clause license. All rights reserved", "cc by sa 4.0 cc by", "commit license", "released under a Creative Commons Attribution-NonCommercial 4.0", "Ünder mit\x00license"]
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    want = sorted(_licenses(r.text) for r in rows.collect())
    got = license_scan(rows).collect()
    assert sorted((r.n_words, r.n_base, r.base_labels, r.labels) for r in got) == want
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) and (r.first_word is None) == (r.n_base == 0) for r in got)
    by = {r.doc_id: r for r in got}
    assert (by[1000].first_word, by[1000].last_word) == (0, 2)
    assert len(RULES) > 300


def _example(pattern):
    """A text that pattern matches: of options the first, of what may be left out nothing."""
    from re import _parser

    def made(parts):
        out = ""
        for kind, x in parts:
            kind = str(kind)
            if kind == "LITERAL":
                out += chr(x)
            elif kind == "IN":
                out += chr(x[0][1])
            elif kind == "NOT_LITERAL":
                out += "x"
            elif kind == "BRANCH":
                out += made(x[1][0])
            elif kind == "SUBPATTERN":
                out += made(x[3])
            else:
                assert kind == "MAX_REPEAT", kind
                out += made(x[2]) * x[0]
        return out

    return made(_parser.parse(pattern))


def test_each_license_rule_runs_on_its_own_text(spark):
    texts = [_example(r.pattern) for r in RULES]
    assert all(re.search(r.pattern, t) for r, t in zip(RULES, texts))
    texts = [" ".join(t.split()) for t in texts] + ["SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: MS-PL"]
    got = {r.doc_id: (r.n_words, r.n_base, r.base_labels, r.labels) for r in license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [_licenses(t) for t in texts]
    assert got[len(texts) - 2][3] == "epl-2.0" and got[len(texts) - 1][3] == "ms-pl"


# --- 5 -----------------------------------------------------------------------------------------------------------


def test_cuts():
    for n in [*range(1, 700), 2047, 2048, 2049, 5000, 70_001]:
        pieces = cuts(n, 2048, 16, 64)
        assert sum(p for p, _ in pieces) == n and all(p * k <= 2048 for p, k in pieces)


@pytest.mark.parametrize(("worker_rows", "fan"), [(100_000, 1024), (5, 2)])
def test_packing(docs, monkeypatch, worker_rows, fan):
    from tokenizers import Tokenizer

    import sylva.llm.op5_harmonic as op

    monkeypatch.setattr(op, "FAN", fan)
    own = Tokenizer.from_file(default_tokenizer())
    got = pack(docs, default_tokenizer(), worker_rows=worker_rows).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        pieces.sort()
        assert [o for o, _ in pieces] == list(np.cumsum([0, *[n for _, n in pieces]])[:-1]) and sum(n for _, n in pieces) <= 2048
    want = []
    for r in docs.collect():
        ids = np.array([*own.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
    firsts = sorted(((r.doc_id, r.doc_tokens) for r in got if r.start == 0), key=str)
    assert firsts == sorted(((d, n) for d, n, _ in want), key=str)
    assert sum(r.length for r in got) == sum(n for _, n, _ in want)
    # Pieces follow each other without gaps and have the checksums of their own ids, also where a document is cut.
    pieces = []
    for r in docs.collect():
        ids = np.array([*own.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        at = 0
        for n, _ in cuts(len(ids) // 4, 2048, 16, 64):
            pieces.append((r.doc_id, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), len(ids) // 4))
            at += n
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got), key=str) == sorted(pieces, key=str)


def test_sequences_are_nearly_full(spark):
    rng = random.Random(9)
    rows = spark.createDataFrame([(i, words(rng, int(rng.paretovariate(0.7) * 20) % 1500)) for i in range(600)], "doc_id long, text string").repartition(4)
    got = pack(rows, default_tokenizer(), worker_rows=2000).groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.sum("n").alias("ids"), F.count("*").alias("k")).first()
    assert got.ids / (2048 * got.k) > 0.97


def test_encoder_equals_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from sylva.llm.op5_harmonic import Encoder

    texts = ["", "a", " a", "a ", "a  b", "a\nb", "\na b", "a \n b", "x<|endoftext|>y z", "it's don't  x", "é ñ 漢字 ab 12 3a !!  x", "end\n", "\t\tq w", "a\x1c b \x85c", "  ", "　 a b c", " <|endoftext|>a", None]
    own, want = Encoder(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    assert [x.tolist() for x in own.encode_all(pa.array(texts))] == [want.encode(t or "", add_special_tokens=False).ids for t in texts]


# --- 6 -----------------------------------------------------------------------------------------------------------


def _repeats(rows, m=100):
    seen, out = set(), {}
    for d, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - m + 1):
            if raw[i : i + m] in seen:
                gone[i : i + m] = b"\1" * m
            seen.add(raw[i : i + m])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[d] = (len(raw), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(plain):
    want = _repeats([(r.doc_id, r.text) for r in plain.collect()])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in without_repeats(plain).collect()}
    assert got == want


def test_repeats_beyond_the_families(plain, monkeypatch):
    import sylva.llm.op6_suffix as op

    monkeypatch.setattr(op, "HOT", 1)
    want = _repeats([(r.doc_id, r.text) for r in plain.collect()])
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in without_repeats(plain).collect()} == want


def test_repeats_with_shared_ids(docs):
    got = without_repeats(docs)
    assert got.count() == docs.count()
    twice = [r.n_removed for r in got.filter("doc_id = 9").collect()]
    assert len(twice) == 2 and len(set(twice)) == 1


def test_repeated_rows_keep_one_copy(spark, docs):
    rng = random.Random(6)
    once, passage = words(rng, 60), words(rng, 40)
    rows = [(1, once), (1, once), (2, passage + " " + words(rng, 20)), (2, "other " + passage), (3, passage), (3, passage), (3, passage), (None, words(rng, 50)), (4, "short"), (4, "short")]
    rows += [rows[7]]
    for table in (spark.createDataFrame(rows, "doc_id long, text string").repartition(3), docs.select("doc_id", "text")):
        fold = F.xxhash64(F.coalesce("text", F.lit("")))
        rows = table.withColumn("fold", fold).collect()
        key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.fold)
        want = _repeats({key(r): (key(r), r.text) for r in rows}.values())
        got = without_repeats(table.withColumn("fold", fold)).collect()
        assert sorted((key(r), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((key(r), *want[key(r)]) for r in rows)


def test_suffix_family():
    rng, family, seen = random.Random(2), SuffixFamily(5), set()
    for _ in range(40):
        text = bytes(rng.choice(b"ab\0") for _ in range(60))
        want = []
        for i in range(56):
            want.append(text[i : i + 5] in seen)
            seen.add(text[i : i + 5])
        assert family.add(np.frombuffer(text, np.uint8), np.arange(56)).tolist() == want
    sizes = [len(level) for _, level in family.levels]
    assert sum(sizes) == len(seen) and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))


# --- 7 -----------------------------------------------------------------------------------------------------------


def test_language(spark):
    rng = random.Random(3)
    of = {"en": ["the", "and", "with", "house", "there"], "de": ["und", "nicht", "straße", "schön", "über"], "fr": ["être", "avec", "pour", "français", "où"]}
    rows = [(i, " ".join(rng.choices(of[k], k=30)), k, f"h{i % 7}") for i, k in enumerate(list(of) * 40)]
    rows += [(900, " ".join(rng.choices(of["de"], k=30)), "en", "h1"), (901, "", "fr", "h0"), (902, None, None, None), (903, "".join(chr(rng.randrange(0x2500, 0x2600)) for _ in range(400)), "en", "h2"), (904, "ok", "de", "h3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in identified(docs).collect()}
    assert all(got[i].language == k and got[i].kept for i, _, k, _ in rows[:120])
    assert got[900].language == "de" and got[901].language == "fr" and got[902].kept and got[904].language == "de"
    assert 0 < got[902].posterior <= 1 and len(got) == len(rows)
    left = {r.doc_id for r in in_a_language(docs).collect()}
    assert left == {i for i, r in got.items() if r.kept}


def test_every_declared_language_has_a_model(spark):
    rng, rows = random.Random(8), []
    for k in range(90):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüßéèçñøå") for _ in range(6)) for _ in range(8)]
        label = f"l{k:02}"
        forms = [label, label.upper(), f" {label}-XX", label + "_yy"]
        rows += [(len(rows) + i, " ".join(rng.choices(own, k=60 if k < 80 else 20)), forms[i % 4], "h") for i in range(6 if k < 80 else 2)]
    got = identified(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    want = {i: lang.strip().lower()[:3] for i, _, lang, _ in rows}
    assert len({want[r.doc_id] for r in got}) == 90 and all(r.kept and r.language == want[r.doc_id] for r in got)


def test_junk_is_rejected(spark):
    from sylva.llm.op7_langid import fit_trigrams

    rng = random.Random(4)
    text = " ".join(rng.choices(["the", "and", "with", "house", "there"], k=400))
    model = fit_trigrams(spark.createDataFrame([(text, "en")], "text string, label string"))
    junk = "".join(chr(rng.randrange(33, 48)) for _ in range(500))
    got = {r.doc_id: r for r in identified(spark.createDataFrame([(1, junk, "en", "a"), (2, text[:200], "en", "a")], "doc_id long, text string, lang string, source string"), model=model).collect()}
    assert not got[1].kept and got[1].language == "und" and got[2].kept


def test_page_evidence(spark):
    rows = [(1, "https://A.example.DE:80/x", '<html class=x lang="fr-FR"><script>no</script><p>Bon &amp; <b>jour</b></p><!-- no -->'), (2, None, None), (3, "nothing", "<p>x")]
    got = {r.doc_id: r for r in page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1].declared, got[1].host, got[1].suffix, got[1].text.split()) == ("fr", "a.example.de", "de", ["Bon", "jour"])
    assert (got[2].declared, got[2].host, got[2].suffix) == (None, None, None) and got[3].host is None


# --- 8 -----------------------------------------------------------------------------------------------------------


def test_targets(spark):
    sizes = spark.createDataFrame([("b", 10, 1), ("a", 100, 1), (None, 1000, 1), ("z", 0, 1)], "source string, source_size long, source_rows long")
    got = {r.source: r.target for r in source_targets(sizes).collect()}
    # a, b, z, null weigh 3, 1, 2, 3 and share 1665: a, b and z stop at twice their sizes, null takes the rest.
    assert got == {"a": 200.0, "b": 20.0, "z": 0.0, None: 1445.0}


def test_pivot_keeps_mass():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50):
        size, p = rng.integers(0, 90, n), rng.random(n)
        out = pivot(p, size, np.random.default_rng(2))
        assert ((out > 0) & (out < 1)).sum() <= 1 and abs((out * size).sum() - (p * size).sum()) < 1e-6
    mean = np.mean([pivot(np.full(4, 0.3), np.array([1, 2, 3, 4]), np.random.default_rng(i)) for i in range(3000)], axis=0)
    assert np.abs(mean[:3].mean() - 0.3) < 0.05


def test_mixing(spark, docs, monkeypatch):
    import sylva.llm.op8_pivotal as op

    monkeypatch.setattr(op, "GROUP", 16)
    monkeypatch.setattr(op, "FAN", 2)
    many = spark.range(600).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 1 + id % 37), x -> 'w'), ' ')").alias("text"), F.when(F.col("id") % 9 > 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 2).cast("string"))).alias("source"))
    got = mixed_copies(many).withColumn("taken", F.col("size") * F.col("copies"))
    assert got.count() == 600 and got.filter("copies > 2").count() == 0
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.max("size").alias("most")).collect():
        assert abs(r.t - r.target) <= r.most
    key = ["doc_id", "copies"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, mixed_copies(many).select(key).collect()))
    assert mixed_copies(docs).count() == docs.count()
    n = mixed_copies(docs).agg(F.sum("copies")).first()[0]
    assert mix(docs).count() == n


# --- 9 -----------------------------------------------------------------------------------------------------------


def test_parsing(plain):
    rows = sorted(((r.doc_id, r.text or "") for r in plain.collect()), reverse=True)
    got = {r.doc_id: r for r in parsed(plain).collect()}
    for i, (d, text) in enumerate(rows):
        new = edited(text, rows[(i + 1) % len(rows)][1])
        assert got[d].n_chars == len(text) and got[d].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    prints = {}
    for d, text in rows:
        assert prints.setdefault(text, got[d].fingerprint) == got[d].fingerprint


def test_parsing_with_shared_ids_and_alone(spark, docs):
    assert parsed(docs).count() == docs.count()
    one = parsed(spark.createDataFrame([(7, "abcdef" * 50)], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_phrases_ignore_offsets():
    rng = random.Random(8)
    text = words(rng, 500)
    a, b, c = fingerprints([text.encode(), ("some words before it " + text).encode(), words(rng, 500).encode()])
    assert likeness(a, b) > 0.8 and likeness(a, c) < 0.2 and likeness(a, a) == 1.0
    e = fingerprints([b"", b"aaaa", b"aaaa"])
    assert likeness(e[0], e[0]) == 1.0 and likeness(e[0], e[1]) == 0.0 and likeness(e[1], e[2]) == 1.0


# --- 10 ----------------------------------------------------------------------------------------------------------


def _components(rows, k, percent):
    sets = {}
    for d, text in rows:
        w = _tokens(text)[:-1]
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_rows():
    rng = random.Random(11)
    rows = []
    for g in range(6):
        base = words(rng, 120).split()
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randrange(0, 9)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, plain, k, percent):
    for df in (plain, spark.createDataFrame(near_rows(), "doc_id long, text string").repartition(4)):
        want = _components([(r.doc_id, r.text) for r in df.collect()], k, percent)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, k, percent).collect()}
        assert got == want


def test_near_duplicates_in_blocks(spark, monkeypatch):
    import sylva.llm.op10_oddsketch as op

    monkeypatch.setattr(op, "BLOCK", 4)
    monkeypatch.setattr(op, "PARTS", 2)
    monkeypatch.setattr(op, "STAR", 3)
    rows = near_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == _components(rows, 3, 85)


def test_one_of_each_group_stays(docs):
    left = without_near_duplicates(docs, words=3, percent=85)
    assert left.columns == docs.columns
    assert left.filter("doc_id = 0").count() == 1 and left.filter("doc_id = 1").count() == 0
    assert left.filter("text is null or trim(text) = ''").count() >= 2


def test_odd_sketches():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 60, (1, 72), dtype=np.uint64)
    b = a.copy()
    b[0, :10] += np.uint64(1)
    bits = int(np.bitwise_count(odd_sketches(a) ^ odd_sketches(b)).sum())
    assert 10 <= bits <= 20 and bits % 2 == 0 and most_odd_bits(72, 85) >= 44


def test_leaders_are_copied_in_wide_cells_alone(spark, monkeypatch):
    import sylva.llm.op10_oddsketch as op

    monkeypatch.setattr(op, "FULL", 100)
    monkeypatch.setattr(op, "PARTS", 4)
    kept = {1: 100, 2: 250, 3: 1000}
    rows = spark.createDataFrame([(k, 0, 1, 0, 0, i % 2 == 0, i % 3 > 0, True, f"{k} {i}".encode(), b"", 9, [0], [0], n) for k, n in kept.items() for i in range(n)], f"{op._CELL_TYPES}, kept int")
    got = [r.asDict() for r in op._split(rows).collect()]
    parts = {1: 1, 2: 3, 3: 4}
    assert {k: sum(r["key"] == k for r in got) for k in kept} == {k: n // 2 * (1 + parts[k]) for k, n in kept.items()}
    # Each member stands in one part, each leading row in all.
    members = [(r["key"], r["node"]) for r in got if r["member"]]
    assert len(members) == len(set(members)) == rows.filter("member").count()
    assert {(k, len({r["b"] for r in got if r["key"] == k and r["leads"] and r["node"] == f"{k} 0".encode()})) for k in kept} == set(parts.items())


def test_cells_hold_the_sets_of_few_texts():
    """Memory goes by the widest cell and one run of texts, not by the batch, and its pairs are found."""
    import tracemalloc

    import pyarrow as pa

    from sylva.llm import op10_oddsketch as op

    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in op._CELL_TYPES.split(", "))] + [("text", pa.string())])
    draw, rows = random.Random(5), []
    for key in range(3000):
        text = " ".join(f"w{draw.randrange(10**6)}" for _ in range(400))
        for i, t in enumerate((text, f"{text} end" if key % 3 else text[::-1])):
            node = f"{key} {i}".encode()
            rows.append((key, 0, 0, 0, 0, True, True, True, node, node, 396 + i * (key % 3 > 0), [0] * 8, [key] + [2 * key + i] * 23, t))
    batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
    assert batch.nbytes > 16 << 20
    tracemalloc.start()
    links = [x for b in op._links(iter([batch]), 5, 512, 80) for x in b.column(0).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(int(x.split()[0]) for x in links) == [key for key in range(3000) if key % 3]
    assert peak < 30 << 20, peak


def test_cells_are_dealt_by_their_shingles(spark, monkeypatch):
    """Adaptive execution, which goes by compressed bytes, doesn't merge tasks of texts."""
    from sylva.llm import op10_oddsketch as op

    monkeypatch.setattr(op, "SHARE", 500)
    cells = spark.createDataFrame([(k, 0, 0, 0, 0, i == 0, i > 0, True, f"{k} {i}".encode(), f"{k} {i}".encode(), 100, [0] * 8, [0] * 24, 2) for k in range(20) for i in range(2)], f"{op._CELL_TYPES}, kept int")
    texts = cells.select("node", F.lit("a b c d e f").alias("text"))
    got = op._linked(cells, texts, 5, 72, 80)
    assert got.count() == 20
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(key#\d+L?, o#\d+, b#\d+, 8\), REPARTITION_BY_NUM", plan), plan


def _least(edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in parent}


def _graphs():
    rng = random.Random(12)
    yield "stars", [(100 * s + i, 100 * s) for s in range(20) for i in range(1, 30)], 3
    yield "chain", [(i, i + 1) for i in range(40)], 15
    yield "hub above its leaves", [(500, i) for i in range(30)] + [(500, 7), (3, 3)], 12
    yield "sets of many parents", [e for n in range(3, 40) for e in ((n, n - 1), (n, n - 2))], 40
    yield "random", [(rng.randrange(300), rng.randrange(300)) for _ in range(220)], 48


@pytest.mark.parametrize(("edges", "most"), [pytest.param(e, m, id=n) for n, e, m in _graphs()])
def test_components_take_few_shuffles(spark, monkeypatch, edges, most):
    """Each shuffle costs a task for every shuffle partition, however few the edges are."""
    from sylva.llm import graph

    shuffles, plain = [], graph.written

    def counted(df, name):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return plain(df, name)

    monkeypatch.setattr(graph, "written", counted)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = _least([e for e in edges if e[0] != e[1]])
    assert all(got.get(x, x) == c for x, c in want.items()) and set(got) <= set(want)
    assert sum(shuffles) <= most, shuffles


def test_one_set_is_held_against_many_at_once():
    from sylva.llm.op10_oddsketch import _portions, similar, similar_to

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 80), dtype=np.uint64)) for _ in range(60)]
    for x in sets:
        for percent in (20, 50, 85):
            assert similar_to(x, sets, percent).tolist() == [similar(x, y, percent) for y in sets]
    assert similar_to(sets[0], [], 85).tolist() == []
    size = np.array([len(x) * 1000 for x in sets])
    y = np.arange(60)[::-1]
    parts = _portions(y, size)
    assert np.concatenate(parts).tolist() == y.tolist() and len(parts) > 5 and [len(p) for p in _portions(y[:0], size)] == [0]


def test_links_are_told_by_portions(monkeypatch):
    """Members that sketches let through, but that are not similar, cost one pass a leading row, not one each."""
    import pyarrow as pa

    from sylva.llm import op10_oddsketch as op

    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in op._CELL_TYPES.split(", "))] + [("text", pa.string())])
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[: 10 + i] + [f"x{i} {j}" for j in range(50 - i)]) for i in range(40)] + [" ".join([*base, "end"])] * 2
    rows = [(1, 0, 0, 0, 0, True, True, True, b"%02d" % i, b"%02d" % i, 50, [0] * 8, [1] + [2 * i] * 23, t) for i, t in enumerate(texts)]
    batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
    calls = []
    for name in ("similar", "similar_to"):
        monkeypatch.setattr(op, name, lambda *a, f=getattr(op, name, None): calls.append(1) or f(*a))
    links = [x for b in op._links(iter([batch]), 5, 512, 80) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert links == [(b"40", b"41")] and len(calls) <= len(rows), (links, len(calls))
