"""Fusion of language evidence and locally consistent fingerprints against plain versions; stages on empty and clashing tables."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from sylva.llm import op7_langid as lang
from sylva.llm import op9_parsing as op9
from sylva.llm.common import mixed

MASK = (1 << 64) - 1


# --- language ----------------------------------------------------------------------------------------------------


def plain_fusion(rows, languages):
    """Posteriors from first guesses, declared labels and host priors smoothed by suffix, and suffix by all."""
    k = len(languages) + 1
    guess = [max(range(k), key=lambda i: (r["evidence"][i], -i)) for r in rows]
    total = Counter(guess)
    overall = [(total[i] + 1) / (len(rows) + k) for i in range(k)]
    told = Counter((r["declared"], g) for r, g in zip(rows, guess) if r["declared"] is not None)
    per = Counter(g for r, g in zip(rows, guess) if r["declared"] is not None)
    kinds = len({d for d, _ in told}) or 1
    suffix_n, suffix_all = Counter((r["suffix"], g) for r, g in zip(rows, guess)), Counter(r["suffix"] for r in rows)
    host_n, host_all = Counter((r["suffix"], r["host"], g) for r, g in zip(rows, guess)), Counter((r["suffix"], r["host"]) for r in rows)
    out = []
    for r, g in zip(rows, guess):
        score = []
        for i in range(k):
            x = r["evidence"][i]
            if r["declared"] is not None:
                x += math.log((told[r["declared"], i] + 1) / (per[i] + kinds + 1))
            wide = (suffix_n[r["suffix"], i] + lang.SUFFIX_WEIGHT * overall[i]) / (suffix_all[r["suffix"]] + lang.SUFFIX_WEIGHT)
            own = host_n[r["suffix"], r["host"], i] - (g == i)
            score.append(x + math.log((own + lang.HOST_WEIGHT * wide) / (host_all[r["suffix"], r["host"]] - 1 + lang.HOST_WEIGHT)))
        at = max(range(k), key=lambda i: (score[i], -i))
        out.append((r["id"], [*languages, lang.NONE][at], round(1 / sum(math.exp(x - max(score)) for x in score), 9)))
    return sorted(out)


def test_fusion_equals_a_plain_version(spark):
    rng = random.Random(5)
    languages = ["de", "en", "fr"]
    rows = [{"id": i, "declared": rng.choice([None, "de", "en", "xx"]), "suffix": rng.choice([None, "org", "de"]), "host": rng.choice([None, "a", "b", "c"]), "evidence": [rng.uniform(-9, 0) for _ in range(4)]} for i in range(300)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, declared string, suffix string, host string, evidence array<double>").repartition(3)
    got = sorted((r.id, r.language, round(r.posterior, 9)) for r in lang.fused(df, languages).collect())
    assert [g[:2] for g in got] == [w[:2] for w in plain_fusion(rows, languages)]
    assert all(abs(g[2] - w[2]) < 1e-8 for g, w in zip(got, plain_fusion(rows, languages)))


def test_text_evidence_equals_a_plain_version(spark):
    import numpy as np

    texts = ["the house and the garden", "Das Haus und der Garten", "", "ab", None, "Ünïcode 漢字"]
    languages, table = lang.fit_trigrams(spark.createDataFrame([(t, "EN-us" if i % 2 == 0 else "de") for i, t in enumerate(texts)], "text string, label string"))
    assert languages == ["de", "en"]

    def buckets(text):
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
        return [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 18 for i in range(len(raw) - 2)]

    counts = {k: Counter(b for i, t in enumerate(texts) if (i % 2 == 0) == (k == "en") for b in buckets(t)) for k in languages}
    logs = {k: {b: math.log((counts[k][b] + 0.5) / (sum(counts[k].values()) + 0.5 * lang.BUCKETS)) for t in texts for b in buckets(t)} for k in languages}
    got = {r.id: r.evidence for r in lang.text_evidence(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), languages, table).collect()}
    for i, t in enumerate(texts):
        want = [lang.TEMPER * sum(logs[k][b] for b in buckets(t)) for k in languages] + [-lang.TEMPER * math.log(lang.BUCKETS) * len(buckets(t))]
        assert np.allclose(got[i], want, atol=1e-3)


# --- fingerprints ------------------------------------------------------------------------------------------------


def h(x):
    import numpy as np

    return int(mixed(np.array([x & MASK], np.uint64))[0])


def plain_level(symbols, level):
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    symbols = [s if n == 1 else h(s + n * 0x9E3779B97F4A7C15) for s, n in runs]
    labels, width = symbols, 64
    for _ in range(4):
        out = []
        for i, x in enumerate(labels):
            left = labels[i - 1] if i else ~x & ((1 << width) - 1)
            bit = ((x ^ left) & -(x ^ left)).bit_length() - 1
            out.append(bit << 1 | x >> bit & 1)
        labels, width = out, 8
    for gone in (5, 4, 3):
        was = list(labels)
        for i, x in enumerate(was):
            if x == gone:
                beside = {was[j] for j in (i - 1, i + 1) if 0 <= j < len(was)}
                labels[i] = min({0, 1, 2} - beside)
    names = []
    begins = [i for i in range(len(labels)) if i == 0 or (i + 1 < len(labels) and labels[i] > max(labels[i - 1], labels[i + 1]))]
    for start, end in zip(begins, [*begins[1:], len(symbols)]):
        names.append(h(sum(h(s + (j + 1) * 0xD1342543DE82EF95) for j, s in enumerate(symbols[start:end])) + level))
    return names


def plain_fingerprint(raw):
    symbols, least = list(raw), {}
    if symbols:
        for level in range(1, op9.LEVELS + 1):
            symbols = plain_level(symbols, level)
            if level >= op9.FIRST:
                for s in symbols:
                    name = h(s)
                    slot = name & (op9.SLOTS - 1)
                    least[slot] = min(least.get(slot, MASK), name >> 8)
    return [h(least[i]) % 65535 + 1 if i in least else 0 for i in range(op9.SLOTS)]


def test_fingerprints_equal_a_plain_version(spark):
    rng = random.Random(2)
    texts = ["", "a", "ab", "aaaa", "abab" * 9, *["".join(rng.choice("abc é漢 ") for _ in range(rng.randrange(1, 400))) for _ in range(25)]]
    want = [plain_fingerprint(t.encode()) for t in texts]
    assert [x.tolist() for x in op9.fingerprints([t.encode() for t in texts])] == want
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in op9.parsed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}

    def like(a, b):
        either = [(x, y) for x, y in zip(a, b) if x or y]
        return sum(x == y for x, y in either) / len(either) if either else 1.0

    for i, t in rows:
        after = texts[i - 1]
        half = len(t) // 2
        edit = plain_fingerprint((t[: len(t) - half] + after[:half]).encode())
        assert got[i].fingerprint == "".join(f"{x:04x}" for x in want[i]) and got[i].edited_fingerprint == "".join(f"{x:04x}" for x in edit)
        assert got[i].near_edited == pytest.approx(like(want[i], edit)) and got[i].near_next == pytest.approx(like(want[i], want[i - 1]))


# --- stages ------------------------------------------------------------------------------------------------------

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", [n for n, _ in p.STAGES])
def test_a_stage_on_empty_and_clashing_tables(spark, name):
    stage = dict(p.STAGES)[name]
    assert stage(spark, spark.createDataFrame([], KINDS), "").count() == 0
    if name == "packing":
        return
    clash = ["_doc", "size", "fold", "node", "component", "_copies", "n_removed", "evidence", "label", "kept", "row", "start"]
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["the", "house", "of", "green", "stones"]) + str(rng.randrange(90)) for _ in range(150)), "en", "s", 5, *["x"] * len(clash)) for i in range(6)]
    df = spark.createDataFrame([*rows, (None, None, None, None, None, *["x"] * len(clash))], KINDS + ", " + ", ".join(f"`{c}` string" for c in clash))
    taken = [c for c in df.columns if not (name == "repeats" and c == "n_removed")]
    out = stage(spark, df.select(*taken), "")
    assert out.columns == taken and out.filter(F.col("size") == "x").count() == out.count() > 0
