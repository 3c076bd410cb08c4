"""Document fingerprints from locally consistent parsing by deterministic coin tossing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, mixed, partitions, written

#: Levels of phrases; names of levels from FIRST on sign a text. Slots of a fingerprint, of 16 bits each.
LEVELS, FIRST, SLOTS = 6, 3, 64
#: Bytes of texts that are parsed together.
RUN = 1 << 20
_U = np.uint64


def _low_bit(x: np.ndarray) -> np.ndarray:
    """Place of the lowest set bit."""
    return np.bitwise_count((x & -x) - np.ones(1, x.dtype)).astype(np.uint8)


def _tossed(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0, 1, 2 of symbols none of which equals its left neighbour; like neighbours differ again.

    Each toss names a symbol by the lowest bit in which it differs from the one to its left, and that bit; four bring 64 bits down to six
    labels. Then labels 5, 4 and 3 in turn take the least label that neither neighbour has. first marks rows' first symbols.
    """
    labels = symbols
    for _ in range(4):
        left = np.empty_like(labels)
        left[1:] = labels[:-1]
        left[first] = ~labels[first]  # differs in the lowest bit
        low = _low_bit(labels ^ left)
        labels = (low << np.uint8(1)) | ((labels >> low.astype(labels.dtype)) & labels.dtype.type(1)).astype(np.uint8)
    last = np.append(first[1:], len(labels)) - 1
    for gone in (5, 4, 3):
        at = np.flatnonzero(labels == gone)
        if not len(at):
            continue
        left, right = labels[np.maximum(at - 1, 0)].copy(), labels[np.minimum(at + 1, len(labels) - 1)].copy()
        left[np.isin(at, first)] = 255
        right[np.isin(at, last)] = 255
        taken = (np.uint8(1) << np.where(left < 3, left, 3)) | (np.uint8(1) << np.where(right < 3, right, 3))
        labels[at] = np.array([0, 1, 0, 2, 0, 1, 0, 3], np.uint8)[taken & 7]
    return labels


def _level(symbols: np.ndarray, row: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Parses rows of symbols into phrases: their names, and the row of each.

    A run of one symbol becomes one symbol, named by it and its length, so that neighbours differ. A phrase begins where a
    label is above both neighbours', and where a row begins. A name is a hash of the phrase's symbols in order.
    """
    fresh = np.ones(len(symbols), bool)
    fresh[1:] = (symbols[1:] != symbols[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(fresh)
    length = np.diff(np.append(at, len(symbols)))
    symbols, row = symbols[at], row[at]
    several = length > 1
    symbols = np.where(several, mixed(symbols + length.astype(_U) * _U(0x9E3779B97F4A7C15)), symbols)
    new_row = np.ones(len(row), bool)
    new_row[1:] = row[1:] != row[:-1]
    first = np.flatnonzero(new_row)
    # The names of two unlike neighbours may be equal only by a collision of hashes; then both stand as one phrase would.
    labels = _tossed(symbols, first).astype(np.int8)
    left, right = np.empty_like(labels), np.empty_like(labels)
    left[1:], right[:-1] = labels[:-1], labels[1:]
    left[first], right[np.append(first[1:], len(row)) - 1] = 3, 3
    begin = np.flatnonzero(((labels > left) & (labels > right)) | new_row)
    place = np.arange(len(symbols)) - np.repeat(begin, np.diff(np.append(begin, len(symbols))))
    named = np.add.reduceat(mixed(symbols + (place.astype(_U) + _U(1)) * _U(0xD1342543DE82EF95)), begin)
    return mixed(named + _U(level)), row[begin]


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """SLOTS numbers for each text: in each slot the least of the phrase names dealt to it, folded to 1..65535, or 0 if none is.

    Interior phrases depend on their near surroundings alone, so equal substrings share them at any offset.
    """
    out = np.zeros((len(texts), SLOTS), np.uint16)
    symbols = np.frombuffer(b"".join(texts), np.uint8).astype(_U)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    if not len(symbols):
        return out
    least = np.full(len(texts) * SLOTS, ~_U(0))
    for level in range(1, LEVELS + 1):
        symbols, row = _level(symbols, row, level)
        if level >= FIRST:
            name = mixed(symbols)
            np.minimum.at(least, row * SLOTS + (name & _U(SLOTS - 1)).astype(np.int64), name >> _U(8))
    full = least != ~_U(0)
    out.ravel()[full] = (mixed(least[full]) % _U(65535) + _U(1)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of like slots among those that either has; 1 if both are empty."""
    either = (a > 0) | (b > 0)
    n = int(either.sum())
    return float(((a == b) & either).sum() / n) if n else 1.0


def as_text(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u2").tobytes().hex()


def edited(text: str, other: str) -> str:
    """text with its last half replaced by as much of the start of other, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: list, texts: list[str], following: list[str]) -> list[tuple]:
    """The result's rows for texts, each with the text that follows it; parsed in runs of about RUN bytes."""
    out, a = [], 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size < RUN):
            size += len(texts[b])
            b += 1
        mine, new = texts[a:b], [edited(t, o) for t, o in zip(texts[a:b], following[a:b])]
        raw, new_raw = [t.encode() for t in mine], [t.encode() for t in new]
        # A following text is mostly the next one of the run.
        chained = all(following[i] is texts[i + 1] for i in range(a, b - 1))
        tail = [following[b - 1].encode()] if chained else [t.encode() for t in following[a:b]]
        marks = fingerprints(raw + new_raw + tail)
        own, edit, last = marks[: b - a], marks[b - a : 2 * (b - a)], marks[2 * (b - a) :]
        after = np.concatenate([own[1:], last]) if chained else last
        for i in range(b - a):
            out.append((ids[a + i], len(mine[i]), hashlib.sha256(new_raw[i]).hexdigest(), as_text(own[i]), as_text(edit[i]), likeness(own[i], edit[i]), likeness(own[i], after[i])))
        a = b
    return out


def parsed(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, whose last half is the start of the next document's.

    The next document is that of the next smaller doc_id; after the smallest the largest. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts are dealt once, by ranges of doc_id, and each task reads its range in order with one text held
    back; what lies across two ranges (one text each) is compared in a second, small step. Null text is empty;
    null doc_ids come last; rows that share a doc_id stand in the order of their texts' hashes, and only equal rows
    are never dealt to several tasks; a document alone
    is its own next; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None

        def out(found: list[tuple], role: int, texts: list[str | None]) -> pa.RecordBatch:
            arrays = [pa.array([r[i] for r in found], t) for i, t in enumerate(_TYPES)]
            n = len(found)
            return pa.RecordBatch.from_arrays([*arrays, pa.array([part] * n, pa.int32()), pa.array([role] * n, pa.int32()), pa.array(texts, pa.string())], names=[*_NAMES, "part", "role", "text"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not ids:
                continue
            if held is None:
                yield out([(ids[0], None, None, None, None, None, None)], 1, [texts[0]])
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            found = _compared(ids[:-1], texts[:-1], texts[1:])
            yield out(found, 0, [None] * len(found))
            held = ids[-1], texts[-1]
        if held is not None:
            yield out([(held[0], None, None, None, None, None, None)], 2, [held[1]])

    done = written(dealt.mapInArrow(run, f"{_SCHEMA}, part int, role int, text string"), "parsed")
    # One first and one last text for each range: as many as there are shuffle partitions.
    by_part = Window.orderBy("part")
    parts = done.filter("role = 1").select("part")
    nexts = parts.select("part", F.coalesce(F.lead("part").over(by_part), F.min("part").over(Window.partitionBy(F.lit(0)))).alias("next"))
    firsts = done.filter("role = 1").select(F.col("part").alias("next"), F.col("text").alias("following"))
    open_ = done.filter("role = 2").select("part", "doc_id", "text").join(nexts, "part").join(firsts, "next").select("doc_id", "text", "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _compared(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(_TYPES)], names=_NAMES)

    return done.filter("role = 0").select(*_NAMES).unionByName(open_.mapInArrow(close, _SCHEMA))


def op9_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(documents(spark, sf_dir))
