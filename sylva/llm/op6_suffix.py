"""Exact substring deduplication by a logarithmic family of sparse suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_runs, documents, in_order, mixed, partitions, prefix_hash, span_hash, written

#: Windows of a batch, groups of windows that one task's family takes, and groups of one anchor beyond which windows meet by hash.
BATCH, TASK, HOT = 100_000, 25_000, 50_000
#: Bytes of a match, and of the grams whose least hash in a match is its anchor.
MATCH, GRAM = 100, 40
_U = np.uint64
_LOW = _U(0xFFFFFFFF)


def anchors(data: np.ndarray, bounds: np.ndarray, match: int = MATCH, gram: int = GRAM):
    """Groups the windows of `match` bytes by anchor: the leftmost of the grams with the least hash in a window.

    Equal windows have equal anchors wherever they stand. Returns, for each group, the hash of the anchor's
    gram, the hash of all the group's windows together, its first window's start in data and its number of windows, which
    are consecutive, and the row.
    """
    n, none = len(data), np.zeros(0, np.int64)
    if n < match:
        return none.view(_U), none.view(_U), none, none, none
    prefix = prefix_hash(data)
    at = np.arange(n - gram + 1)
    value = (span_hash(prefix, at, at + gram) & ~_LOW) | at.astype(_U)
    width, have, least = match - gram + 1, 1, value
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    anchor = (least & _LOW).astype(np.int64)  # of the window that starts there
    row = np.searchsorted(bounds, np.arange(len(anchor)), "right") - 1
    inside = np.arange(len(anchor)) + match <= bounds[row + 1]
    first = np.ones(len(anchor), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(first & inside)
    if not len(begin):
        return none.view(_U), none.view(_U), none, none, none
    last = np.flatnonzero(inside & np.append(first[1:] | ~inside[1:], True))
    size = last - begin + 1
    a = anchor[begin]
    return span_hash(prefix, a, a + gram), span_hash(prefix, begin, begin + size - 1 + match), begin, size, row[begin]


class SuffixFamily:
    """Sorted arrays of the places where windows of a fixed length first stood, in levels of geometric size.

    A batch gets a suffix array of its own (cut at the window's length), is scanned against every level for
    equal windows, and what is new becomes a level; levels of like size are merged.
    """

    def __init__(self, match: int = MATCH):
        self.match = match
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def _windows(self, text: np.ndarray) -> np.ndarray:
        """Every window of text as a fixed string, without a copy. All are of one length, so padding can't make two equal."""
        return np.ndarray((max(0, len(text) - self.match + 1),), f"S{self.match}", text, strides=(1,))

    def add(self, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each start, whether its window stood before: earlier in starts or in any level."""
        text = np.ascontiguousarray(text)
        keys = self._windows(text)[starts]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        for level_text, level in self.levels:
            todo = np.flatnonzero(fresh)
            known, wanted = self._windows(level_text)[level], keys[todo]
            at = np.searchsorted(known, wanted)
            fresh[todo[known[np.minimum(at, len(known) - 1)] == wanted]] = False
        again = np.ones(len(keys), bool)
        again[order[fresh]] = False
        if fresh.any():
            self.levels.append((text, starts[order[fresh]]))
        while len(self.levels) > 1 and len(self.levels[-2][1]) <= 2 * len(self.levels[-1][1]):
            (b_text, b), (a_text, a) = self.levels.pop(), self.levels.pop()
            at = np.searchsorted(self._windows(a_text)[a], self._windows(b_text)[b])
            self.levels.append((np.concatenate([a_text, b_text]), np.insert(a, at, b + len(a_text))))
        return again


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with doc, a number in the order of doc_id, and the same with one row of each doc.

    The number is doc_id itself where that is unique, else the place of (doc_id, text hash), which repeated rows share.
    Only rows that are repeated are shuffled to find one of each.
    """
    twice = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if twice.isEmpty():
        numbered = docs.withColumn("_doc", F.col("doc_id"))
        return numbered, numbered
    fold = F.xxhash64(F.coalesce("text", F.lit("")))
    kinds = docs.select("doc_id", fold.alias("_fold")).groupBy("doc_id", "_fold").agg(F.count("*").alias("_copies"))
    places = in_order(kinds, F.col("doc_id"), F.col("_fold"))
    places = places.select(F.col("doc_id").alias("_id"), "_fold", F.col("row_no").alias("_doc"), "_copies")
    keyed = docs.withColumn("_key", fold)
    placed = written(keyed.join(places, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_fold"))).drop("_id", "_fold", "_key"), "numbered")
    narrow = placed.select("_doc", "text", "_copies")
    single = narrow.filter("_copies = 1").unionByName(narrow.filter("_copies > 1").dropDuplicates(["_doc"]))
    return placed.drop("_copies"), single.drop("_copies")


def _groups(docs: DataFrame, match: int, gram: int) -> DataFrame:
    """key, c, doc, at for each group of windows; see anchors. at holds start, number of windows - 1 and whether a like group stands before it in its batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.sort_by("_doc")
            doc = batch.column(0).to_numpy()
            parts = []
            for a, b, data, bounds in byte_runs(batch.column(1), 1 << 20):
                h, c, begin, size, row = anchors(data, bounds, match, gram)
                parts.append((h, c, doc[a + row], (begin - bounds[row]) << 8 | (size - 1) << 1))
            if not parts:
                continue
            h, c, at_doc, at = (np.concatenate(x) for x in zip(*parts))
            both = h ^ mixed(c)
            order = np.argsort(both, kind="stable")
            seen = np.zeros(len(h), bool)
            seen[order[1:]] = both[order[1:]] == both[order[:-1]]
            # A group known to repeat needs no meeting with others, so it is dealt out by chance.
            h, c = np.where(seen, mixed(both + at.astype(_U) * _U(0x9E3779B97F4A7C15) + at_doc.astype(_U)), h), np.where(seen, _U(0), c)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(at_doc), pa.array(at | seen)], names=["key", "c", "doc", "at"])

    return docs.select("_doc", "text").mapInArrow(run, "key long, c long, doc long, at long")


def _met(groups: DataFrame) -> DataFrame:
    """Groups by what they met: repeated (an equal group stands before), or mixed (unlike groups share its gram; the first of each kind is given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, told = None, False  # the last leading group, and whether it was given
        for batch in batches:
            key, c, doc, at = (x.to_numpy() for x in batch.columns)
            known = at & 1 == 1
            new = np.stack([x[~known] for x in (key, c, doc, at)])
            rows = new if held is None else np.concatenate([held, new], axis=1)
            out_mixed = np.zeros((4, 0), np.int64)
            again = np.zeros(0, np.int64)
            if rows.shape[1]:
                fresh_key = np.ones(rows.shape[1], bool)
                fresh_key[1:] = rows[0, 1:] != rows[0, :-1]
                lead = fresh_key.copy()
                lead[1:] |= rows[1, 1:] != rows[1, :-1]
                again = np.flatnonzero(~lead)
                run_no = np.cumsum(fresh_key) - 1
                several = np.bincount(run_no, weights=lead)[run_no] > 1
                give = lead & several
                if held is not None and told:
                    give[0] = False
                out_mixed = rows[:, give]
                last = int(np.flatnonzero(lead)[-1])
                told = bool(several[last]) or (last == 0 and held is not None and told)
                held = rows[:, last : last + 1]
            docs = np.concatenate([doc[known], rows[2, again], out_mixed[2]])
            ats = np.concatenate([at[known], rows[3, again], out_mixed[3]])
            keys = np.concatenate([np.zeros(len(docs) - out_mixed.shape[1], np.int64), out_mixed[0]])
            mark = np.arange(len(docs)) >= len(docs) - out_mixed.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(docs), pa.array(ats >> 8), pa.array((ats >> 1 & 127) + 1), pa.array(mark)], names=["h", "doc", "start", "n", "mixed"])

    met = groups.repartition(partitions(groups.sparkSession), "key").sortWithinPartitions("key", "c", "doc", "at")
    return met.mapInArrow(run, "h long, doc long, start long, n long, mixed boolean")


def _contents(docs: DataFrame, places: DataFrame, match: int) -> DataFrame:
    """h, doc, start, n and the bytes of the groups in places."""
    lists = places.groupBy("doc").agg(F.collect_list(F.struct("h", "start", "n")).alias("places"))
    wanted = docs.select("_doc", "text").join(lists, F.col("_doc") == F.col("doc")).select("doc", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, places in zip(batch.column(0), batch.column(1), batch.column(2)):
                raw, values = (text.as_py() or "").encode(), places.values
                start, n = values.field(1).to_numpy(), values.field(2).to_numpy()
                body = pa.array([raw[s : s + k + match - 1] for s, k in zip(start.tolist(), n.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([values.field(0), pa.array(np.full(len(start), doc.as_py())), pa.array(start), pa.array(n), body], names=["h", "doc", "start", "n", "body"])

    return wanted.mapInArrow(run, "h long, doc long, start long, n long, body binary")


def _runs(doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Single windows, in order, as runs of consecutive ones."""
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(first)
    return pa.RecordBatch.from_arrays([pa.array(doc[begin]), pa.array(at[begin]), pa.array(np.diff(np.append(begin, len(doc))))], names=["doc", "start", "n"])


def _by_family(contents: DataFrame, n_tasks: int, match: int) -> DataFrame:
    """doc, start, n: runs of windows that stand in an earlier group of the same anchor's gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = SuffixFamily(match)
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            doc, start, n, body = (np.concatenate([np.asarray(h[i]) for h in held]) if i < 3 else b"".join(x for h in held for x in h[3]) for i in range(4))
            text = np.frombuffer(body, np.uint8)
            offset = np.concatenate([[0], np.cumsum(n + match - 1)[:-1]])
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            again = family.add(text, np.repeat(offset, n) + place)
            return _runs(np.repeat(doc, n)[again], (np.repeat(start, n) + place)[again])

        for batch in batches:
            n, bodies = batch.column(3).to_numpy(), batch.column(4).to_pylist()
            doc, start = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            total = np.cumsum(n)
            a = 0
            while a < len(n):
                room = BATCH - sum(int(h[2].sum()) for h in held)
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + room, "right")))
                held.append((doc[a:b], start[a:b], n[a:b], bodies[a:b]))
                a = b
                if sum(int(h[2].sum()) for h in held) >= BATCH:
                    yield flush()
                    held = []
        if held:
            yield flush()

    dealt = contents.repartition(n_tasks, "h").sortWithinPartitions("doc", "start")
    return dealt.mapInArrow(run, "doc long, start long, n long")


def _by_hash(contents: DataFrame, match: int) -> DataFrame:
    """The same for grams with very many unlike groups: each window is a row, and equal ones are summed before they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, start, n, body in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                data = np.frombuffer(body, np.uint8)
                at = np.arange(n)
                one, two = span_hash(prefix_hash(data), at, at + match), span_hash(prefix_hash(data[::-1]), len(data) - at - match, len(data) - at)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.full(n, doc)), pa.array(start + at)], names=["one", "two", "doc", "start"])

    windows = written(contents.mapInArrow(run, "one long, two long, doc long, start long"), "windows")
    first = windows.groupBy("one", "two").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("k")).filter("k > 1").select("one", "two", "first")
    return windows.join(first, ["one", "two"]).filter(F.struct("doc", "start") != F.col("first")).select("doc", "start", F.lit(1).cast("long").alias("n"))


def repeated_spans(docs: DataFrame, match: int = MATCH, gram: int = GRAM, hot: int | None = None) -> DataFrame:
    """doc, start, n: runs of n windows, from byte start on, that stand earlier too. docs has _doc, each once, and text.

    Windows are grouped by anchor. Whole groups that repeat are found by hash; where unlike groups
    share a gram, their bytes go to suffix families, each of which takes its tasks' groups in order. A gram of more than hot (HOT) unlike groups
    has its windows met by two 64-bit hashes instead. Of like groups each batch sends one to the task where they meet, so that reads no more rows of a
    group than there are batches.
    """
    met = written(_met(_groups(docs, match, gram)), "met")
    repeated = met.filter("not mixed").select("doc", "start", "n")
    unlike = met.filter("mixed")
    total = unlike.count()
    if not total:
        return repeated
    crowded = written(unlike.groupBy("h").agg(F.count("*").alias("k")).filter(F.col("k") > (HOT if hot is None else hot)).select("h"), "hot")
    contents = _contents(docs, unlike, match)
    n_tasks = max(partitions(docs.sparkSession), -(-total // TASK))
    if crowded.isEmpty():
        return repeated.unionByName(written(_by_family(contents, n_tasks, match), "again"))
    contents = written(contents, "contents")
    cool = written(_by_family(contents.join(crowded, "h", "left_anti"), n_tasks, match), "again")
    return repeated.unionByName(cool).unionByName(_by_hash(contents.join(crowded, "h", "left_semi"), match))


def without_repeats(docs: DataFrame, match: int = MATCH, gram: int = GRAM) -> DataFrame:
    """docs without the bytes that a string of match bytes covers which also starts earlier.

    Earlier is a smaller doc_id, or the same document and an earlier start; all strings are judged on the
    input. Returns the columns of docs, text shortened (characters cut in part are dropped whole), and
    n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of the bytes that are left.

    Null text is empty and becomes the empty text; null doc_ids stand first; rows that share a doc_id
    stand in the order of their texts' hashes, and rows equal in doc_id and text are one place and don't remove each
    other; texts shorter than match bytes stay; an empty table gives no rows; texts of any length are read whole.
    Columns of docs named like the four that are added are replaced by them.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    docs = docs.drop(*added)
    given = docs.columns
    columns = [c if c in ("doc_id", "text") else f"x{i}" for i, c in enumerate(given)]  # any name may be given
    docs = docs.toDF(*columns)
    numbered, single = _numbered(docs)
    spans = repeated_spans(single, match, gram).groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("_spans")).withColumnRenamed("doc", "_of")
    joined = numbered.join(spans, F.col("_doc") == F.col("_of"), "left").select(*columns, "_spans")
    place = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, stats = [], []
            for text, spans in zip(batch.column(place), batch.column(len(columns))):
                text = text.as_py() or ""
                raw = text.encode()
                removed = n_spans = 0
                kept = raw
                if spans.is_valid:
                    start, n = spans.values.field(0).to_numpy(), spans.values.field(1).to_numpy()
                    order = np.argsort(start)
                    start, end = start[order], (start + n + match - 1)[order]
                    far = np.maximum.accumulate(end)
                    open_ = np.ones(len(start), bool)
                    open_[1:] = start[1:] > far[:-1]
                    a = start[open_]
                    b = np.append(far[np.flatnonzero(open_)[1:] - 1], far[-1])
                    removed, n_spans = int((b - a).sum()), len(a)
                    kept = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)]))
                    text = kept.decode("utf-8", "ignore")
                texts.append(text)
                stats.append((len(raw), removed, n_spans, hashlib.sha256(kept).hexdigest()))
            out = [c for i, c in enumerate(batch.columns) if i not in (place, len(columns))]
            out.insert(place, pa.array(texts, pa.string()))
            out += [pa.array([s[i] for s in stats], pa.int64() if i < 3 else pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(out, names=[*columns, *added])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in columns] + ["n_bytes long, n_removed long, n_spans long, kept_sha256 string"])
    return joined.mapInArrow(run, schema).toDF(*given, *added)


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
