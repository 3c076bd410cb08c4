"""Class-based bigrams: exchange clustering, class transitions, word emissions, and scores of whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_runs, documents, lower_ascii, partitions, prefix_hash, span_hash, word_spans, written

#: Frequent words that exchange assigns to classes and whose counts are broadcast, the most frequent of these, which the
#: driver exchanges one by one, classes, and classes by spelling of all other words.
HEAD, CORE, CLASSES, REST = 1 << 18, 1024, 64, 32
#: Passes over the core at most, rounds over the other frequent words, words of one bucket, counts that a task holds, tasks whose counts meet in one, and parts of a step of frequency.
PASSES, ROUNDS, BUCKET, HELD, FAN, FOLDS = 40, 2, 2048, 1 << 21, 16, 4096
_TOTAL = CLASSES + REST + 1  # the last class is the end token's
_SIDES = 2 * _TOTAL + 1  # classes after a word, classes before it, and the word after itself
_U = np.uint64


@dataclass
class Model:
    """What the corpus gives: frequent words by hash, sorted, with counts; classes of symbols (see _encoded); class bigrams."""

    head: np.ndarray
    count: np.ndarray
    classes: np.ndarray
    matrix: np.ndarray
    #: (stage, log likelihood of the class bigrams, words moved) of every pass and round.
    history: list[tuple[str, float, int]] = field(default_factory=list)


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word. The low five bits of a hash are the word's class among the rest: by its last two bytes."""
    data = lower_ascii(data)
    start, end, row = word_spans(data, bounds)
    if not len(start):
        return np.zeros(0, _U), row
    last = data[end - 1].astype(np.int64) * 257 + np.where(end - start > 1, data[np.maximum(end - 2, 0)], 0)
    return span_hash(prefix_hash(data), start, end) & ~_U(REST - 1) | ((last * 2654435761 >> 11) % REST).astype(_U), row


def _rest(h: np.ndarray) -> np.ndarray:
    return (h & _U(REST - 1)).astype(np.int64)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes of all parts (codes, counts) and their sums."""
    code, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    at = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return code[at], np.add.reduceat(n, at) if len(at) else n


def _frequent(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of about HEAD most frequent words, sorted, and their counts. A task sums words until it holds HELD of them, then gives them on.

    Words are taken down to a step of frequency, of which a part by hash fills up HEAD, so no task or driver sees more words than are taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, _, d, b in byte_runs(batch.column(0), 1 << 20):
                held.append(np.unique(_words(d, b)[0], return_counts=True))
                if sum(len(x) for x, _ in held) > HELD:
                    held = [_summed(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield out(*held[0])
                        held = []
        if held:
            yield out(*_summed(held))

    words = written(train.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")
    # Steps of frequency: each number below 1,024, then 64 to a doubling, so there are a few thousand whatever the corpus.
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor(F.log2(F.col("n") / 1024) * 64))
    taken, edge, part = 0, -1, 0
    for r in sorted(words.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect(), reverse=True):
        if taken + r["k"] > HEAD:
            edge, part = r["s"], (HEAD - taken) * FOLDS // r["k"]
            break
        taken += r["k"]
    top = words.filter((step > edge) | ((step == edge) & (F.pmod("h", F.lit(FOLDS)) < part))).toArrow()
    h, n = (top.column(i).to_numpy().astype(np.int64) for i in range(2))
    h = h.view(_U)
    order = np.argsort(h)
    return h[order], n[order]


def _places(h: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Place of each word in head, or -1."""
    if not len(head):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(head, h), len(head) - 1)
    return np.where(head[at] == h, at, -1)


def _with_ends(values: np.ndarray, row: np.ndarray, n_rows: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """values with end after each row's, and the rows' bounds in them."""
    each = np.bincount(row, minlength=n_rows)
    bounds = np.concatenate([[0], np.cumsum(each + 1)])
    out = np.full(bounds[-1], end, np.int64)
    out[np.arange(len(values)) + row] = values
    return out, bounds


def _encoded(train: DataFrame, head: np.ndarray) -> DataFrame:
    """symbols: the texts as 32-bit numbers, a run of texts to a row: a word's place in head, else len(head) plus its rest class; an end stands before the first and after each text."""
    shared = train.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        end = len(head) + REST
        for batch in batches:
            for a, b, data, bounds in byte_runs(batch.column(0), 1 << 20):
                h, row = _words(data, bounds)
                at = _places(h, head)
                now, _ = _with_ends(np.where(at >= 0, at, len(head) + _rest(h)), row, b - a, end)
                yield pa.RecordBatch.from_arrays([pa.array([np.append(end, now).astype("<i4").tobytes()], pa.binary())], names=["symbols"])

    return written(train.select("text").mapInArrow(run, "symbols binary"), "symbols")


def _counted(symbols: DataFrame, codes: Callable[[np.ndarray], list[np.ndarray]], width: int) -> DataFrame:
    """bucket, code, n: counts of the codes that each run of symbols gives, as two packed arrays for each bucket of width codes.

    Tasks sum before the shuffle and hold about HELD counts. What FAN tasks have of a bucket, width counts each at most, meets in one task, and
    so on until a bucket is one row: no task reads more on a larger input.
    """

    def packed(parts: list[tuple[np.ndarray, np.ndarray]], part: int) -> Iterator[pa.RecordBatch]:
        code, n = _summed(parts)
        bucket = code // width
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(code) else []
        for a, b in zip(first, np.append(first[1:], len(code)) if len(code) else []):
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a])], pa.int32()), pa.array([part], pa.int32()), pa.array([code[a:b].astype("<i4").tobytes()], pa.binary()), pa.array([n[a:b].astype("<i8").tobytes()], pa.binary())], names=["bucket", "part", "code", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for run in batch.column(0):
                for code in codes(np.frombuffer(run.as_buffer(), "<i4")):
                    held.append(np.unique(code.astype(np.int32), return_counts=True))
                if sum(len(x) for x, _ in held) > HELD:
                    held = [_summed(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield from packed(held, part)
                        held = []
        if held:
            yield from packed(held, part)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        last = None
        for batch in batches:
            for bucket, part, code, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if last != (bucket, part) and held:
                    yield from packed(held, last[1])
                    held = []
                last = bucket, part
                held.append((np.frombuffer(code.as_buffer(), "<i4"), np.frombuffer(n.as_buffer(), "<i8")))
                if sum(len(x) for x, _ in held) > HELD:
                    held = [_summed(held)]
        if held:
            yield from packed(held, last[1])

    kind = "bucket int, part int, code binary, n binary"
    out, parts = symbols.mapInArrow(count, kind), symbols.rdd.getNumPartitions()
    while True:
        parts = -(-parts // FAN)
        out = out.withColumn("part", F.expr(f"cast(part div {FAN} as int)")).repartition(partitions(symbols.sparkSession), "bucket", "part")
        out = out.sortWithinPartitions("bucket", "part").mapInArrow(add, kind)
        if parts <= 1:
            return out.drop("part")


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a few buckets."""
    code = [np.frombuffer(x.as_buffer(), "<i4") for x in rows.column("code")]
    n = [np.frombuffer(x.as_buffer(), "<i8") for x in rows.column("n")]
    return (np.concatenate(code).astype(np.int64), np.concatenate(n)) if code else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _f(x: np.ndarray) -> np.ndarray:
    """x log x of counts."""
    return x * np.log(np.maximum(x, 1.0))


def likelihood(matrix: np.ndarray) -> float:
    """Log likelihood of class bigrams but for a constant: what exchange raises."""
    return float(_f(matrix).sum() - _f(matrix.sum(0)).sum() - _f(matrix.sum(1)).sum())


def exchange(a: np.ndarray, b: np.ndarray, n: np.ndarray, classes: np.ndarray, n_words: int, passes: int = PASSES, history: list | None = None) -> np.ndarray:
    """Exchange clustering: each of the first n_words symbols in turn goes to the class that makes class bigrams most likely.

    a, b, n: counts of symbol b after symbol a; classes: the first class of every symbol, of which those from n_words on stay. Sums
    of each word's neighbours by class follow every move, so no move makes the bigrams less likely. Ends with a pass in which no word moves, or after `passes`.
    """
    classes = classes.copy()
    out, into = np.zeros((n_words, _TOTAL)), np.zeros((n_words, _TOTAL))
    np.add.at(out, (a[a < n_words], classes[b[a < n_words]]), n[a < n_words])
    np.add.at(into, (b[b < n_words], classes[a[b < n_words]]), n[b < n_words])
    own = np.zeros(n_words)
    twice = (a == b) & (a < n_words)
    own[a[twice]] = n[twice]
    near = (a < n_words) & (b < n_words) & (a != b)

    def neighbours(key: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(key[near], kind="stable")
        return other[near][order], n[near][order], np.searchsorted(key[near][order], np.arange(n_words + 1))

    after, before = neighbours(a, b), neighbours(b, a)
    matrix = np.zeros((_TOTAL, _TOTAL))
    np.add.at(matrix, (classes[a], classes[b]), n)
    f, k = _f(matrix), np.arange(CLASSES)
    row, column = matrix.sum(1), matrix.sum(0)
    for _ in range(passes):
        moved = 0
        for i in range(n_words):
            g, x, y, w = classes[i], out[i].copy(), into[i].copy(), own[i]
            x[g] -= w
            y[g] -= w
            total = x.sum() + w
            if not total:
                continue
            matrix[g] -= x
            matrix[:, g] -= y
            matrix[g, g] -= w
            f[g], f[:, g] = _f(matrix[g]), _f(matrix[:, g])
            row[g] -= total
            column[g] -= total
            to, of = np.flatnonzero(x), np.flatnonzero(y)
            with_x = _f(matrix[:CLASSES, to] + x[to]) - f[:CLASSES, to]
            with_y = _f(matrix[of, :CLASSES] + y[of, None]) - f[of, :CLASSES]
            # The class's own cell takes both and what stands after itself; it is counted once.
            with_x[to[:, None].T == k[:, None]] = 0
            with_y[of[:, None] == k] = 0
            d = matrix[k, k]
            gain = with_x.sum(1) + with_y.sum(0) + _f(d + x[k] + y[k] + w) - f[k, k]
            gain -= _f(row[k] + total) - _f(row[k]) + _f(column[k] + total) - _f(column[k])
            best = int(np.argmax(gain))
            if best == g or (g < CLASSES and gain[best] <= gain[g] + 1e-6):
                best = g
            matrix[best] += x
            matrix[:, best] += y
            matrix[best, best] += w
            f[best], f[:, best] = _f(matrix[best]), _f(matrix[:, best])
            row[best] += total
            column[best] += total
            if best == g:
                continue
            moved += 1
            classes[i] = best
            for (other, times, bounds), table in ((after, into), (before, out)):
                at = slice(bounds[i], bounds[i + 1])
                table[other[at], g] -= times[at]
                table[other[at], best] += times[at]
            for table in (out, into):
                table[i, g] -= w
                table[i, best] += w
        if history is not None:
            history.append(("core", likelihood(matrix), moved))
        if not moved:
            break
    return classes


def moves(words: np.ndarray, out: np.ndarray, into: np.ndarray, own: np.ndarray, now: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The class to which each word's exchange would take it, all others staying.

    out, into: counts of the classes after and before each word, itself left out; own: of the word after itself; now: its class. The gains are those of
    exchange, of which only the cells that a word touches are computed.
    """
    k, f, row, column = np.arange(CLASSES), _f(matrix), matrix.sum(1), matrix.sum(0)
    n, each = len(words), np.arange(len(words))
    here = now[:, None] == k
    total = out.sum(1) + own
    gain = np.zeros((n, CLASSES))
    for x, y, m, fm in ((out, into, matrix, f), (into, out, matrix.T, f.T)):
        i, d = np.nonzero(x)
        v = x[i, d][:, None]
        base, known = m[:CLASSES].T[d], fm[:CLASSES].T[d]
        # Without the word, its own class's row has lost v, and its own class's column what stands on the other side.
        changed = here[i]
        lost = np.where(changed, v, 0.0)
        at = np.flatnonzero(d == now[i])
        lost[at] += y[i[at]][:, :CLASSES]
        changed = changed.copy()
        changed[at] = True
        base = base - lost
        known = np.where(changed, _f(base), known)
        term = _f(base + v) - known
        term[d[:, None] == k] = 0
        np.add.at(gain, i, term) if len(i) < 64 else _add_rows(gain, i, term)
    d = np.broadcast_to(matrix[k, k], (n, CLASSES)) - np.where(here, out[:, :CLASSES] + into[:, :CLASSES] + own[:, None], 0)
    gain += _f(d + out[:, :CLASSES] + into[:, :CLASSES] + own[:, None]) - _f(d)
    for margin in (row, column):
        left = margin[k] - np.where(here, total[:, None], 0)
        gain -= _f(left + total[:, None]) - _f(left)
    best = gain.argmax(1)
    inner = now < CLASSES
    stay = inner & (gain[each, best] <= gain[each, np.where(inner, now, 0)] + 1e-6)
    return np.where(stay | (total <= 0), now, best)


def _add_rows(into: np.ndarray, i: np.ndarray, rows: np.ndarray) -> None:
    """into[i] += rows, for i in rising order."""
    first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    into[i[first]] += np.add.reduceat(rows, first, axis=0)


def _round(symbols: DataFrame, classes: np.ndarray, loose: np.ndarray) -> tuple[np.ndarray, DataFrame]:
    """The matrix of class bigrams, and for each bucket of loose words the counts of classes beside them."""
    n_buckets = -(-len(loose) // BUCKET)
    width = BUCKET * _SIDES
    shared = symbols.sparkSession.sparkContext.broadcast((classes.astype(np.int32), np.append(loose, np.zeros(REST + 1, bool))))

    def codes(s: np.ndarray) -> list[np.ndarray]:
        classes, loose = shared.value
        a, b = s[:-1], s[1:]
        p, q = classes[a], classes[b]
        x, y = loose[a], loose[b]
        same = x & (a == b)
        return [n_buckets * width + p * _TOTAL + q, a[x] * _SIDES + q[x], b[y] * _SIDES + _TOTAL + p[y], a[same] * _SIDES + 2 * _TOTAL]

    counts = written(_counted(symbols, codes, width), "sums")
    code, n = _unpacked(counts.filter(F.col("bucket") == n_buckets).toArrow())  # at most _TOTAL squared counts
    matrix = np.zeros(_TOTAL * _TOTAL)
    matrix[code - n_buckets * width] = n
    return matrix.reshape(_TOTAL, _TOTAL), counts.filter(F.col("bucket") < n_buckets)


def _moved(counts: DataFrame, classes: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """classes after one exchange of every loose word against the settled matrix; the words of a bucket are judged where its counts lie."""
    shared = counts.sparkSession.sparkContext.broadcast((classes, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, matrix = shared.value
        for batch in batches:
            for bucket, code, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                code, n = np.frombuffer(code.as_buffer(), "<i4").astype(np.int64), np.frombuffer(n.as_buffer(), "<i8")
                word = code // _SIDES
                words = np.unique(word)
                new = []
                for a in range(0, len(words), 128):
                    some = words[a : a + 128]
                    at = slice(np.searchsorted(word, some[0]), np.searchsorted(word, some[-1], "right"))
                    table = np.zeros((len(some), _SIDES))
                    table[np.searchsorted(some, word[at]), code[at] % _SIDES] = n[at]
                    now, own = classes[some], table[:, 2 * _TOTAL]
                    out, into = table[:, :_TOTAL], table[:, _TOTAL : 2 * _TOTAL]
                    out[np.arange(len(some)), now] -= own
                    into[np.arange(len(some)), now] -= own
                    new.append(moves(some, out, into, own, now, matrix))
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.concatenate(new).astype(np.int32))], names=["word", "class"])

    found = counts.mapInArrow(run, "word long, class int").toArrow()  # at most HEAD rows
    new = classes.copy()
    new[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return new


def fit(train: DataFrame, rounds: int = ROUNDS) -> Model:
    """Classes of words and counts of class bigrams over all texts of train.

    The CORE most frequent words are exchanged one by one until none moves, on the counts of their bigrams, of which
    there are CORE squared at most. Every other of the HEAD words starts in the class of its spelling and is exchanged in rounds:
    the cluster sums its neighbours by class, and tasks judge all words of a bucket against the matrix of the round's start. A round
    that leaves the bigrams less likely (its words moved together) is undone and the last. Words beyond HEAD keep the
    class of their spelling.
    """
    head, count = _frequent(train)
    rest = _rest(head)
    symbols = _encoded(train, head)
    n_head = len(head)
    rank = np.empty(n_head, np.int64)
    rank[np.lexsort((head, -count))] = np.arange(n_head)
    core = np.flatnonzero(rank < CORE)
    start = rest[core] + REST * (rank[core] % max(1, CLASSES // REST))
    classes = np.concatenate([CLASSES + rest, CLASSES + np.arange(REST + 1)])
    history: list[tuple[str, float, int]] = []
    if len(core):
        # Symbols of the core's bigrams: core words, then rest classes and the end.
        small = np.concatenate([len(core) + rest, len(core) + np.arange(REST + 1)])
        small[core] = np.arange(len(core))
        size = len(core) + REST + 1
        shared = train.sparkSession.sparkContext.broadcast(small.astype(np.int32))
        code, n = _unpacked(_counted(symbols, lambda s: [shared.value[s[:-1]] * np.int32(size) + shared.value[s[1:]]], 64 * size).toArrow())
        found = exchange(code // size, code % size, n, np.concatenate([start, CLASSES + np.arange(REST + 1)]), len(core), history=history)
        classes[core] = found[: len(core)]
    loose = rank >= CORE
    best = None
    for r in range(rounds + 1):
        last = r == rounds or not loose.any()
        matrix, counts = _round(symbols, classes, loose if not last else np.zeros(n_head, bool))
        now = likelihood(matrix)
        history.append(("all", now, int((best[0] != classes).sum()) if best else 0))
        if best and now < best[2]:
            break
        best = (classes, matrix, now)
        if last:
            break
        classes = _moved(counts, classes, matrix)
        if (classes == best[0]).all():
            break
    return Model(head, count, best[0], best[1], history)


_ROW = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, rest array<int>, tail array<struct<h: long, n: int>>"


def _scanned(docs: DataFrame, head: np.ndarray, logs: np.ndarray, classes: np.ndarray, emission: np.ndarray, transition: np.ndarray, end_log: float, end_known: int) -> DataFrame:
    """One row a document: what head words and classes give, counts of its words in rest classes, and the words beyond head."""
    shared = docs.sparkSession.sparkContext.broadcast((head, logs, classes, emission, transition))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        head, logs, classes, emission, transition = shared.value
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, data, bounds in byte_runs(batch.column(2), 1 << 20):
                h, row = _words(data, bounds)
                at = _places(h, head)
                known = at >= 0
                of = classes[np.where(known, at, len(head) + _rest(h))]
                now, ends = _with_ends(of, row, b - a, _TOTAL - 1)
                step = transition[np.concatenate([[_TOTAL - 1], now[:-1]]), now]
                total = lambda v: np.bincount(row, weights=v, minlength=b - a)
                base = total(np.where(known, logs[at] if len(head) else 0.0, 0.0)) + end_log
                model = np.add.reduceat(step, ends[:-1]) + total(np.where(known, emission[at] if len(head) else 0.0, 0.0))
                spelt = of >= CLASSES
                others = np.bincount(row[spelt] * REST + of[spelt] - CLASSES, minlength=(b - a) * REST).astype(np.int32)
                far = np.flatnonzero(~known)
                order = far[np.lexsort((h[far], row[far]))]
                fresh = np.ones(len(order), bool)
                fresh[1:] = (h[order[1:]] != h[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
                first = np.flatnonzero(fresh)
                times = np.diff(np.append(first, len(order)))
                lone = order[first]
                tail = pa.StructArray.from_arrays([pa.array(h[lone].view(np.int64)), pa.array(times.astype(np.int32))], names=["h", "n"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[lone], np.arange(b - a + 1)), pa.int32()), tail)
                tokens = np.bincount(row, minlength=b - a) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number + np.arange(b - a)), batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(tokens), pa.array(total(known).astype(np.int64) + end_known), pa.array(base), pa.array(model), pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * REST, pa.int32()), pa.array(others)), lists],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "rest", "tail"],
                )
                number += b - a

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, _ROW)


def split(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, text: held out is what leaves 1 by the crc32 of doc_id as text modulo 5."""
    fold = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    return docs.select("doc_id", (fold % 5 == 1).alias("held_out"), "text")


def scored(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Log10 probabilities of all whole texts by a class bigram model of the texts that aren't held out.

    Returns doc_id, held_out (crc32 of doc_id as text leaves 1 modulo 5), n_tokens, n_known, train_tokens, base_score,
    score, perplexity. The HEAD most frequent words are assigned to CLASSES classes by exchange (see fit); every other word's
    class is that of its last two bytes. score is the sum over tokens of log10 of the smoothed class
    transition times the smoothed share of the word in its class, where each class of other words keeps a
    place for unseen ones; a text starts from the end token. The HEAD words are scored in the scan from a broadcast of that size; each
    text's other words are shuffled by word, counted exactly, and summed by text.

    Null text is empty and has the end token alone; a null doc_id counts as the empty string and isn't held out;
    repeated rows count and are scored each; without training texts all counts are 0; an empty table
    gives no rows. Words are told apart by 64-bit hashes. Other columns are ignored.
    """
    docs = split(docs)
    model = fit(docs.filter("not held_out"), rounds)
    head, n, matrix = model.head, model.count, model.matrix
    of_class = model.classes[: len(head)]
    total, end_n = matrix.sum(), matrix[:, _TOTAL - 1].sum()
    transition = np.log10((matrix + 0.5) / (matrix.sum(1, keepdims=True) + 0.5 * _TOTAL))
    # What classes by spelling weigh is known after the scan, which finds their words beyond head.
    inner = of_class < CLASSES
    mass = np.bincount(of_class[inner], weights=n[inner] + 0.5, minlength=_TOTAL)
    emission = np.log10(n + 0.5) - np.where(inner, np.log10(np.maximum(mass[of_class], 0.5)), 0.0)
    rows = written(_scanned(docs, head, np.log10(n + 0.5), model.classes, emission, transition, float(np.log10(end_n + 0.5)), int(end_n > 0)), "scanned")
    tail = rows.select("row", "held_out", F.explode("tail").alias("t")).select("row", "held_out", "t.*")
    seen = written(tail.groupBy("h").agg(F.coalesce(F.sum(F.when(~F.col("held_out"), F.col("n"))), F.lit(0)).alias("seen")).filter("seen > 0"), "seen")
    words = np.zeros(REST)
    for r in seen.groupBy(F.col("h").bitwiseAND(REST - 1).alias("c")).agg(F.count("*").alias("k")).collect():  # at most REST rows
        words[r["c"]] = r["k"]
    known = tail.join(seen, "h", "left").select("row", "n", F.coalesce("seen", F.lit(0)).alias("seen"))
    summed = known.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("seen") + 0.5)).alias("log"), F.sum(F.when(F.col("seen") > 0, F.col("n")).otherwise(0)).alias("known"))
    rest_log = np.log10(matrix[:, CLASSES : CLASSES + REST].sum(0) + 0.5 * (words + np.bincount(of_class[~inner] - CLASSES, minlength=REST) + 1))
    distinct = len(head) + words.sum() + (end_n > 0)
    base_log = float(np.log10(total + 0.5 * (distinct + 1)))
    out = rows.drop("tail").join(summed, "row", "left")
    log, known = F.coalesce("log", F.lit(0.0)), F.coalesce("known", F.lit(0))
    norm = sum((F.col("rest")[i] * F.lit(float(rest_log[i])) for i in range(REST)), F.lit(0.0))
    out = out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + log - F.col("n_tokens") * base_log).alias("base_score"), (F.col("model") + log - norm).alias("score"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op2_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))
