"""Harmonic packing: pieces of near reciprocal length, a fixed number of them to a sequence."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, partitions, written


#: Workers whose leftovers meet in one worker of the next level.
FAN = 1024


class Encoder:
    """Encodes texts by the vocabulary of a byte-level BPE file of the tokenizers library.

    The library's own encoder spends most of its time on offsets and objects; the same merges run here
    in tiktoken, which gives the same ids (tests compare the two). The pre-tokenizer never joins a space and what
    follows to what stands before it, unless white space adjoins the space. So the space-led words of
    the other texts are encoded once for each batch, in one string, and texts are put together from them.
    """

    #: The pre-tokenizer's pattern of this kind of file.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    _SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    ODD = f"{_SPACE} | {_SPACE}|^{_SPACE}|{_SPACE}$"

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.own = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.width = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.width[i] = len(token)

    def encode(self, text: str) -> np.ndarray:
        return self.own.encode_to_numpy(text, allowed_special="all").astype(np.uint32) if text else np.zeros(0, np.uint32)

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, self.ODD).to_numpy(zero_copy_only=False)
        words = pc.split_pattern(texts, " ")
        bounds = np.asarray(words.offsets)
        coded = words.values.dictionary_encode()
        index, names = coded.indices.to_numpy(), coded.dictionary
        used = np.zeros(len(names), bool)
        for r in np.flatnonzero(~odd):
            used[index[bounds[r] + 1 : bounds[r + 1]]] = True
        wanted = np.flatnonzero(used)
        begin, count, flat = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64), np.zeros(0, np.uint32)
        if len(wanted):
            flat = self.encode(" " + " ".join(names.take(pa.array(wanted)).to_pylist()))
            ends = np.cumsum(pc.binary_length(names.take(pa.array(wanted))).to_numpy() + 1)
            stop = np.searchsorted(np.cumsum(self.width[flat]), ends, "left") + 1
            begin[wanted] = np.append(0, stop[:-1])
            count[wanted] = np.diff(stop, prepend=0)
        for r in range(len(texts)):
            if odd[r]:
                yield self.encode(texts[r].as_py())
                continue
            first = self.encode(names[int(index[bounds[r]])].as_py())
            own = index[bounds[r] + 1 : bounds[r + 1]]
            n = count[own]
            to = np.cumsum(n)
            yield np.concatenate([first, flat[np.arange(to[-1] if len(to) else 0) + np.repeat(begin[own] - to + n, n)]])


def cuts(n: int, capacity: int, classes: int, slack: int) -> list[tuple[int, int]]:
    """Cuts n ids into pieces (length, class): whole sequences, then lengths just under capacity // k.

    A piece of class k is at most capacity // k long, and k of them make a sequence. What would waste more
    than 1 / slack of its share is cut down to the next lower class's full length. Pieces too short for the
    last class keep class 0, for which see pack.
    """
    out = [(capacity, 1)] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        if k > classes:
            out.append((n, 0))
            break
        full = capacity // k
        if (full - n) * slack <= full:
            out.append((n, k))
            break
        if k == classes:
            out.append((n, 0))
            break
        full = capacity // (k + 1)
        out.append((full, k + 1))
        n -= full
    return out


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, klass int, copy long, salt int"


def tokenized(docs: DataFrame, tokenizer: str, capacity: int = 2048, classes: int = 16, slack: int = 64, end_id: int = 1) -> DataFrame:
    """One row per piece of each document's ids with end_id after them; see cuts. Texts are read once and not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(tokenizer), np.uint32([end_id])
        task = _task()
        copy = 0
        for batch in batches:
            doc, start, length, crc, total, klass, copies = [], [], [], [], [], [], []
            for i, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1))):
                ids = np.concatenate([ids, end]).astype("<u4").tobytes()
                at, n = 0, len(ids) // 4
                for piece, k in cuts(n, capacity, classes, slack):
                    doc.append(i)
                    start.append(at)
                    length.append(piece)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + piece)]))
                    total.append(n)
                    klass.append(k)
                    copies.append(copy)
                    at += piece
                copy += 1
            salt = np.array([zlib.crc32(b"%d" % c) & 0x7FFFFFFF for c in copies], np.int32)
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, long), pa.array(start, long), pa.array(length, long), pa.array(crc, long), pa.array(total, long), pa.array(klass, pa.int32()), pa.array(np.array(copies, np.int64) + (task << 40), long), pa.array(salt)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "klass", "copy", "salt"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, _PIECE)


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _first_fit(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Best fit, longest first."""
        rows = rows.sort_values(["length", "doc_id", "copy", "start"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        local, offset, made = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), 0
        for i, n in enumerate(rows["length"].to_numpy()):
            room = next((r for r in range(n, capacity) if by_room[r]), capacity)
            bin_no = by_room[room].pop() if room < capacity else made
            made += room == capacity
            local[i], offset[i] = bin_no, capacity - room
            by_room[room - n].append(bin_no)
        return rows.assign(bin=local, offset=offset)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "copy", "kind", "worker", "bin", "offset"]]

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, classes: int = 16, slack: int = 64, worker_rows: int = 100_000, end_id: int = 1) -> DataFrame:
    """Packs all documents into sequences of at most capacity ids.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece.
    Each class's pieces are dealt to workers of about worker_rows pieces; a worker fills bins of exactly k
    pieces by counting, with no word to the others. Pieces that fill no bin (fewer than k for each worker and
    class) are counted again by the next level's workers, each of which takes over from FAN, until a class has one. The
    last of these (fewer than k for each class, whatever the input's size) join the first group of the pieces too short for a
    class; these are dealt in groups of about worker_rows and packed by best fit.

    Null text is empty and has the end id alone; a null doc_id is kept; repeated rows are packed each for
    itself; a text of any length is cut into whole sequences and one remainder; an empty table gives
    no rows. Other columns are ignored.
    """
    pieces = written(tokenized(docs, tokenizer, capacity, classes, slack, end_id), "pieces")
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "copy"]
    by = [F.col("copy"), F.col("start")]
    counts = {r["klass"]: r["n"] for r in pieces.groupBy("klass").agg(F.count("*").alias("n")).collect()}  # one row a class

    def counted(df: DataFrame, kind: int) -> DataFrame:
        """bin, full and offset of pieces dealt by klass and worker."""
        w = Window.partitionBy("klass", "worker").orderBy(*by)
        out = df.withColumn("_no", F.row_number().over(w) - 1).withColumn("bin", F.expr("_no div klass").cast("long"))
        total = F.count("*").over(Window.partitionBy("klass", "worker"))
        out = out.withColumn("full", (F.col("bin") + 1) * F.col("klass") <= total)
        within = Window.partitionBy("klass", "worker", "bin").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return out.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0))).withColumn("kind", F.lit(kind))

    of_class = lambda n: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, c in sorted({0: 0, **counts}.items()) for x in (k, max(1, -(-c // n)))]), F.col("klass")), F.lit(1))
    left = pieces.filter("klass > 0").withColumn("worker", F.pmod("salt", of_class(worker_rows)).cast("long"))
    columns = [*keep, "kind", "klass", "worker", "bin", "offset"]
    parts, most, kind = [], max([1, *(-(-n // worker_rows) for k, n in counts.items() if k)]), 0
    while True:
        level = written(counted(left, kind), "bins")
        parts.append(level.filter("full").select(columns))
        left = level.filter("not full").select(*keep, "klass", F.expr(f"worker div {FAN}").alias("worker"))
        kind += 1
        if most == 1:
            break
        most = -(-most // FAN)
    rest = left.select(*keep, F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("worker"))
    short = pieces.filter("klass = 0").select(*keep, F.lit(kind).alias("kind"), F.pmod("salt", of_class(worker_rows)).cast("long").alias("worker"))
    last = rest.unionByName(short).groupBy("kind", "worker").applyInPandas(_first_fit(capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, copy long, kind int, worker long, bin long, offset long")
    out = last.withColumn("klass", F.lit(0)).select(columns)
    for df in parts:
        out = out.unionByName(df)
    # Seven bits of kind and class, 24 of worker, 32 of bin: distinct by construction.
    number = F.shiftleft((F.col("kind") * (classes + 1) + F.col("klass")).cast("long"), 56) + F.shiftleft(F.col("worker"), 32) + F.col("bin")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", number.alias("sequence_id"), "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), default_tokenizer())
