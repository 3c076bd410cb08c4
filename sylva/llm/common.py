"""What the operators of this subpackage share: written tables, global order, word and byte views."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import partitions, shared_dir, written  # noqa: F401  for the operators too

#: White space of the word contracts: space and the bytes 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def with_own_names(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f, which returns the columns of its first argument, on tables whose other columns may have any names, also those that f uses itself."""

    @wraps(f)
    def run(docs: DataFrame, *args: object, **how: object) -> DataFrame:
        names = [c if c in ("doc_id", "text", "lang", "source") else f"x{i}" for i, c in enumerate(docs.columns)]
        return f(docs.toDF(*names), *args, **how).select(*names).toDF(*docs.columns)

    return run


def in_order(df: DataFrame, *order: Column, size: str | None = None) -> DataFrame:
    """Adds row_no (from 0) and, given size, start (the sum of size over the rows before) in one global order.

    Rows are dealt by range, so each task sorts one range; what stands before a range comes from
    per-range totals, of which there are as many as shuffle partitions, and these alone are broadcast.
    df must be narrow: it is written once. Rows that tie in the order share a range and stand in any
    order among themselves, so the order should end in columns that make ties equal rows.
    """
    spark = df.sparkSession
    ranged = written(df.repartitionByRange(partitions(spark), *order).withColumn("_part", F.spark_partition_id()), "ranged")
    total = F.sum(size) if size else F.lit(0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_part").agg(F.count("*").alias("_n"), total.cast("long").alias("_s"))
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    within = Window.partitionBy("_part").orderBy(*order)
    out = ranged.withColumn("row_no", F.row_number().over(within).cast("long") - 1)
    if size:
        out = out.withColumn("start", F.coalesce(F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    out = out.join(F.broadcast(parts), "_part").withColumn("row_no", F.col("row_no") + F.col("_n0"))
    if size:
        out = out.withColumn("start", F.col("start") + F.col("_s0"))
    return out.drop("_part", "_n0", "_s0")


def byte_runs(column: pa.Array, limit: int = 1 << 22) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a text column into runs of whole rows of about limit bytes.

    Gives first row, row after the last, the run's UTF-8 bytes and the rows' bounds in them. A longer row
    is a run of its own; null counts as empty.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        a = b


_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of x."""
    x = x ^ (x >> _S33)
    x = x * _MIX1
    x ^= x >> _S33
    x = x * _MIX2
    x ^= x >> _S33
    return x


#: An odd multiplier and its inverse modulo 2**64, for hashes of substrings by prefix sums.
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i from 0 to n, modulo 2**64."""
    have = _powers.get(0)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        pair = []
        for b in (BASE, _INVERSE):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            pair.append(np.multiply.accumulate(x))
        have = _powers[0] = (pair[0], pair[1])
    return have


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[i] the sum of (data[j] + 1) * BASE**j over j < i; see span_hash."""
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans start to end: equal spans have equal hashes wherever they stand."""
    _, q = powers(len(prefix))
    return mixed((prefix[end] - prefix[start]) * q[start] + (end - start).astype(np.uint64))


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    up = (data >= 65) & (data <= 90)
    return data + (up.astype(np.uint8) << 5)


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the row of each; words never cross rows."""
    n = len(data)
    space = np.ones(n + 1, bool)
    space[:n] = is_space(data)
    begins = np.zeros(n + 1, bool)
    begins[bounds[:-1]] = True
    prior = np.ones(n + 1, bool)
    prior[1:] = space[:-1]
    start = np.flatnonzero(~space & (prior | begins))
    # A word ends where a space or the next row begins.
    stop = np.flatnonzero(space | begins)
    end = stop[np.searchsorted(stop, start, "right")] if len(start) else start
    row = np.searchsorted(bounds, start, "right") - 1
    return start, end, row
