"""Near duplicates: MinHash bands propose, odd sketches sift, full shingle sets decide."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_runs, documents, lower_ascii, mixed, partitions, prefix_hash, span_hash, with_own_names, word_spans, written
from .graph import components

#: Bits of an odd sketch, members of a bucket whose sketches are compared in one cell, most parts of a cell where texts are, rows that fill such a part, members that share a
#: copy of their leader, bits of the map of wanted texts.
SKETCH_BITS, BLOCK, PARTS, FULL, STAR, MAP_BITS = 512, 4096, 8, 1024, 256, 1 << 24
#: Bytes of text whose words are hashed at once (this takes some 40 bytes a byte), shingles of the texts that one task of cells gets.
RUN, SHARE = 1 << 18, 1 << 20
_U = np.uint64


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one row after the other, and the rows' bounds in them.

    A row with fewer words than a shingle has, but at least one, has its whole sequence as one shingle.
    """
    data = lower_ascii(data)
    start, end, row = word_spans(data, bounds)
    n_rows = len(bounds) - 1
    each = np.bincount(row, minlength=n_rows)
    word = span_hash(prefix_hash(data), start, end) if len(start) else np.zeros(0, _U)
    n = len(word)
    value = np.zeros(n, _U)
    spread = np.arange(1, words + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) | _U(1)
    for k in range(words):
        value[: max(0, n - k)] += mixed(word[k:] + _U(k)) * spread[k]
    first = np.concatenate([[0], np.cumsum(each)])
    to_end = first[row + 1] - np.arange(n)
    valid = to_end >= words
    for r in np.flatnonzero((each > 0) & (each < words)):
        a, b = first[r], first[r + 1]
        value[a] = (mixed(word[a:b] + np.arange(b - a, dtype=_U)) * spread[: b - a]).sum(dtype=_U) + _U(b - a)
        valid[a] = True
    value, owner = mixed(value[valid]), row[valid]
    count = np.bincount(owner, minlength=n_rows)
    at = np.concatenate([[0], np.cumsum(count)])
    for r in np.flatnonzero(count > 1):
        value[at[r] : at[r + 1]].sort()
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_rows))])


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.Philox(20_011))
    return rng.integers(0, 1 << 63, n, dtype=_U) << _U(1) | _U(1), rng.integers(0, 1 << 63, n, dtype=_U)


def odd_sketches(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Rows of MinHash samples -> rows of bits / 64 words: each (place, sample) flips one bit."""
    rows, k = samples.shape
    bit = mixed(samples + np.arange(1, k + 1, dtype=_U) * _U(0xD1342543DE82EF95)) % _U(bits)
    out = np.zeros((rows, bits // 64), _U)
    r = np.repeat(np.arange(rows), k)
    np.bitwise_xor.at(out, (r, (bit >> _U(6)).ravel().astype(np.intp)), _U(1) << (bit & _U(63)).ravel())
    return out


def most_odd_bits(k: int, percent: int) -> int:
    """XOR bits that two sketches of k samples have at most at this similarity, but for six standard deviations."""
    d = 1 - percent / 100
    return 2 * min(k, math.ceil(k * d + 6 * math.sqrt(k * d * (1 - d)) + 1))


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, fold, n_shingles, node (128 bits that name the set; null if empty), bands (one bucket for each), odd."""
    mul, add = _constants(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in byte_runs(batch.column(1), RUN):
                values, at = shingle_sets(data, bounds, words)
                size = np.diff(at)
                full = np.flatnonzero(size)
                low = np.zeros((b - a, bands * rows), _U)
                name = np.zeros((b - a, 2), _U)
                if len(full):
                    cut = at[:-1][full]
                    for j in range(bands * rows):
                        low[full, j] = np.minimum.reduceat(values * mul[j] + add[j], cut)
                    name[full, 0] = np.add.reduceat(mixed(values + _U(0x1234567)), cut)
                    name[full, 1] = np.add.reduceat(mixed(values ^ _U(0x9ABCDEF012345)), cut)
                key = np.broadcast_to(np.arange(bands, dtype=_U), (b - a, bands)).copy()
                for j in range(rows):
                    key = mixed(key + low[:, j::rows] + _U(j))
                odd = odd_sketches(low)
                node = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), b - a, [None, pa.py_buffer(name.tobytes())]).cast(pa.binary())
                node = pa.array([x if s else None for x, s in zip(node.to_pylist(), size)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(size, pa.int64()), node, pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * bands, pa.int32()), pa.array(key.view(np.int64).ravel())), pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * odd.shape[1], pa.int32()), pa.array(odd.view(np.int64).ravel()))],
                    names=["doc_id", "fold", "n_shingles", "node", "bands", "odd"],
                )

    narrow = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("fold"))
    return narrow.mapInArrow(run, "doc_id long, fold long, n_shingles long, node binary, bands array<long>, odd array<long>")


def _popcount(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _sifted(pairs: DataFrame, most: int) -> DataFrame:
    """Pairs (u, v, odd_u, odd_v) whose sketches differ in at most `most` bits, as (u, v)."""
    return pairs.filter(F.expr(" + ".join(f"bit_count(odd_u[{i}] ^ odd_v[{i}])" for i in range(SKETCH_BITS // 64))) <= most).select("u", "v")


def _partners(x: int, rows: dict[str, np.ndarray], comp: np.ndarray, most: int, percent: int) -> np.ndarray:
    """Members of a cell, most alike first, that its leading row x must be held against.

    A pair is met in the first bands that it shares, unless its components are joined already or its sketches or
    sizes rule it out. Of two leading rows the smaller one is held against the other.
    """
    band, twin, size, bands = rows["band"][x], rows["twin"][x], rows["size"], rows["bands"]
    y = np.flatnonzero(rows["member"] & (comp != comp[x]) & ~(rows["outer"] & (rows["node"] < rows["node"][x])))
    y = y[100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x])]
    bits = _popcount(rows["odd"][y], rows["odd"][x])
    near = bits <= most
    y, bits = y[near], bits[near]
    alike = bands[y] == bands[x]
    first = ~alike[:, :band].any(1) & ~alike[:, band + 1 : twin].any(1)
    return y[first][np.argsort(bits[first], kind="stable")]


_CELL = ["key", "o", "b", "band", "twin", "leads", "member", "outer", "node", "component", "size", "odd", "bands"]
_CELL_TYPES = "key long, o int, b int, band int, twin int, leads boolean, member boolean, outer boolean, node binary, component binary, size long, odd array<long>, bands array<long>"


def _cells(batches: Iterator[pa.RecordBatch], fold: Callable[[pa.RecordBatch], list]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The cells of sorted rows, each whole, with what fold makes of each row."""
    held: list[pa.RecordBatch] = []
    made: list = []
    for batch in batches:
        extra = fold(batch)
        narrow = batch.select(_CELL)
        key = np.stack([narrow.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)
        cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        for a, b in zip(cut, cut[1:]):
            if held and [held[-1].column(i)[-1].as_py() for i in range(3)] != key[a].tolist():
                yield pa.concat_batches(held), made
                held, made = [], []
            held.append(narrow.slice(a, b - a))
            made.extend(extra[a:b])
    if held:
        yield pa.concat_batches(held), made


def _columns(cell: pa.RecordBatch) -> dict[str, np.ndarray]:
    n = len(cell)
    of = lambda name: cell.column(_CELL.index(name))
    flat = lambda name: np.asarray(of(name).flatten()).reshape(n, -1)
    out = {x: of(x).to_numpy(zero_copy_only=False) for x in ("band", "twin", "leads", "member", "outer", "size")}
    rank = np.unique(np.array(of("node").to_pylist(), object), return_inverse=True)[1]
    return out | {"node": rank, "odd": flat("odd").view(_U), "bands": flat("bands")}


def _several(rows: DataFrame) -> DataFrame:
    """rows(key, component, ...) of keys where several components meet, with n, the key's rows, and its largest component, major, of `most` rows."""
    per = rows.groupBy("key", "component").agg(F.count("*").alias("_n")).groupBy("key")
    per = per.agg(F.sum("_n").alias("n"), F.max_by("component", F.struct("_n", "component")).alias("major"), F.max("_n").alias("most"), F.count("*").alias("_k")).filter("_k > 1").drop("_k")
    return rows.join(per, "key")


def _dealt(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of _CELL for groups(key, band, twin, node, component, n, major, most).

    Those of the largest component need no test among themselves. Every other member, an outer one, leads: it is held against all members
    in cells of about 2 * BLOCK rows, so a group of n members of which k are outer gives n + k * n / BLOCK rows, while k is at most BLOCK.
    """
    blocks = lambda c: F.ceil(c / F.lit(BLOCK)).cast("int")
    rows = groups.select("key", "band", "twin", "node", "component", (F.col("component") != F.col("major")).alias("outer"), blocks(F.col("n")).alias("nb"), blocks(F.col("n") - F.col("most")).alias("ob"))
    h = F.xxhash64("node")
    rows = rows.withColumn("b", F.pmod(h, F.col("nb")).cast("int")).withColumn("o", F.pmod(F.shiftrightunsigned(h, 20), F.col("ob")).cast("int"))
    cell = lambda o, b, leads, member: F.struct(o.cast("int").alias("o"), b.cast("int").alias("b"), leads.alias("leads"), F.lit(member).alias("member"))
    own = F.transform(F.sequence(F.lit(0), F.col("ob") - 1), lambda i: cell(i, F.col("b"), F.col("outer") & (i == F.col("o")), True))
    away = F.filter(F.sequence(F.lit(0), F.col("nb") - 1), lambda i: F.col("outer") & (i != F.col("b")))
    placed = rows.withColumn("_at", F.explode(F.concat(own, F.transform(away, lambda i: cell(F.col("o"), i, F.lit(True), False))))).drop("o", "b").select("*", "_at.*")
    return placed.join(nodes.select("node", F.col("n_shingles").alias("size"), "odd", "bands"), "node").select(*_CELL)


def _together(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    dealt = rows.repartition("key", "o", "b") if tasks is None else rows.repartition(tasks, "key", "o", "b")
    return dealt.sortWithinPartitions("key", "o", "b")


def _sifted_cells(cells: DataFrame, most: int, percent: int) -> DataFrame:
    """The rows of cells that sketches and sizes let have a partner there, with how many these are in their cell: only these need their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, _ in _cells(batches, lambda batch: []):
            rows = _columns(cell)
            names = cell.column(_CELL.index("component")).to_pylist()
            index = {c: i for i, c in enumerate(dict.fromkeys(names))}
            comp = np.array([index[c] for c in names])
            keep = np.zeros(len(cell), bool)
            for x in np.flatnonzero(rows["leads"]):
                y = _partners(x, rows, comp, most, percent)
                keep[y] = True
                keep[x] |= len(y) > 0
            if keep.any():
                yield cell.filter(pa.array(keep)).append_column("kept", pa.array(np.full(keep.sum(), keep.sum()), pa.int32()))

    return _together(cells).mapInArrow(run, f"{_CELL_TYPES}, kept int")


def _split(cells: DataFrame) -> DataFrame:
    """Sifted cells in parts of about FULL rows, PARTS at most: each has its share of the members, and all leading rows.

    So a leading row has one copy for every FULL rows of its cell, and a cell of fewer is left as it is.
    """
    n = F.least(F.ceil(F.col("kept") / F.lit(FULL)), F.lit(PARTS)).cast("int")
    split = cells.withColumn("_n", n).withColumn("_own", F.pmod(F.shiftrightunsigned(F.xxhash64("node"), 40), F.col("_n")).cast("int"))
    split = split.withColumn("_part", F.explode(F.when(F.col("leads"), F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.array("_own"))))
    return split.withColumn("member", F.col("member") & (F.col("_part") == F.col("_own"))).withColumn("b", F.col("b") * PARTS + F.col("_part")).select(*_CELL)


def _runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about RUN bytes of a text column, so that what is made of texts is not held for more."""
    for batch in batches:
        for a, b, _, _ in byte_runs(batch.column(column), RUN):
            yield batch.slice(a, b - a)


def _portions(y: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """y cut so that the sets of a portion have about RUN bytes together."""
    return np.split(y, np.flatnonzero(np.diff(np.cumsum(size[y]) * 8 // RUN)) + 1)


def _links(batches: Iterator[pa.RecordBatch], words: int, most: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of the cells of sorted rows of _CELL and text. The sets of one cell, and of the run after it, are held at a time."""

    def sets_of(batch: pa.RecordBatch) -> list[np.ndarray]:
        out = []
        for a, b, data, bounds in byte_runs(batch.column(len(_CELL)), RUN):
            values, at = shingle_sets(data, bounds, words)
            out += [values[at[r] : at[r + 1]].copy() for r in range(b - a)]
        return out

    for cell, sets in _cells(_runs(batches, len(_CELL)), sets_of):
        rows = _columns(cell)
        names = cell.column(_CELL.index("component")).to_pylist()
        index = {c: i for i, c in enumerate(dict.fromkeys(names))}
        comp = np.array([index[c] for c in names])
        found = []
        for x in np.flatnonzero(rows["leads"]):
            for y in _portions(_partners(x, rows, comp, most, percent), rows["size"]):
                y = y[comp[y] != comp[x]]
                for z in y[similar_to(sets[x], [sets[i] for i in y], percent)]:
                    if comp[z] != comp[x]:
                        found.append((names[x], names[z]))
                        comp[comp == comp[z]] = comp[x]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], names=["u", "v"])


def _linked(cells: DataFrame, texts: DataFrame, words: int, most: int, percent: int) -> DataFrame:
    """Links (u, v) of components that have similar members in a cell, confirmed where these meet: enough to join what is linked, and a link may come from several cells; see _split for cells of many.

    Cells are dealt to one task for every SHARE shingles, and to no fewer than the shuffle partitions; adaptive execution, which goes by compressed bytes, doesn't merge these.
    """
    split = _split(cells)
    tasks = max(partitions(cells.sparkSession), -(-(split.agg(F.sum("size")).first()[0] or 0) // SHARE))
    met = _together(split.join(texts, "node").select(*_CELL, "text"), tasks)
    return met.mapInArrow(lambda batches: _links(batches, words, most, percent), "u binary, v binary")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of the documents that wanted(node, rep) names.

    A map of MAP_BITS bits, which is broadcast, lets most other texts go in the scan, before any shuffle; which ones it lets
    through by chance the join drops.
    """
    spot = lambda doc, fold: F.pmod(F.xxhash64(doc, fold), F.lit(MAP_BITS))
    wanted = wanted.select("node", F.col("rep.doc_id").alias("_doc"), F.col("rep.fold").alias("_fold"))
    marks = wanted.select(spot("_doc", "_fold").alias("x")).groupBy(F.expr("x div 64").alias("_cell")).agg(F.expr("bit_or(shiftleft(1L, cast(x % 64 as int)))").alias("_bits"))
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("fold")).withColumn("x", spot("doc_id", "fold")).withColumn("_cell", F.expr("x div 64"))
    some = keyed.join(F.broadcast(marks), "_cell").filter(F.expr("getbit(_bits, cast(x % 64 as int)) = 1"))  # at most MAP_BITS / 64 rows
    return written(some.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("fold") == F.col("_fold"))).select("node", "text"), "texts")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets, not empty, have 100 * intersection >= percent * union."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[place] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def similar_to(mine: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """What similar gives of one set and each of the others, all not empty, in one pass."""
    if not others:
        return np.zeros(0, bool)
    size, flat = np.array([len(x) for x in others]), np.concatenate(others)
    met = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
    both = np.add.reduceat(met, np.cumsum(size) - size, dtype=np.int64)
    return 100 * both >= percent * (len(mine) + size - both)


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union; they may repeat where texts do.

    pairs: distinct, and a table as written, as they are read three times. texts: node, text. Each leader u meets its members sorted behind it and only its own set is held;
    a leader of many members is copied once for every STAR of them.
    """
    stars = pairs.groupBy("u").agg(F.ceil(F.count("*") / STAR).cast("int").alias("n"))
    members = pairs.join(stars, "u").select("u", F.pmod(F.xxhash64("v"), F.col("n")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("v").alias("node"))
    leaders = stars.select("u", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("u").alias("node"))
    met = members.unionByName(leaders).join(texts, "node").select("u", "salt", "role", "node", "text")
    met = met.repartition(partitions(pairs.sparkSession), "u", "salt").sortWithinPartitions("u", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, mine = None, np.zeros(0, _U)
        for batch in batches:
            us, roles, nodes = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out_u, out_v = [], []
            for a, b, data, bounds in byte_runs(batch.column(4), RUN):
                values, at = shingle_sets(data, bounds, words)
                for r in range(a, b):
                    own = values[at[r - a] : at[r - a + 1]]
                    if roles[r] == 0:
                        leader, mine = us[r], own
                    elif us[r] == leader and similar(own, mine, percent):
                        out_u.append(us[r])
                        out_v.append(nodes[r])
            yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.binary()), pa.array(out_v, pa.binary())], names=["u", "v"])

    return met.mapInArrow(run, "u binary, v binary")


def _groups(buckets: DataFrame, nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """What _dealt takes: buckets in which members of several components meet.

    A bucket of more than BLOCK outer members is split by a second band that members share, a later one: two similar sets share many bands, and
    that these are just one has a probability below 1e-7 at similarity 0.8 and 24 bands of 3 rows.
    """
    placed = buckets.join(comp, "node", "left").select(F.col("bucket").alias("key"), "band", F.col("band").alias("twin"), "node", F.coalesce("component", "node").alias("component"))
    open_ = written(_several(placed), "open")
    wide = F.col("n") - F.col("most") > BLOCK
    hot = open_.filter(wide).select("key", "band", "node", "component").join(nodes.select("node", F.posexplode("bands").alias("twin", "_other")), "node").filter("twin > band")
    hot = _several(hot.select(F.xxhash64("key", "twin", "_other").alias("key"), "band", "twin", "node", "component"))
    return open_.filter(~wide).unionByName(hot)


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp(node, component), which leaves out nodes that are their own component, once the components that links(u, v) names are one."""
    joined = components(links)
    moved = comp.join(joined.select(F.col("node").alias("component"), F.col("component").alias("_joined")), "component", "left")
    return moved.select("node", F.coalesce("_joined", "component").alias("component")).unionByName(joined)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 24, rows: int = 3) -> DataFrame:
    """Components of documents whose sets of word shingles have a Jaccard similarity of percent or more.

    Returns doc_id, fold (hash of the text), n_shingles, component_id (the smallest doc_id reachable) and kept.
    Rows with one set are one node. In every bucket of one band the smallest node leads; each node is held on full sets against the least of its
    leaders that odd sketches don't rule out, then, where that has not joined them, against the others. In
    buckets where several components meet, pairs across components are sifted by sketches, and those left are confirmed on
    full sets where they meet; only links leave a cell: no bucket or partner is capped. At 24 bands of 3 rows a pair of similarity 0.8 shares no
    bucket, or is ruled out, with probability below 1e-7.

    Null or empty text and text without words have an empty set and are linked with nothing. Null doc_ids take
    part, but name a component only if all of it is null. Rows that share a doc_id count as one
    document for component_id; repeated rows get equal results. Other columns are ignored.
    """
    sign = written(signatures(docs, words, bands, rows), "signatures")
    nodes = sign.filter("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "fold")).alias("rep"), F.min("doc_id").alias("least"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"), F.any_value("odd").alias("odd"))
    nodes = written(nodes, "nodes")
    banded = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("_n")).filter("_n > 1").select("bucket", "leader")
    buckets = written(banded.join(shared, "bucket"), "buckets")
    most = most_odd_bits(bands * rows, percent)
    of = lambda name: nodes.select(F.col("node").alias(name), F.col("odd").alias(f"odd_{name}"))
    stars = buckets.filter("node <> leader").select(F.col("leader").alias("u"), F.col("node").alias("v")).repartition("v").distinct()  # a node has one leader a band at most
    stars = written(_sifted(stars.join(of("v"), "v").join(of("u"), "u"), most), "stars")
    ends = stars.select(F.col("v").alias("node")).unionByName(stars.select(F.col("u").alias("node"))).distinct()
    texts = _texts(docs, nodes.select("node", "rep").join(ends, "node"))
    # The least leader first; the others only for nodes that this leaves in other components.
    comp = components(confirmed(written(stars.groupBy("v").agg(F.min("u").alias("u")), "first"), texts, words, percent))
    named = lambda name: nodes.select("node").join(comp, "node", "left").select(F.col("node").alias(name), F.coalesce("component", "node").alias(f"c{name}"))
    apart = written(stars.join(named("u"), "u").join(named("v"), "v").filter("cu <> cv"), "apart")
    if not apart.isEmpty():
        links = confirmed(apart.select("u", "v"), texts, words, percent).join(apart, ["u", "v"]).select(F.col("cu").alias("u"), F.col("cv").alias("v"))
        comp = written(_joined(comp, links), "components")
    cells = written(_sifted_cells(_dealt(written(_groups(buckets, nodes, comp), "groups"), nodes), most, percent), "cells")
    if not cells.isEmpty():
        more = cells.select("node").distinct().join(texts.select("node"), "node", "left_anti")
        texts = texts.unionByName(_texts(docs, nodes.select("node", "rep").join(more, "node")))
        comp = _joined(comp, _linked(cells, texts, words, most, percent))
    named = nodes.select("node", "least").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(names, "component").select("node", "component_id")
    out = sign.select("doc_id", "fold", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "fold", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


@with_own_names
def without_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """docs with all its columns, one document of each component kept; of equal rows that stay, one stays."""
    columns = docs.columns
    kept = near_duplicates(docs, **how).filter("kept").select(F.col("doc_id").alias("_doc"), F.col("fold").alias("_kept")).distinct()
    keyed = docs.withColumn("_fold", F.xxhash64(F.coalesce("text", F.lit(""))))
    return keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_fold") == F.col("_kept"))).dropDuplicates(["doc_id", "_fold"]).select(*columns)


def op10_oddsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir), words=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")
