"""Mixing sources to target weights: water-filled targets, then pivotal dependent rounding in a reduction tree."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, in_order, with_own_names, written

#: Documents of one group of the tree's first level, and groups that meet in one group of the next.
GROUP, FAN = 4096, 64


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes(source, source_size, source_rows), one row a source -> the same with target.

    Sources by code point, null last, take weights in turn and share `share` times all sizes. A target
    stops at `most` times its source's size; the excess is shared again by weight until none is above.
    Each round brings three sums to the driver, never the sources.
    """
    ranked = in_order(sizes, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("row_no") % len(weights)).cast("int") + 1)
    ranked = written(ranked.select("source", "source_size", "source_rows", weight.alias("_w")), "sources")
    cap = F.col("source_size") * F.lit(float(most))
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, held = 0.0, -1
    while True:
        over = F.col("_w") * F.lit(level) > cap if held >= 0 else F.lit(False)
        n, capped, open_w = ranked.agg(F.count(F.when(over, 1)), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("_w")))).first()
        if n == held or not open_w:
            break
        level, held = max(0.0, total - (capped or 0.0)) / open_w, n
    return ranked.withColumn("target", F.least(F.col("_w") * F.lit(level), cap)).drop("_w")


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Pairs fractional entries of p and moves size-weighted mass between the two until one is 0 or 1.

    The sum of p * size stays and each entry keeps its expectation; at most one entry is left fractional.
    Entries without size carry no mass and become 0.
    """
    p = p.astype(float).copy()
    p[size <= 0] = 0.0
    todo = np.flatnonzero((p > 0) & (p < 1))
    if len(todo) < 2:
        return p
    draws = rng.random(len(todo))
    a, pa, sa = todo[0], p[todo[0]], float(size[todo[0]])
    for b, u in zip(todo[1:], draws):
        pb, sb = p[b], float(size[b])
        up, down = min((1 - pa) * sa, pb * sb), min(pa * sa, (1 - pb) * sb)
        if u * (up + down) < down:  # mass goes to a
            a_done, b_done = (1 - pa) * sa <= pb * sb, (1 - pa) * sa >= pb * sb
            pa, pb = (1.0 if a_done else pa + up / sa), (0.0 if b_done else pb - up / sb)
        else:
            a_done, b_done = pa * sa <= (1 - pb) * sb, pa * sa >= (1 - pb) * sb
            pa, pb = (0.0 if a_done else pa - down / sa), (1.0 if b_done else pb + down / sb)
        p[a], p[b] = pa, pb
        if a_done:
            a, pa, sa = b, pb, sb
    return p


_STATE = "doc_id long, source string, size long, fold long, whole int, p double, grp long, top boolean"


def _level(df: DataFrame, level: int, seed: int) -> DataFrame:
    """One level of the tree: within (source, grp), all but one fractional entry become 0 or 1; in a source's top group that one is drawn."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "fold"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        source, grp, top = rows.at[0, "source"], int(rows.at[0, "grp"]), bool(rows.at[0, "top"])
        rng = np.random.Generator(np.random.Philox(zlib.crc32(f"{seed}/{level}/{grp}/{source!r}".encode("utf-8", "replace"))))
        p = pivot(rows["p"].to_numpy(), rows["size"].to_numpy(), rng)
        if top:
            left = np.flatnonzero((p > 0) & (p < 1))
            p[left] = (rng.random(len(left)) < p[left]).astype(float)
        return rows.assign(p=p)

    return df.groupBy("source", "grp").applyInPandas(run, _STATE)


def mixed_copies(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """Chooses how many copies of each document the mix takes.

    Returns doc_id, source, size (words; null text: 0), fold (a hash that tells apart texts of one
    doc_id), source_size, target (of its source) and copies, an integer of at most ceil(most).
    A document's expected copies are target / source_size; pivotal rounding keeps each source's taken
    words within one document of its target. Reruns agree: draws are seeded by source and group.

    Groups hold about GROUP documents whatever their source, so a hot source is spread over many tasks;
    what each group leaves (one document at most) meets FAN to one in the next level until a source has
    one group. Null is a source of its own; repeated rows are rounded one by one; documents without
    words take floor copies and count nothing; an empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64("doc_id", text).alias("fold"))
    base = written(base.groupBy("doc_id", "source", "size", "fold").agg(F.count("*").alias("_copies")), "sizes")
    per = base.groupBy("source").agg(F.sum(F.col("size") * F.col("_copies")).alias("source_size"), F.sum("_copies").alias("source_rows"))
    targets = written(source_targets(per, weights, share, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = targets.withColumn("_rate", rate).withColumn("_groups", F.ceil(F.col("source_rows") / GROUP)).withColumnRenamed("source", "_s")
    rows = base.join(rated, F.col("source").eqNullSafe(F.col("_s")))
    # Equal rows share doc_id and fold; numbers among them spread these over groups too.
    rows = rows.withColumn("_no", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    grp = F.pmod(F.when(F.col("_no") > 1, F.xxhash64("fold", "_no")).otherwise(F.col("fold")), F.col("_groups"))
    state = rows.select("doc_id", "source", "size", "fold", F.floor("_rate").cast("int").alias("whole"), (F.col("_rate") - F.floor("_rate")).alias("p"), grp.alias("grp"), (F.col("_groups") <= 1).alias("top"))
    done = []
    groups = int(rated.agg(F.max("_groups")).first()[0] or 1)
    for level in range(1 + max(0, math.ceil(math.log(max(groups, 1), FAN) - 1e-9))):
        state = written(_level(state, level, seed), "pivotal")
        fractional = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(state.filter(~fractional))
        size = FAN ** (level + 1)
        ranks = rated.select("_s", F.ceil(F.col("_groups") / size).alias("_left"))
        state = state.filter(fractional).join(ranks, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "source", "size", "fold", "whole", "p", F.floor(F.col("grp") / FAN).alias("grp"), (F.col("_left") <= 1).alias("top"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.join(targets.select(F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s")))
    return out.select("doc_id", "source", "size", "fold", "source_size", "target", (F.col("whole") + F.col("p").cast("int")).alias("copies"))


@with_own_names
def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of docs, with all its columns, as often as mixed_copies takes it.

    Equal rows are interchangeable, so the copies of repeated rows are summed and dealt evenly.
    """
    columns = docs.columns
    copies = mixed_copies(docs, **how).groupBy("doc_id", "fold").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    copies = copies.withColumnsRenamed({"doc_id": "_doc", "fold": "_fold"})
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit(""))))
    once = keyed.join(copies, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_fold")))
    several = once.filter("_rows > 1").drop("_doc", "_fold")
    # Rows that repeat an earlier row: number them, and give the first ones one copy more where the sum asks for it.
    numbered = several.withColumn("_no", F.row_number().over(Window.partitionBy("doc_id", "_key").orderBy("_key")))
    numbered = numbered.withColumn("_copies", F.expr("_copies div _rows + if(_no <= _copies % _rows, 1, 0)"))
    taken = once.filter("_rows = 1").select(*columns, "_copies").unionByName(numbered.select(*columns, "_copies"))
    return taken.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*columns)


def op8_pivotal(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed_copies(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
