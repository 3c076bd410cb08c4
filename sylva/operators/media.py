"""Scored listings and search: ranking, score propagation, prune policies, paging.

Ties are broken by the columns named, so reruns agree; rows equal in these stand in any order. Null scores stand last, null sort keys first. Null titles match no
search. Empty tables give no rows. Columns that are added replace those of their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_score(rows: DataFrame, parent: str, score: str, sort_key: str, tie: str) -> DataFrame:
    """rows with position within parent: score falling, then sort key rising, null first (ORD-03, T-31)."""
    w = Window.partitionBy(parent).orderBy(F.desc(score), F.asc_nulls_first(sort_key), tie)
    return rows.withColumn("position", F.row_number().over(w).cast("long"))


def search(rows: DataFrame, title: str, query: str, available_only: bool = False, **equal: object) -> DataFrame:
    """Rows whose title contains query, letter case aside, and whose columns equal those given, for instance watch status and kind (FLT-14).

    available_only keeps rows with a true `available`, which sets.available or a count of sources gives.
    """
    out = rows.filter(F.contains(F.lower(title), F.lit(query.lower())))
    if available_only:
        out = out.filter("available")
    for column, value in equal.items():
        out = out.filter(F.col(column) == value)
    return out


def best_source(rows: DataFrame, item: str, quality: str, source: str, order: list[str]) -> DataFrame:
    """item, source, quality of the best source: the first quality in order, then the least source (ORD-11)."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(quality))
    rank = F.when(rank > 0, rank).otherwise(len(order) + 1)
    return rows.groupBy(item).agg(F.min(F.struct(rank.alias("_r"), F.col(source).alias("source"), F.col(quality).alias("quality"))).alias("_x")).select(item, "_x.source", "_x.quality")


def effective_score(rows: DataFrame, key: str, score: str, anchors: DataFrame, alpha: float = 0.01) -> DataFrame:
    """key, effective: the score pulled by alpha toward its anchors of lower score (AGG-15, FN-18). anchors: key, anchor_score.

    Each anchor pulls by its distance, with the weight 1 / (1 + its score); without lower anchors the score stays. Only sums are joined back.
    """
    w = 1 / (1 + F.col("anchor_score"))
    lower = rows.select(key, score).join(anchors.select(key, "anchor_score"), key).filter(F.col("anchor_score") < F.col(score))
    lower = lower.groupBy(key).agg((F.sum(w * (F.col(score) - F.col("anchor_score"))) / F.sum(w)).alias("_pull"))
    return rows.join(lower, key, "left").select(key, (F.col(score) - F.coalesce(F.lit(alpha) * F.col("_pull"), F.lit(0.0))).alias("effective"))


def truth_rank(score: Column, days: Column) -> Column:
    """score / ln(days + 1 + 1e-9), null for negative ages (ORD-12)."""
    return F.when(days >= 0, score / F.log(days + F.lit(1.0) + F.lit(1e-9)))


def impossibility(c: Column) -> Column:
    """-ln(1 - c) for c in [0, 1), else null (FN-17)."""
    return F.when((c >= 0) & (c < 1), -F.log(F.lit(1.0) - c))


def prune_candidates(rows: DataFrame, policies: DataFrame, group: str, default_days: int) -> DataFrame:
    """Rows older than their own policy, else their group's, else the default; -1 means never (GR-18). rows: own_days, age."""
    days = F.coalesce("own_days", "group_days", F.lit(default_days))
    out = rows.join(policies.select(group, "group_days"), group, "left").withColumn("days", days)
    return out.filter("days >= 0 and age > days").drop("own_days", "group_days")


def children_by_score(children: DataFrame, scores: DataFrame, tie: str = "child_id") -> DataFrame:
    """children(parent_id, child_id, ...) with score and position within their parent, best first (RD-16). scores(id, score); a child without one stands last."""
    own = scores.select(F.col("id").alias("child_id"), "score")
    rows = children.drop("score", "position").join(own, "child_id", "left")
    w = Window.partitionBy("parent_id").orderBy(F.desc_nulls_last("score"), tie)
    return rows.withColumn("position", F.row_number().over(w).cast("long"))


def settings(nodes: DataFrame, links: DataFrame, root: str) -> DataFrame:
    """section, key, id: what lies two live links below root, by the labels of both steps (GR-19). Two joins."""
    live = links.filter("not removed and not suspended").select("parent_id", "child_id")
    name = nodes.select(F.col("id").alias("child_id"), "label")
    sections = live.filter(F.col("parent_id") == root).join(name, "child_id").select(F.col("child_id").alias("parent_id"), F.col("label").alias("section"))
    return live.join(sections, "parent_id").join(name, "child_id").select("section", F.col("label").alias("key"), F.col("child_id").alias("id"))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of an ordered listing: offset at least 0, limit from 1 to 500 (ORD-09)."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(500, max(1, limit)))
