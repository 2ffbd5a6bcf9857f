"""Alignment reports and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.functions.vectors import best_pairs
from twinweave.runtime import materialise


def unaligned(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """graph, idx, label of nodes(idx, label) without a pair(i, a)."""
    x = left.join(pairs.select(F.col("i").alias("idx")), "idx", "left_anti").select(F.lit("left").alias("graph"), "idx", "label")
    y = right.join(pairs.select(F.col("a").alias("idx")), "idx", "left_anti").select(F.lit("right").alias("graph"), "idx", "label")
    return x.unionByName(y)


def alignment_report(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """position, left_entity, right_entity, not_aligned: aligned pairs by similarity, then what is left over.

    position is a sort key: (section, rank value, index) packed as a struct is kept
    out of the export; rows here carry section and order columns.
    """
    names = pairs.join(left.select(F.col("idx").alias("i"), F.col("label").alias("left_entity")), "i").join(right.select(F.col("idx").alias("a"), F.col("label").alias("right_entity")), "a")
    aligned = names.select(F.lit(0).alias("section"), (-F.col("sim")).alias("key"), F.col("i").alias("idx"), "left_entity", "right_entity", F.lit(None).cast("string").alias("not_aligned"))
    rest = unaligned(pairs, left, right).select(F.when(F.col("graph") == "left", 1).otherwise(2).alias("section"), F.lit(0.0).alias("key"), "idx", F.lit(None).cast("string").alias("left_entity"), F.lit(None).cast("string").alias("right_entity"), F.concat("graph", F.lit(": "), "label").alias("not_aligned"))
    return aligned.unionByName(rest)


def report_csv(report: DataFrame, path: str) -> None:
    """The report in order as one CSV file with its three text columns."""
    ordered = report.orderBy("section", "key", "idx").select("left_entity", "right_entity", "not_aligned")
    ordered.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """left_entity, right_entity, not_aligned of a written report; empty cells are null."""
    return spark.read.option("header", True).schema("left_entity string, right_entity string, not_aligned string").csv(path)


def best_similarity(similarity: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """graph, idx, label, best: the highest similarity of every node; 0 where the other side is empty."""
    x = left.join(similarity.groupBy(F.col("i").alias("idx")).agg(F.max("sim").alias("best")), "idx", "left").select(F.lit("left").alias("graph"), "idx", "label", F.coalesce("best", F.lit(0.0)).alias("best"))
    y = right.join(similarity.groupBy(F.col("a").alias("idx")).agg(F.max("sim").alias("best")), "idx", "left").select(F.lit("right").alias("graph"), "idx", "label", F.coalesce("best", F.lit(0.0)).alias("best"))
    return x.unionByName(y)


def best_similarity_of(left: DataFrame, right: DataFrame, digits: int | None = None) -> DataFrame:
    """best_similarity of nodes(idx, label, vec), all pairs compared once and none of them made a row."""
    best = materialise(best_pairs(left.select("idx", "vec"), right.select("idx", "vec"), digits), "best")
    out = None
    for k, (name, nodes) in enumerate((("left", left), ("right", right))):
        own = nodes.join(best.where(F.col("side") == k).select("idx", "best"), "idx", "left").select(F.lit(name).alias("graph"), "idx", "label", F.coalesce("best", F.lit(0.0)).alias("best"))
        out = own if out is None else out.unionByName(own)
    return out


def threshold_misses(best: DataFrame, threshold: float | None, solver: str) -> DataFrame:
    """graph, label, best, reason of nodes below the threshold; none of them if there is no threshold."""
    reason = F.lit(f"{solver} threshold {threshold:.2f}" if threshold is not None else "")
    return best.where(F.lit(threshold is not None) & (F.col("best") < F.lit(threshold))).select("graph", "label", "best", reason.alias("reason"))


def unmatched_nodes(best: DataFrame, matched: DataFrame, threshold: float | None, solver: str) -> DataFrame:
    """graph, label, best, reason of nodes that could match but whose label isn't in matched(graph, label)."""
    able = best if threshold is None else best.where(F.col("best") >= threshold)
    return able.join(matched.select("graph", "label").distinct(), ["graph", "label"], "left_anti").select("graph", "label", "best", F.lit(f"{solver} solver unused").alias("reason"))


def first_unaligned(*tables: DataFrame) -> DataFrame:
    """graph, label, best, reason of several tables in turn, the first of each (graph, label, reason)."""
    out = None
    for n, t in enumerate(tables):
        own = t.select("graph", "label", "best", "reason", F.lit(n).alias("turn"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("graph", "label", "reason").agg(F.min_by("best", F.struct("turn", "best")).alias("best"))
