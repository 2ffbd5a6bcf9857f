"""Embedding bundles and relation vectors, saved and loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.functions.text import relation_key


def save_embeddings(nodes: DataFrame, folder: str) -> None:
    """Vectors with their URI map, by graph: nodes(graph, idx, uri, label, vec)."""
    nodes.select("graph", "idx", "uri", "label", F.col("vec").cast("array<double>").alias("vec"), F.size("vec").alias("dim")).write.mode("overwrite").partitionBy("graph").parquet(folder)


def load_embeddings(spark: SparkSession, folder: str, graph: str | None = None) -> DataFrame:
    """graph, idx, uri, label, vec of a bundle, or of one graph; a vector of another size than its bundle's is an error."""
    found = spark.read.parquet(folder).where(F.lit(graph is None) | (F.col("graph") == F.lit(graph)))
    checked = F.when(F.size("vec") == F.col("dim"), F.col("vec")).otherwise(F.raise_error(F.lit("a vector has the wrong size")))
    return found.select(F.col("graph").cast("string").alias("graph"), "idx", "uri", "label", checked.alias("vec"))


def save_relations(vectors: DataFrame, folder: str) -> None:
    """label, vec: one vector per relation key; of labels with one key the first counts."""
    keyed = vectors.select(relation_key(F.col("label")).alias("key"), "label", "vec").groupBy("key").agg(F.min_by("vec", "label").alias("vec"))
    keyed.select(F.col("key").alias("label"), "vec").write.mode("overwrite").parquet(folder)


def load_relations(spark: SparkSession, folder: str) -> DataFrame:
    """label, vec by normalized key, whatever form the labels were saved in."""
    return spark.read.parquet(folder).groupBy(relation_key(F.col("label")).alias("label")).agg(F.min_by("vec", "label").alias("vec"))
