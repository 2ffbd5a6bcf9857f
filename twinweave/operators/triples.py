"""Triple sets: nodes, indices, edges, merging, pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.config import RDF_TYPE
from twinweave.functions.text import normalize_label, path_name
from twinweave.operators.numbering import numbered

ALIGNED_WITH = "alignedWith"


def distinct_triples(triples: DataFrame) -> DataFrame:
    """Triples as a set."""
    return triples.distinct()


def graph_nodes(triples: DataFrame) -> DataFrame:
    """graph, uri: all subjects, and objects that are URIs."""
    return triples.select("graph", F.col("s").alias("uri")).unionByName(triples.where("o_is_uri").select("graph", F.col("o").alias("uri"))).distinct()


def node_index(triples: DataFrame) -> DataFrame:
    """graph, uri, idx: nodes of each graph numbered from 0 in code point order."""
    return numbered(graph_nodes(triples), ["uri"], partition="graph")


def relation_edges(triples: DataFrame) -> DataFrame:
    """URI-to-URI triples that aren't type statements."""
    return triples.where(F.col("o_is_uri") & (F.col("p") != RDF_TYPE))


def resolve_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph, src, dst, label of edges(graph, s, p, o) both of whose ends are nodes(graph, uri, idx)."""
    source = nodes.select("graph", F.col("uri").alias("s"), F.col("idx").alias("src"))
    target = nodes.select("graph", F.col("uri").alias("o"), F.col("idx").alias("dst"))
    return edges.join(source, ["graph", "s"]).join(target, ["graph", "o"]).select("graph", "src", "dst", F.col("p").alias("label"))


def undirected(edges: DataFrame) -> DataFrame:
    """graph, src, dst in both directions, each once."""
    pairs = edges.select("graph", "src", "dst")
    return pairs.unionByName(pairs.select("graph", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def with_self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges and one loop for every node; not a set, as for message passing."""
    return edges.select("graph", "src", "dst").unionByName(nodes.select("graph", F.col("idx").alias("src"), F.col("idx").alias("dst")))


def subset_nodes(pruned: DataFrame, embedded: DataFrame) -> DataFrame:
    """graph, label, uri, idx, vec: pruned nodes that have an embedding, numbered by label.

    Nodes meet embeddings(graph, label, idx, vec) on the normalized label; of
    several embeddings the last by idx wins, and nodes without one go.
    """
    last = embedded.groupBy("graph", normalize_label(F.col("label")).alias("label")).agg(F.max_by("vec", "idx").alias("vec"))
    kept = pruned.select("graph", "uri", normalize_label(F.col("label")).alias("label")).join(last, ["graph", "label"])
    return numbered(kept, ["label", "uri"], partition="graph")


def prune_types(triples: DataFrame, allowed: DataFrame, namespace: str) -> DataFrame:
    """s, p, o: one type triple for every allow-listed node that occurs.

    allowed: name, type. Labels are what follows the last slash, case aside.
    """
    names = allowed.select(F.lower("name").alias("label"), "name", "type")
    seen = triples.select(path_name(F.col("s")).alias("label")).unionByName(triples.select(path_name(F.col("o")).alias("label"))).select(F.lower("label").alias("label")).distinct()
    found = seen.join(names, "label")
    return found.select(_ontology(F.col("name"), namespace).alias("s"), F.lit(RDF_TYPE).alias("p"), _ontology(F.col("type"), namespace).alias("o")).distinct()


def prune_relations(triples: DataFrame, allowed: DataFrame, namespace: str) -> DataFrame:
    """s, p, o: triples with both ends allow-listed, ends renamed, predicates kept."""
    names = allowed.select(F.lower("name").alias("label"), "name")
    ends = triples.select(F.lower(path_name(F.col("s"))).alias("sl"), "p", F.lower(path_name(F.col("o"))).alias("ol"))
    s, o = names.select(F.col("label").alias("sl"), F.col("name").alias("sn")), names.select(F.col("label").alias("ol"), F.col("name").alias("on"))
    return ends.join(s, "sl").join(o, "ol").select(_ontology(F.col("sn"), namespace).alias("s"), "p", _ontology(F.col("on"), namespace).alias("o")).distinct()


def _ontology(name, namespace: str):
    return F.concat(F.lit(namespace), F.replace(name, F.lit(" "), F.lit("_")))


def prune(triples: DataFrame, allowed: DataFrame, namespace: str) -> DataFrame:
    """Both passes as one triple set."""
    return prune_types(triples, allowed, namespace).unionByName(prune_relations(triples, allowed, namespace)).distinct()


def merge_graphs(left: DataFrame, right: DataFrame, alignments: DataFrame, predicate: str = ALIGNED_WITH) -> DataFrame:
    """s, p, o of both graphs and an alignedWith triple each way for every pair (left_uri, right_uri)."""
    there = alignments.select(F.col("left_uri").alias("s"), F.lit(predicate).alias("p"), F.col("right_uri").alias("o"))
    back = alignments.select(F.col("right_uri").alias("s"), F.lit(predicate).alias("p"), F.col("left_uri").alias("o"))
    return left.select("s", "p", "o").unionByName(right.select("s", "p", "o")).unionByName(there).unionByName(back).distinct()


def relation_vocabulary(triples: DataFrame, label, defaults: list[str]) -> DataFrame:
    """label of all relations, each once; ``defaults`` if there is none."""
    found = relation_edges(triples).select(label(F.col("p")).alias("label")).where("label <> ''").distinct()
    spare = triples.sparkSession.createDataFrame([(d,) for d in defaults], "label string")
    some = found.limit(1).select(F.lit(1).alias("x"))
    return found.unionByName(spare.join(some, how="left_anti", on=F.lit(True)))


def graph_stats(triples: DataFrame) -> DataFrame:
    """graph, triples, subjects, relations."""
    return triples.groupBy("graph").agg(F.count("*").alias("triples"), F.countDistinct("s").alias("subjects"), F.countDistinct("p").alias("relations"))


def two_hop(edges: DataFrame) -> DataFrame:
    """node, other, hop: neighbours at one step, and at two but not one; edges(src, dst) count both ways."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    step = both.select(F.col("src").alias("mid"), F.col("dst").alias("other"))
    two = both.select(F.col("src").alias("node"), F.col("dst").alias("mid")).join(step, "mid").where("node <> other").select("node", "other").distinct()
    one = both.select(F.col("src").alias("node"), F.col("dst").alias("other"))
    return one.withColumn("hop", F.lit(1)).unionByName(two.join(one, ["node", "other"], "left_anti").withColumn("hop", F.lit(2)))


def first_triples(triples: DataFrame, most: int | None) -> DataFrame:
    """The first ``most`` triples in order of (s, p, o); none keeps all."""
    return triples if most is None else triples.orderBy("s", "p", "o").limit(most)


def selected_nodes(nodes: DataFrame, edges: DataFrame, item: str, prop: str, values: list[str]) -> DataFrame:
    """label of the nodes that a filter keeps visible.

    ``item`` node: nodes whose property ``prop`` is among the values. ``item`` edge:
    both ends of such edges(src, dst, ...).
    """
    if item == "node":
        return nodes.where(F.col(prop).cast("string").isin(values)).select("label").distinct()
    hit = edges.where(F.col(prop).cast("string").isin(values))
    return hit.select(F.col("src").alias("label")).unionByName(hit.select(F.col("dst").alias("label"))).distinct()


def visible_graph(triples: DataFrame, label) -> tuple[DataFrame, DataFrame]:
    """(nodes: label, title), (edges: src, dst, label) as drawn: nodes with one label merge."""
    ends = triples.select(F.col("s").alias("uri")).unionByName(triples.select(F.col("o").alias("uri"))).distinct()
    nodes = ends.groupBy(label(F.col("uri")).alias("label")).agg(F.min("uri").alias("title"))
    return nodes, triples.select(label(F.col("s")).alias("src"), label(F.col("o")).alias("dst"), label(F.col("p")).alias("label")).distinct()
