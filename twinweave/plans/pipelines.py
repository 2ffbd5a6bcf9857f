"""End-to-end compositions: documents to graphs, graphs to alignments, diagnostics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.config import RAW_NAMESPACE, RDF_TYPE, Settings
from twinweave.functions.chunks import alias_lookup, chunk_text, name_batches
from twinweave.functions.text import clean_for_uri, clean_relation_label, normalize_label, prompt
from twinweave.functions.vectors import similarity_pairs
from twinweave.operators import extract, qubo, report, solve
from twinweave.operators import triples as graph
from twinweave.operators.annealing import anneal_blocks, rectangles
from twinweave.operators.embed import encode, relation_vectors, train_embeddings
from twinweave.operators.numbering import numbered
from twinweave.runtime import exists, materialise


#: Variables that one task per coupled part may hold.
ANNEALED_TOGETHER = 20_000


def source_id(corpus: str, place: Column) -> Column:
    return F.concat(F.lit(f"{corpus}_"), place.cast("string"))


def build_unless_there(spark: SparkSession, paths: list[str], build: Callable[[], None], force: bool = False) -> bool:
    """Runs ``build`` unless all of its results are there already, or if forced; whether it ran."""
    if not force and all(exists(spark, p) for p in paths):
        return False
    build()
    return True


def extract_corpus(docs: DataFrame, corpus: str, client: Callable[[str], str], template: str, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(entities, triples) of docs(doc_id, text) by a model client, chunk by chunk.

    Chunks whose answer isn't valid JSON are skipped; caps hold per chunk. A source is
    named by its document's place in order of doc_id, from 0, blank ones counted.
    """
    pieces = chunk_text(docs.where("text is not null"), settings.chunk_chars)
    total = pieces.groupBy("doc_id").agg(F.max("pos").alias("total"))
    place = numbered(docs.select("doc_id").distinct(), ["doc_id"], "place")
    source = source_id(corpus, F.col("place"))
    asked = pieces.join(total, "doc_id").join(place, "doc_id").select(F.struct("doc_id", "pos").alias("chunk_id"), prompt(template, F.col("chunk"), source, F.col("pos"), F.col("total")).alias("prompt"))
    answers = materialise(extract.ask(asked, client), "answers")
    entities = extract.parse_entities(answers, "chunk_id", cap=settings.entities_per_chunk)
    return entities.withColumn("pos", F.struct("chunk_id", "pos")), extract.parse_triples(answers, "chunk_id", cap=settings.triples_per_chunk)


def reconcile(entities: DataFrame, client: Callable[[str], str], template: str, settings: Settings = Settings()) -> DataFrame:
    """key, canonical from a model client, asked with batches of sorted names."""
    names = extract.entity_dedup(entities.select("name", "pos")).select("name")
    batches = name_batches(names, settings.names_per_batch).groupBy("batch").agg(F.array_join(F.sort_array(F.collect_list("name")), "\n").alias("names"))
    asked = batches.select("batch", F.replace(F.lit(template), F.lit("{text}"), F.col("names")).alias("prompt"))
    return alias_lookup(extract.parse_reconciliation(extract.ask(asked, client), "batch"))


def raw_graph(triples: DataFrame, name: str, namespace: str = RAW_NAMESPACE) -> DataFrame:
    """graph, s, p, o, o_is_uri of extracted triples; ends that leave no URI go."""
    s, o = clean_for_uri(F.col("subject")), clean_for_uri(F.col("object"))
    kept = triples.where((s != "") & (o != ""))
    uri = lambda c: F.concat(F.lit(namespace), c)
    return kept.select(F.lit(name).alias("graph"), uri(s).alias("s"), uri(clean_relation_label(F.col("relation"))).alias("p"), uri(o).alias("o"), F.lit(True).alias("o_is_uri")).distinct()


def build_graph(docs: DataFrame, name: str, client, template: str, reconcile_client, reconcile_template: str, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(entities, triples) of one corpus, names reconciled and canonical."""
    entities, triples = extract_corpus(docs, name, client, template, settings)
    lookup = materialise(reconcile(entities, reconcile_client, reconcile_template, settings), "lookup")
    named = entities.withColumn("key", F.lower("name")).join(lookup, "key", "left").withColumn("name", F.coalesce("canonical", "name"))
    return extract.entity_merge(named), raw_graph(extract.canonicalize(extract.sanitize_triples(triples), lookup), name)


@dataclass
class Alignment:
    """Tables of one alignment run."""

    similarity: DataFrame
    variables: DataFrame
    components: DataFrame
    pairs: DataFrame
    report: DataFrame
    best: DataFrame
    misses: DataFrame
    unmatched: DataFrame


def align(left: DataFrame, right: DataFrame, left_edges: DataFrame, right_edges: DataFrame, vectors: DataFrame, settings: Settings = Settings(), solver: str = "annealer", fallback: bool = False, seed: int = 0) -> Alignment:
    """Aligns nodes(idx, label, uri, vec) of two graphs with labelled edges(src, dst, label).

    ``solver`` is annealer, exact or greedy; over ANNEALED_TOGETHER variables are annealed
    by blocks, from the greedy matching on. An empty problem is an error for the
    QUBO solvers, as there is nothing to optimise.
    """
    sim = materialise(similarity_pairs(left.select("idx", "vec"), right.select("idx", "vec")), "similarity")
    variables = materialise(qubo.variable_index(qubo.candidate_pairs(sim, settings.similarity_threshold)), "variables")
    if settings.max_structural_pairs is None:
        weights = qubo.structural_weights_of(variables, left_edges, right_edges, vectors)
    else:  # the cap counts all pairs of edges, in order
        weights = qubo.structural_cap(qubo.structural_weights(left_edges, right_edges, vectors), settings.max_structural_pairs)
    terms = materialise(qubo.components(variables, weights, settings.node_weight, settings.structure_weight, settings.left_penalty, settings.right_penalty), "terms")
    if solver == "greedy":
        pairs = solve.match(sim, settings.similarity_threshold, fallback)
    else:
        if variables.isEmpty():
            raise ValueError("no candidate pair reaches the threshold")
        total = qubo.total(terms)
        if solver != "exact" and variables.count() > ANNEALED_TOGETHER:
            start = variables.join(solve.match(sim, settings.similarity_threshold).select("i", "a"), ["i", "a"], "left_semi").select("var")
            chosen = anneal_blocks(total, seed=seed, start=start, place=rectangles(variables))[1]
        else:
            found = solve.exact(total) if solver == "exact" else solve.best_read(solve.anneal(total, settings.annealer_reads, seed=seed))
            chosen = found.select(F.explode("vars").alias("var"))
        pairs = variables.join(chosen, "var", "left_semi").select("i", "a", "sim")
    pairs = materialise(pairs, "pairs")
    best = report.best_similarity(sim, left, right)
    matched = pairs.join(left.select(F.col("idx").alias("i"), F.col("label").alias("l")), "i").join(right.select(F.col("idx").alias("a"), F.col("label").alias("r")), "a")
    labels = matched.select(F.lit("left").alias("graph"), F.col("l").alias("label")).unionByName(matched.select(F.lit("right").alias("graph"), F.col("r").alias("label")))
    return Alignment(sim, variables, terms, pairs, report.alignment_report(pairs, left, right), best, report.threshold_misses(best, settings.similarity_threshold, solver), report.unmatched_nodes(best, labels, settings.similarity_threshold, solver))


def embed_graphs(triples: DataFrame, anchors: DataFrame, mode: str = "text_and_graph", settings: Settings = Settings(), encoder=None, seed: int = 0, epochs: int | None = None) -> DataFrame:
    """graph, idx, uri, label, vec of triples(graph, s, p, o, o_is_uri) of graphs left and right.

    Text features come from the encoder, graph features from joint training on them;
    the hybrid mode joins both. anchors(left, right) are label pairs.
    """
    from twinweave.config import EMBEDDING_MODES
    from twinweave.functions.text import local_name
    from twinweave.operators.embed import anchor_pairs, hashed_ngrams

    use_text, use_graph = EMBEDDING_MODES[mode]
    nodes = materialise(encode(graph.node_index(triples).withColumn("label", local_name(F.col("uri"))), encoder or hashed_ngrams), "nodes")
    if not use_graph:
        return nodes
    edges = graph.resolve_edges(graph.relation_edges(triples), nodes)
    side = lambda g: nodes.where(F.col("graph") == g)
    trained = train_embeddings(nodes.select("graph", "idx", "vec"), edges, anchor_pairs(side("left"), side("right"), anchors), settings, seed, epochs)
    both = nodes.join(trained.withColumnRenamed("vec", "z"), ["graph", "idx"])
    return both.select("graph", "idx", "uri", "label", (F.concat("vec", "z") if use_text else F.col("z")).alias("vec"))


def relation_table(triples: DataFrame, defaults: list[str], encoder=None) -> DataFrame:
    """label, vec for every relation label of the graphs."""
    from twinweave.functions.text import local_name
    from twinweave.operators.embed import hashed_ngrams

    return relation_vectors(graph.relation_vocabulary(triples, local_name, defaults), encoder or hashed_ngrams)


def labelled_edges(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph, src, dst, label with relation keys as labels."""
    from twinweave.functions.text import local_name, relation_key

    return graph.resolve_edges(triples.where(F.col("p") != RDF_TYPE), nodes).withColumn("label", relation_key(local_name(F.col("label"))))


def same_label_anchors(triples: DataFrame) -> DataFrame:
    """left, right: labels that both graphs have, the default anchors."""
    from twinweave.functions.text import local_name

    n = graph.graph_nodes(triples).select("graph", normalize_label(local_name(F.col("uri"))).alias("label")).distinct()
    both = n.groupBy("label").agg(F.countDistinct("graph").alias("n")).where("n > 1")
    return both.select(F.col("label").alias("left"), F.col("label").alias("right"))
