"""End-to-end runs on a small corpus with a rule-based client."""

import pytest
from pyspark.sql import functions as F

from twinweave.config import Settings
from twinweave.functions.text import local_name
from twinweave.operators.triples import relation_edges, visible_graph
from twinweave.plans import pipelines
from twinweave.sources.visual import graph_page


def clients():
    """Clients as closures, so that workers need not import this module."""
    import json

    def client(text):
        """Every ``a likes b`` line of the prompt is a triple."""
        found = [line.split(" likes ") for line in text.splitlines() if " likes " in line]
        return "```json\n" + json.dumps({"entities": [{"name": n, "type": "Person"} for p in found for n in p], "triples": [{"subject": a, "relation": "Likes!", "object": b} for a, b in found]}) + "\n```"

    def reconciler(text):
        names = text.split("NAMES\n", 1)[1].splitlines()
        return json.dumps({"canonical_entities": [{"canonical": n.title(), "aliases": [n]} for n in names]})

    return client, reconciler


@pytest.fixture(scope="module")
def graphs(spark):
    client, reconciler = clients()
    left = spark.createDataFrame([(1, "ann likes bob\nbob likes cyd"), (2, None), (3, "Ann likes dan")], "doc_id long, text string")
    right = spark.createDataFrame([(1, "ann likes bob\nbob likes eve")], "doc_id long, text string")
    return [pipelines.build_graph(d, n, client, "{text}", reconciler, "NAMES\n{text}") for d, n in ((left, "left"), (right, "right"))]


def test_build(graphs):
    entities, triples = graphs[0]
    assert {r.name for r in entities.collect()} == {"Ann", "Bob", "Cyd", "Dan"}
    assert {(r.s.rsplit("/")[-1], r.p.rsplit("/")[-1], r.o.rsplit("/")[-1]) for r in triples.collect()} == {("Ann", "likes", "Bob"), ("Bob", "likes", "Cyd"), ("Ann", "likes", "Dan")}


@pytest.mark.parametrize("mode", ["text", "text_and_graph"])
def test_align(spark, graphs, mode):
    triples = graphs[0][1].unionByName(graphs[1][1])
    nodes = pipelines.embed_graphs(triples, pipelines.same_label_anchors(triples), mode, Settings(hidden_dim=8, embedding_dim=8), epochs=3)
    assert len(nodes.first().vec) == (64 if mode == "text" else 72)
    side = lambda g: nodes.where(F.col("graph") == g)
    edges = pipelines.labelled_edges(relation_edges(triples), nodes)
    vectors = pipelines.relation_table(triples, ["related to"])
    for solver in ("exact", "annealer", "greedy"):
        settings = Settings(similarity_threshold=0.9 if mode == "text" else 0.3, annealer_reads=8)
        got = pipelines.align(side("left"), side("right"), *(edges.where(F.col("graph") == g) for g in ("left", "right")), vectors, settings, solver)
        names = {(r.left_entity, r.right_entity) for r in got.report.where("section = 0").collect()}
        assert names
        if mode == "text":
            assert names == {("Ann", "Ann"), ("Bob", "Bob")}
            assert {r.label for r in got.misses.collect()} == {"Cyd", "Dan", "Eve"}
    with pytest.raises(ValueError):
        pipelines.align(side("left").limit(0), side("right"), edges.limit(0), edges.limit(0), vectors)


def test_page(graphs):
    page = graph_page(*visible_graph(graphs[1][1], local_name), "right <graph>")
    assert "right &lt;graph&gt;" in page
    assert '"Ann"' in page
