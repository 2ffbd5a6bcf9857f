"""Articles, Turtle, graph and session JSON, chunks, model answers, rules, learning."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinweave.config import RDF_TYPE, Settings
from twinweave.functions.chunks import chunks_of, name_batches
from twinweave.functions.vectors import mmd, moment_alignment, similarity_pairs
from twinweave.operators import embed, extract
from twinweave.sources import articles, graphstore, turtle


def test_articles(spark, tmp_path):
    (tmp_path / "01_a.txt").write_text("Source: s\nTitle: Alpha \nURL: u\n---\n body --- more\n---\n")
    (tmp_path / "02_b.txt").write_text("Title: Beta\nno separator")
    (tmp_path / "03_c.txt").write_text("nothing\n---\nx")
    got = {r.key: r.body for r in articles.scan_articles(spark, str(tmp_path)).collect()}
    assert got == {"Alpha": "body --- more\n---", "Beta": "Title: Beta\nno separator"}
    names = spark.createDataFrame([("09_x.txt",), ("b_1.txt",), ("12_y",)], "name string")
    assert articles.next_index(names).first().next_index == 13
    assert articles.next_index(names.limit(0)).first().next_index == 1
    docs = spark.createDataFrame([(3, "A key", "A key", "u", "text")], "n int, key string, title string, url string, body string")
    row = articles.article_text(docs, "Wiki").first()
    assert row.name == "03_A_key.txt"
    assert row.content == "Source: Wiki\nTitle: A key\nURL: u\nQuery: fetch mode\n---\ntext"


TURTLE = """@prefix o: <urn:o#> . @base <http://b/> .
# a comment
o:x a o:T ; o:p o:y , <rel> ; o:q "a \\"quoted\\" line\\n" .
<urn:o#it's> o:p o:x.
o:x a o:T .
"""


def test_turtle(spark, tmp_path):
    want = {("urn:o#x", RDF_TYPE, "urn:o#T", True), ("urn:o#x", "urn:o#p", "urn:o#y", True), ("urn:o#x", "urn:o#p", "http://b/rel", True), ("urn:o#x", "urn:o#q", 'a "quoted" line\n', False), ("urn:o#it's", "urn:o#p", "urn:o#x", True)}
    assert turtle.parse(TURTLE) == want
    (tmp_path / "g.ttl").write_text(TURTLE)
    scanned = turtle.scan_turtle(spark, str(tmp_path / "g.ttl"), "g")
    assert {tuple(r)[1:] for r in scanned.collect()} == want
    spark.dataSource.register(turtle.TurtleSource)
    assert {tuple(r)[1:] for r in spark.read.format("turtle").load(str(tmp_path / "g.ttl")).collect()} == want
    turtle.write_turtle(scanned, str(tmp_path / "out"))
    assert {tuple(r)[1:] for r in turtle.scan_turtle(spark, str(tmp_path / "out")).collect()} == want
    with pytest.raises(ValueError):
        turtle.parse("<a> <b> ]")


def test_graphs_and_sessions(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"name": "g", "nodes": [{"id": "n1", "position": [1, 2]}, {"id": "n2", "label": "two"}], "edges": [{"source": "n1", "target": "n2"}]}))
    g = graphstore.scan_graphs(spark, str(tmp_path / "g.json"))
    assert g.first().next_id == 3
    nodes, edges = graphstore.graph_tables(g)
    assert {(r.id, r.label, r.description, tuple(r.position)) for r in nodes.collect()} == {("n1", "n1", "", (1.0, 2.0)), ("n2", "two", "", (50.0, 50.0))}
    assert edges.first().relation == "related_to"
    again = json.loads(graphstore.graph_json(nodes, edges, "g", 3).first().value)
    assert [n["id"] for n in again["nodes"]] == ["n1", "n2"]
    bare = nodes.drop("name")
    assert {r.label for r in graphstore.add_node(bare, 3, " ").collect()} == {"n1", "two", "Node n3"}
    edits = spark.createDataFrame([("n1", " ", " d ")], "id string, label string, description string")
    assert graphstore.update_nodes(bare, edits).where("id = 'n1'").first().description == "d"
    left, cut = graphstore.remove_nodes(bare, edges, spark.createDataFrame([("n2",)], "id string"))
    assert (left.count(), cut.count()) == (1, 0)
    assert graphstore.saved_graphs(spark, str(tmp_path)).count() == 1
    (tmp_path / "s").mkdir()
    (tmp_path / "s/s.json").write_text(json.dumps({"wiki_order": ["n1"], "arxiv_order": ["m1", "m2"], "similarity": [[0.5, 0.25]], "structural_info": {"wiki_edges": [[0, 0, "r"]], "arxiv_edges": [], "weights": [{"wiki_i": 0, "wiki_j": 0, "arxiv_a": 0, "arxiv_b": 1, "weight": 0.5}, {"wiki_i": 0, "wiki_j": 0, "arxiv_a": 0, "arxiv_b": 1, "weight": 0.75}, {"wiki_i": "x"}]}}))
    session = graphstore.scan_session(spark, str(tmp_path / "s/s.json"))
    assert session.first().qubo_weights is None
    assert {tuple(r) for r in graphstore.session_cells(session).collect()} == {(0, 0, 0.5), (0, 1, 0.25)}
    assert [tuple(r) for r in graphstore.session_weights(session).collect()] == [(0, 0, 0, 1, 0.75)]
    stored = json.loads(graphstore.session_json(graphstore.session_cells(session), graphstore.session_weights(session), ["n1"], ["m1", "m2"]).first().value)
    assert stored["similarity"] == [[0.5, 0.25]]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab \n", max_size=900))
def test_chunks_lose_only_white_space(text):
    pieces = chunks_of(text, 200)
    assert all(p.strip() == p and 0 < len(p) <= 200 for p in pieces)
    assert "".join("".join(pieces).split()) == "".join(text.split())


def test_name_batches(spark):
    names = spark.createDataFrame([(f"n{i:03}",) for i in range(25)], "name string")
    assert [r["count"] for r in name_batches(names, 10).groupBy("batch").count().orderBy("batch").collect()] == [10, 10, 5]
    assert name_batches(names, 0).agg(F.max("batch")).first()[0] == 0


def test_answers(spark):
    rows = [(1, '{"entities": [{"name": " A "}, {"name": null}], "triples": []}'), (2, 'x ```json\n{"entities": [], "triples": [{"subject": "a", "relation": null, "object": "b", "confidence": "z"}]}\n```'), (3, "broken {"), (4, None), (5, '{"other": 1}')]
    answers = spark.createDataFrame(rows, "id long, answer string")
    assert [(r.id, r.name, r.type) for r in extract.parse_entities(answers, "id").collect()] == [(1, "A", "Other")]
    assert [(r.id, r.subject, r.relation, r.confidence) for r in extract.parse_triples(answers, "id").collect()] == [(2, "a", "related_to", None)]
    capped = spark.createDataFrame([(1, json.dumps({"entities": [{"name": f"e{i}"} for i in range(40)]}))], "id long, answer string")
    assert extract.parse_entities(capped, "id").count() == 25
    merged = extract.parse_reconciliation(spark.createDataFrame([(1, '{"canonical_entities": [{"canonical": "Q", "aliases": ["q1", "Q 2"]}]}')], "id long, answer string"), "id")
    assert merged.first().aliases == ["q1", "Q 2"]

    calls = spark.createDataFrame([(1, "p")], "id long, prompt string")

    def client(text):
        if "only valid JSON" not in text:
            raise ValueError("malformed")
        return "{}"

    assert extract.ask(calls, client).first().answer == "{}"


def test_dependency_rules(spark):
    t = lambda doc, i, head, pos, dep, lemma: (doc, i, head, pos, dep, lemma, lemma)
    tokens = [
        t(1, 0, 1, "PROPN", "nsubj", "Shor"), t(1, 1, 1, "VERB", "ROOT", "propose"), t(1, 2, 1, "NOUN", "dobj", "algorithm"), t(1, 3, 1, "ADP", "prep", "in"), t(1, 4, 3, "NOUN", "pobj", "paper"),
        t(2, 0, 1, "NOUN", "nsubj", "qubit"), t(2, 1, 1, "AUX", "ROOT", "be"), t(2, 2, 1, "NOUN", "attr", "unit"),
        t(3, 0, 3, "NOUN", "nsubj", "Grover"), t(3, 1, 3, "AUX", "cop", "be"), t(3, 2, 3, "NOUN", "compound", "search"), t(3, 3, 3, "NOUN", "ROOT", "method"),
        t(4, 0, 0, "PROPN", "ROOT", "Bob"), t(4, 1, 0, "NOUN", "appos", "chemist"),
        t(5, 0, 1, "NOUN", "nsubj", "gate"), t(5, 1, 1, "VERB", "ROOT", "set"), t(5, 2, 1, "ADP", "prt", "up"), t(5, 3, 1, "NOUN", "dobj", "state"),
    ]
    ents = [(1, 0, 0, 1, "Shor"), (1, 1, 2, 3, "algorithm"), (1, 2, 4, 5, "paper"), (2, 0, 0, 1, "qubit"), (2, 1, 2, 3, "unit"), (3, 0, 0, 1, "Grover"), (3, 1, 2, 3, "search"), (4, 0, 0, 1, "Bob"), (4, 1, 1, 2, "chemist"), (5, 0, 0, 1, "gate"), (5, 1, 3, 4, "state")]
    found = extract.dependency_triples(spark.createDataFrame(tokens, "doc long, i int, head int, pos string, dep string, lemma string, text string"), spark.createDataFrame(ents, "doc long, ent_id int, start int, end int, text string"))
    assert {tuple(r)[1:] for r in found.collect()} == {("Shor", "propose_in_paper", "algorithm"), ("Shor", "propose_in_paper", "paper"), ("qubit", "is_a", "unit"), ("Grover", "is_a", "search"), ("Bob", "is_a", "chemist"), ("gate", "set_up", "state")}


def test_entities(spark):
    rows = [("Qubit", "Concept", "", 2), ("qubit", "Other", "two", 5), ("QUBIT", "Metric", "three", 7), ("Ion", "Hardware", "", 1)]
    got = {r.key: tuple(r)[1:] for r in extract.entity_merge(spark.createDataFrame(rows, "name string, type string, description string, pos int")).collect()}
    assert got == {"qubit": ("QUBIT", "Concept", "two", 2), "ion": ("Ion", "Hardware", "", 1)}


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(6, 3)), rng.normal(size=(5, 3))
    loss, gx, gy = embed.moments(x, y)
    step = np.zeros_like(x)
    step[2, 1] = 1e-6
    assert (embed.moments(x + step, y)[0] - loss) / 1e-6 == pytest.approx(gx[2, 1], abs=1e-4)
    e, n = np.array([[0, 1], [2, 3]]), np.array([[0, 4], [1, 5]])
    loss, g = embed.reconstruction(x, e, n)
    assert (embed.reconstruction(x + step, e, n)[0] - loss) / 1e-6 == pytest.approx(g[2, 1], abs=1e-4)


def test_training_lowers_the_loss(spark):
    rng = np.random.default_rng(1)
    sides = [(rng.normal(size=(12, 8)), np.array([(i, (i + 1) % 12) for i in range(12)])) for _ in range(2)]
    short = Settings(hidden_dim=16, embedding_dim=8, dropout=0.0, learning_rate=0.01)
    vectors, losses = embed.train_joint(sides, np.array([[0, 0], [3, 3]]), short, epochs=60)
    assert losses[-1] < losses[0]
    assert [v.shape for v in vectors] == [(12, 8), (12, 8)]
    nodes = spark.createDataFrame([(g, i, list(map(float, x[i]))) for g, (x, _) in zip(("left", "right"), sides, strict=True) for i in range(12)], "graph string, idx long, vec array<double>")
    edges = spark.createDataFrame([("left", 0, 1), ("right", 0, 1)], "graph string, src long, dst long")
    anchors = spark.createDataFrame([(0, 0)], "i long, a long")
    assert embed.train_embeddings(nodes, edges, anchors, short, epochs=3).count() == 24
    same = embed.train_embeddings(nodes, edges.where("graph = 'left'"), anchors, short, epochs=3)
    assert np.allclose(sorted(map(tuple, (r.vec for r in same.collect()))), sorted(map(tuple, (r.vec for r in nodes.collect()))))


def test_vectors(spark):
    x = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [0.6, 0.8])], "idx long, vec array<double>")
    got = {(r.i, r.a): r.sim for r in similarity_pairs(x, x).collect()}
    assert len(got) == 9
    assert got[0, 2] == pytest.approx(0.6)
    assert got[1, 2] == 0  # a zero vector stays zero
    assert {(r.i, r.a) for r in similarity_pairs(x, x, 0.9).collect()} == {(0, 0), (2, 2)}
    assert similarity_pairs(x, x.limit(0)).count() == 0
    assert mmd(x, x.limit(0)).first().mmd == 0
    assert moment_alignment(x, x).first().loss == 0


def test_encoder_is_deterministic(spark):
    labels = spark.createDataFrame([("Runs On",), ("runs on",), ("is a",)], "label string")
    got = {r.label: r.vec for r in embed.relation_vectors(labels).collect()}
    assert set(got) == {"runs_on", "is_a"}
    assert np.linalg.norm(got["is_a"]) == pytest.approx(1.0)


def test_article_files_are_written_side_by_side(spark, tmp_path, monkeypatch):
    """Several writers, more articles than they get at once, and a name that comes twice."""
    monkeypatch.setattr(articles, "WRITERS", 3)
    monkeypatch.setattr(articles, "FILES", 4)
    rows = [(k, f"key {k}", f"text ü {k}") for k in range(30)] + [(29, "key 29", "the last")]
    docs = spark.createDataFrame(rows, "n int, key string, body string").selectExpr("n", "key", "'u' as url", "body").coalesce(1)
    assert articles.write_article_files(docs, str(tmp_path / "a"), "S") == 31
    got = {r.key: r.body for r in articles.scan_articles(spark, str(tmp_path / "a")).collect()}
    assert got == {k: b for _, k, b in rows}


def test_a_large_session_lies_in_lines_and_only_cells_are_shuffled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graphstore, "CELLS", 20)
    cells = spark.createDataFrame([(0, 0, 0.5), (3, 6, 0.1 + 0.2), (3, 6, -1.0), (9, 2, 1e-9), (10, 0, 9.0), (0, 7, 9.0)], "i long, a long, sim double")  # the last two lie outside
    weights = spark.createDataFrame([(1, 2, 3, 4, 0.25), (1, 2, 3, 4, 0.5)], "i int, j int, a int, b int, w double")
    graphstore.save_session(cells, 10, 7, weights, ["l"], ["r"], str(tmp_path / "s"))
    assert len(list((tmp_path / "s" / "similarity").glob("part-*"))) > 1
    session, found = graphstore.load_session(spark, str(tmp_path / "s"))
    got = [(r.i, r.a, r.sim) for r in found.collect()]
    assert len(got) == 70
    assert {(i, a): x for i, a, x in got if x} == {(0, 0): 0.5, (3, 6): 0.1 + 0.2, (9, 2): 1e-9}
    assert session.first().wiki_order == ["l"]
    assert [tuple(r) for r in graphstore.session_weights(session).collect()] == [(1, 2, 3, 4, 0.5)]
    empty = graphstore.session_lines(cells, 0, 7)
    assert empty.count() == 0


def test_article_files_are_written_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """The driver writes no file where tasks can, and both ways give the same files; paths and bytes are those of Spark's reader."""
    rows = [(k, f"key {k}", f"text ü {k}\n") for k in range(30)] + [(29, "key 29", "the last")]
    docs = spark.createDataFrame(rows, "n int, key string, body string").selectExpr("n", "key", "'u' as url", "body").coalesce(1)
    monkeypatch.setattr(articles, "_write_from_driver", None)
    assert articles.write_article_files(docs, str(tmp_path / "a"), "S") == 31
    monkeypatch.undo()
    assert articles.write_article_files(docs.limit(0), str(tmp_path / "none"), "S") == 0
    (tmp_path / "a" / ".hidden.txt").write_text("Title: hidden")
    (tmp_path / "a" / "other.csv").write_text("Title: other")
    (tmp_path / "a" / "a b%.txt").write_bytes(b"Title: raw\n---\n\xff")
    by_tasks = {tuple(r) for r in articles.scan_articles(spark, str(tmp_path / "a")).selectExpr("path", "key", "hex(body)").collect()}
    monkeypatch.setattr(articles, "_reachable", lambda *_: None)
    assert by_tasks == {tuple(r) for r in articles.scan_articles(spark, str(tmp_path / "a")).selectExpr("path", "key", "hex(body)").collect()}
    assert len(by_tasks) == 31
    assert articles.write_article_files(docs, str(tmp_path / "b"), "S") == 31
    for at in (tmp_path / "b").glob("*.txt"):
        assert at.read_bytes() == (tmp_path / "a" / at.name).read_bytes()
    assert len(list((tmp_path / "b").glob("*.txt"))) == 30
