"""Guards, settings, loaders and files that no registered query shows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinweave.config import required
from twinweave.functions import text
from twinweave.functions.vectors import kernel_mean, lower_median_distance
from twinweave.operators import embed, numbering, qubo
from twinweave.plans import pipelines
from twinweave.runtime import exists, settings
from twinweave.sources import articles, bundles, graphstore, turtle


def test_required_settings():
    assert required("KEY", {"KEY": " v "}) == "v"
    for env in ({}, {"KEY": "  "}):
        with pytest.raises(RuntimeError, match="KEY"):
            required("KEY", env)


def test_settings_are_restored(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(ValueError), settings(spark, spark__sql__shuffle__partitions="3", spark__twinweave__none="x"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        raise ValueError
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.conf.get("spark.twinweave.none", None) is None


def test_build_guard(spark, tmp_path):
    ran = []
    paths = [str(tmp_path / n) for n in "ab"]
    assert pipelines.build_unless_there(spark, paths, lambda: ran.append(1))
    for p in paths:
        spark.range(1).write.parquet(p)
    assert all(exists(spark, p) for p in paths)
    assert not pipelines.build_unless_there(spark, paths, lambda: ran.append(2))
    assert pipelines.build_unless_there(spark, paths, lambda: ran.append(3), force=True)
    assert ran == [1, 3]


def test_search_falls_back_to_the_cache(spark):
    cached = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "pos long, key string")
    assert {r.key for r in articles.search_or_cached(cached.limit(0), cached, 2).collect()} == {"a", "b"}
    assert articles.search_or_cached(cached.limit(1), cached, 2).count() == 1


def test_graph_by_name(spark, tmp_path):
    nodes = spark.createDataFrame([("n1", "one", "", [1.0, 2.0])], "id string, label string, description string, position array<double>")
    edges = spark.createDataFrame([], "pos int, source string, target string, relation string")
    graphstore.save_graph(nodes, edges, str(tmp_path), "A graph!", 2)
    assert (tmp_path / "A_graph_.json").exists()
    assert graphstore.load_graph(spark, str(tmp_path), "A graph!").first().name == "A graph!"
    assert graphstore.load_graph(spark, str(tmp_path), "other") is None
    assert [r.path.rsplit("/", 1)[1] for r in graphstore.saved_graphs(spark, str(tmp_path)).collect()] == ["A_graph_.json"]


def test_bundles(spark, tmp_path):
    nodes = spark.createDataFrame([("left", 0, "u", "l", [1.0, 2.0]), ("right", 0, "v", "m", [3.0])], "graph string, idx long, uri string, label string, vec array<double>")
    bundles.save_embeddings(nodes, str(tmp_path / "e"))
    assert bundles.load_embeddings(spark, str(tmp_path / "e")).count() == 2
    assert bundles.load_embeddings(spark, str(tmp_path / "e"), "right").first().vec == [3.0]
    bundles.save_relations(spark.createDataFrame([("A b", [1.0]), ("a_b ", [2.0])], "label string, vec array<double>"), str(tmp_path / "r"))
    assert [(r.label, r.vec) for r in bundles.load_relations(spark, str(tmp_path / "r")).collect()] == [("a_b", [1.0])]


def test_turtle_by_uri(spark, tmp_path):
    (tmp_path / "g.ttl").write_text("<urn:a> <urn:b> <urn:c> .")
    spark.dataSource.register(turtle.TurtleSource)
    assert spark.read.format("turtle").load(f"file://{tmp_path}/g.ttl").first().o == "urn:c"


def test_display_and_errors(spark):
    row = spark.createDataFrame([(None, None, '{"error": "plain"}', "[1]")], "x double, a string, b string, c string").select(text.display_number(F.col("x")).alias("x"), *[text.error_details(F.col(c)).alias(c) for c in "abc"]).first()
    assert row.x == "-"
    assert (row.a.message, row.b.message, row.c.message) == (None, None, "[1]")


def test_non_edges_of_small_and_dense_graphs(spark):
    nodes = spark.createDataFrame([(g, 10 * i) for g, n in (("a", 9), ("b", 4), ("c", 1)) for i in range(n)], "graph string, idx long")
    dense = [(0, 10), (0, 20), (0, 30), (10, 20), (10, 30)]  # of b only 20 - 30 is free
    sparse = [(10 * i, 10 * i + 10) for i in range(8)]
    edges = spark.createDataFrame([("a", *e) for e in sparse] + [("b", *e) for e in dense] + [("c", 0, 0)], "graph string, src long, dst long")
    got = [tuple(r) for r in embed.negative_edges(edges, nodes, seed=3).collect()]
    assert len(got) == len(set(got))
    known = {(g, *p) for g, s in (("a", sparse), ("b", dense)) for e in s for p in (e, e[::-1])}
    assert not known & set(got)
    assert all(s != t for _, s, t in got)
    assert sum(g == "a" for g, *_ in got) == 8
    assert {x for x in got if x[0] != "a"} == {("b", 20, 30), ("b", 30, 20)}
    assert embed.negative_edges(edges.limit(0), nodes).collect() == []
    rng = np.random.default_rng(0)
    for n, e in ((9, sparse), (4, dense)):
        pairs = np.array(e) // 10
        found = embed._non_edges(n, pairs, rng)
        assert len(found) == min(len(pairs), n * n - n - 2 * len(pairs))
        assert len({*map(tuple, found.tolist())}) == len(found)
        assert not {*map(tuple, found.tolist())} & {*map(tuple, pairs.tolist()), *map(tuple, pairs[:, ::-1].tolist())}


def test_adjacency_equals_the_dense_one():
    rng = np.random.default_rng(1)
    edges = rng.integers(0, 12, (20, 2))
    a = np.eye(12)
    a[edges[:, 0], edges[:, 1]] = a[edges[:, 1], edges[:, 0]] = 1
    d = a.sum(1) ** -0.5
    x = rng.random((12, 3))
    assert np.allclose(embed.Adjacency(12, edges) @ x, (a * d[:, None] * d[None, :]) @ x)


def test_median_by_histograms(spark, monkeypatch):
    import twinweave.functions.vectors as module

    monkeypatch.setattr(module, "BINS", 100)
    monkeypatch.setattr(module, "READ", 3)
    monkeypatch.setattr(module, "BLOCK", 9)
    rng = np.random.default_rng(5)
    for points in (rng.random((17, 3)), np.repeat(rng.random((6, 2)), 3, axis=0), np.zeros((5, 2))):
        df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "idx long, vec array<double>")
        d = np.sort([np.linalg.norm(a - b) for i, a in enumerate(points) for j, b in enumerate(points) if i != j])
        assert np.isclose(lower_median_distance(df), d[(len(d) - 1) // 2], atol=1e-7)
    assert lower_median_distance(df.limit(0)) is None
    assert lower_median_distance(df.limit(1)) is None
    assert kernel_mean(df.limit(1), df.limit(1), 1.0, True).first().value == 0.0


def test_numbers_and_sums_by_range(spark):
    rows = [(g, i * 7 % 40, i) for g in ("x", "y", None) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, o long, w long").repartition(5)
    got = numbering.numbered(df, ["o"], "n", partition="g").collect()
    assert all(r.n == r.o for r in got)
    assert len(got) == 120
    summed, _ = numbering.summed_before(df.where("g = 'x'"), ["o"], F.col("w"), "before")
    want, total = {}, 0
    for _, o, w in sorted((r for r in rows if r[0] == "x"), key=lambda r: r[1]):
        want[o], total = total, total + w
    assert {r.o: r.before for r in summed.collect()} == want


def test_weights_of_variables_are_the_others(spark):
    rng = np.random.default_rng(2)
    edge = lambda n: [(int(a), int(b), f"r{int(c)}") for a, b, c in rng.integers(0, 6, (n, 3))]
    left, right = (spark.createDataFrame(edge(25), "src long, dst long, label string") for _ in "lr")
    vectors = spark.createDataFrame([(f"r{k}", rng.normal(size=3).tolist()) for k in range(5)], "label string, vec array<double>")
    variables = spark.createDataFrame([(int(i), int(a)) for i, a in {*map(tuple, rng.integers(0, 6, (14, 2)).tolist())}], "i long, a long")
    every = qubo.structural_weights(left, right, vectors)
    kept = every.join(variables, ["i", "a"], "left_semi").join(variables.toDF("j", "b"), ["j", "b"], "left_semi")
    rounded = lambda df: sorted((r.i, r.j, r.a, r.b, round(r.w, 9)) for r in df.collect())
    assert rounded(qubo.structural_weights_of(variables, left, right, vectors)) == rounded(kept)
    labelled = variables.limit(0).selectExpr("i as var", "cast(a as string) as pair")
    assert qubo.export_csv(spark.createDataFrame([], "component string, u long, v long, coeff double"), labelled, "/nowhere") == []


def test_vectors_meet_their_own_kind_once(spark, monkeypatch):
    """Two blocks of one table meet once and count twice; vectors of few components lie in wider blocks, so each is sent to fewer."""
    import twinweave.functions.vectors as module

    assert module.shares(615_000, 64) == 16 and module.shares(615_000, 512) == module.shares(615_000) == 76
    monkeypatch.setattr(module, "WIDE", 4)
    monkeypatch.setattr(module, "ROOM", 12)
    monkeypatch.setattr(module, "BLOCK", 3)
    x = np.random.default_rng(6).random((23, 3))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "idx long, vec array<double>")
    met = module.block_pairs(df, None, lambda ids, a, others, b, stands: ([len(ids) * len(others)], [stands]), "n long, stands long").collect()
    assert sum(r.n for r in met) < 23 * 23 == sum(r.n * r.stands for r in met)
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    off = ~np.eye(23, dtype=bool)
    assert np.isclose(kernel_mean(df, df, 0.7, True).first().value, np.exp(-0.7 * d2)[off].mean())
    d = np.sort(np.sqrt(d2[off]))
    assert np.isclose(lower_median_distance(df), d[(len(d) - 1) // 2])
