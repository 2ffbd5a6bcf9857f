"""Objectives, weights and grids that aren't made pair by pair, against their plain forms."""

import numpy as np
import pytest

from twinweave.functions import vectors
from twinweave.operators import coloured, qubo, report, similarity, solve
from twinweave.sources import graphstore


@pytest.fixture(scope="module")
def problem(spark):
    """Variables, edges of two graphs with loops, parallel edges and hubs, label vectors."""
    rng = np.random.default_rng(5)
    pairs = sorted({(int(i), int(a)) for i, a in zip(rng.integers(0, 9, 40), rng.integers(0, 9, 40), strict=True)})
    variables = spark.createDataFrame([(i, a, float(rng.integers(1, 9)) / 8, k) for k, (i, a) in enumerate(pairs)], "i long, a long, sim double, var long")
    edges = lambda: spark.createDataFrame([(int(x), int(y), f"l{z}") for x, y, z in rng.integers(0, [9, 9, 4], (40, 3))] + [(2, 2, "l0"), (2, 3, "l1"), (2, 3, "l2"), (4, 5, None)] + [(0, k, "l1") for k in range(9)], "src long, dst long, label string")
    names = spark.createDataFrame([(f"l{k}", [float(v) for v in rng.integers(-3, 4, 3)]) for k in range(3)] + [("l3", None)], "label string, vec array<double>")
    return variables, edges(), edges(), names


def told(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def brute_weights(left, right, names):
    vec = {r.label: np.array(r.vec) for r in names.collect() if r.vec is not None and np.any(r.vec)}
    found = {}
    for x in left.collect():
        for y in right.collect():
            if x.label in vec and y.label in vec:
                p, q = vec[x.label], vec[y.label]
                own = ((x.label, y.label), float(p @ q / (np.linalg.norm(p) * np.linalg.norm(q))))
                key = (x.src, x.dst, y.src, y.dst)
                found[key] = max(found.get(key, own), own)
    return {k: round(w, 9) for k, (_, w) in found.items()}


def test_weights(spark, problem):
    variables, left, right, names = problem
    brute = brute_weights(left, right, names)
    assert {r[:4]: r[4] for r in told(qubo.structural_weights(left, right, names))} == brute
    ends = {(r.i, r.a) for r in variables.collect()}
    inside = {k: w for k, w in brute.items() if (k[0], k[2]) in ends and (k[1], k[3]) in ends}
    assert {r[:4]: r[4] for r in told(qubo.structural_weights_of(variables, left, right, names))} == inside
    for most in (1, 37, 10_000):
        assert {r[:4]: r[4] for r in told(qubo.first_weights(left, right, names, most))} == {k: brute[k] for k in sorted(brute)[:most]}


def test_objective_and_energy(spark, problem):
    variables, left, right, names = problem
    weights = qubo.structural_weights_of(variables, left, right, names)
    given = (0.5, 2.0, 3.0, 5.0)
    total = qubo.total(qubo.components(variables, weights, *given))
    assert told(qubo.objective(variables, weights, *given).select("u", "v", "coeff")) == told(total)
    held = {r.var: (r.i, r.a) for r in variables.collect()}
    penalty = {(u, v): 3.0 * (x[0] == y[0]) + 5.0 * (x[1] == y[1]) for u, x in held.items() for v, y in held.items() if u < v and (x[0] == y[0] or x[1] == y[1])}
    assert {(r.u, r.v): r.coeff for r in qubo.components(variables, weights, *given).where("component = 'penalty'").collect()} == penalty
    labelled = variables.selectExpr("var", "concat('p', var) as pair")
    assert told(qubo.objective(variables, weights, *given, labelled=labelled).select("row", "col", "coeff")) == told(qubo.matrix_cells(total, labelled))
    sample = variables.where("var % 3 <> 0").select("var")
    ask = dict(zip(("node_weight", "structure_weight", "left_penalty", "right_penalty"), given, strict=True))
    assert told(qubo.energy_of(sample, variables, weights, **ask)) == told(qubo.energy(total, sample))


def test_greedy_rounds(spark, monkeypatch):
    """Rounds of best pairs take what one task in order takes, ties included."""
    rng = np.random.default_rng(7)
    rows = [(i, a, float(rng.integers(0, 5)) / 4 - 0.5) for i in range(20) for a in range(15) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "i long, a long, sim double")
    together = told(solve.greedy(df))
    monkeypatch.setattr(solve, "FINISH", 10)
    assert told(solve.greedy(df)) == together


def test_a_vector_is_sent_once_per_group(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 8)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, vec array<double>")
    plan = similarity.Plan(df, df, 0.6, 6, block=8)
    assert plan.blocks.select("side", "block").distinct().count() > 100
    assert plan.met.count() <= 3 * 3
    monkeypatch.setattr(vectors, "BLOCK", 100)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    brute = {(int(i), int(a)) for i, a in zip(*np.nonzero(np.round(unit @ unit.T, 6) >= 0.6), strict=True)}
    assert {(r.i, r.a) for r in plan.rows().collect()} == {(r.i, r.a) for r in vectors.similarity_pairs(df, df, 0.6, 6).collect()} == brute
    assert vectors.shares(250) == 1 and vectors.shares(307_000) == 38
    plan.drop()


def test_numbers_as_bytes():
    for m in (np.array([[0.1, np.nan], [np.inf, -0.0]]), np.float32([[0.1, 2]]).astype(float), np.array([[1e300, 1.0]])):
        assert np.array_equal(vectors.unblob(vectors.blob(m), len(m)).reshape(m.shape), m, equal_nan=True)
    assert vectors.blob(np.float32([[0.1, 2]]).astype(float))[:1] == b"4"


def test_annealing_without_pairs_of_penalties(spark, problem):
    """Energies are those of the objective, the best read is the pairwise annealer's, and a full grid of variables stays small."""
    variables, left, right, names = problem
    weights = qubo.structural_weights_of(variables, left, right, names)
    total = qubo.objective(variables, weights).toPandas()
    got = coloured.anneal_alignment(variables, weights, 12, 200, 3).collect()
    assert got == coloured.anneal_alignment(variables, weights, 12, 200, 3).collect()
    assert [r.read for r in sorted(got)] == list(range(12))
    for r in got:
        assert r.energy == pytest.approx(total[total.u.isin(r.vars) & total.v.isin(r.vars)].coeff.sum())
    best = solve.best_read(solve.anneal(qubo.objective(variables, weights), 24, 300, 3)).first().energy
    assert min(r.energy for r in got) == pytest.approx(best)


def test_reads_dealt_out_over_a_full_grid(spark, monkeypatch):
    monkeypatch.setattr(coloured, "STATES", 40_000)  # 4 shares
    rng = np.random.default_rng(7)
    sim = rng.random((90, 90))
    variables = spark.createDataFrame([(i, a, float(sim[i, a]), 90 * i + a) for i in range(90) for a in range(90)], "i long, a long, sim double, var long")  # 720,900 pairs of penalties
    none = spark.createDataFrame([], "i long, j long, a long, b long, w double")
    got = coloured.anneal_alignment(variables, none, 20, 60, 1).collect()
    for r in got:
        rows, columns = np.divmod(np.array(r.vars), 90)
        assert len(set(rows)) == len(set(columns)) == len(r.vars)  # a penalty costs more than a pair can gain
        assert r.energy == pytest.approx(-sim[rows, columns].sum())
    assert min(r.energy for r in got) < -0.7 * 90
    assert len({tuple(r.vars) for r in got}) > 4  # shares don't repeat each other


@pytest.mark.parametrize("fallback", [False, True])
def test_greedy_in_stages(spark, monkeypatch, fallback):
    """Stages of any size take what the whole grid gives, ties included, and hold no pair table of the grid."""
    rng = np.random.default_rng(11)
    side = lambda n, at: spark.createDataFrame([(int(at + 2 * k), [float(v) for v in rng.integers(-2, 3, 5)]) for k in range(n)] + [(int(at + 2 * n), None)], "idx long, vec array<double>")
    left, right = side(60, 0), side(45, 1)
    grid = vectors.similarity_pairs(left.where("vec is not null"), right.where("vec is not null"), None, 6)
    want, sizes, pairs = told(solve.match(grid, 0.4, fallback)), [], solve.greedy
    monkeypatch.setattr(solve, "greedy", lambda df: (sizes.append(df.count()), pairs(df))[1])
    for at_once, each in ((1 << 30, 8), (50, 1)):
        monkeypatch.setattr(solve, "AT_ONCE", at_once)
        monkeypatch.setattr(solve, "PAIRS", each)
        assert told(solve.match_vectors(left, right, 0.4, 6, fallback)) == want
    assert len(sizes) > 2 and max(sizes[2 if fallback else 1 :]) < 60 * 45 / 4


def test_best_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "WIDE", 16)
    rng = np.random.default_rng(12)
    side = lambda n: spark.createDataFrame([(k, f"n{k}", [float(v) for v in rng.integers(-2, 3, 4)]) for k in range(n)], "idx long, label string, vec array<double>")
    left, right = side(50), side(37)
    assert told(report.best_similarity_of(left, right, 6)) == told(report.best_similarity(vectors.similarity_pairs(left, right, None, 6), left, right))
    none = right.limit(0)
    assert {r.best for r in report.best_similarity_of(left, none).collect()} == {0.0}


def test_rehydrated_without_a_join_of_the_grid(spark, monkeypatch):
    monkeypatch.setattr(graphstore, "ROWS", 4)
    monkeypatch.setattr(graphstore, "COLUMNS", 5)
    left, right = (spark.createDataFrame([(k,) for k in ids], "idx long") for ids in ([*range(0, 20, 2), 4], range(1, 30, 2)))  # id 4 twice
    cells = spark.createDataFrame([(0, 1, 0.5), (4, 7, 0.25), (18, 29, 0.75), (99, 1, 1.0)], "i long, a long, sim double")
    grid = left.withColumnRenamed("idx", "i").crossJoin(right.withColumnRenamed("idx", "a"))
    assert told(graphstore.rehydrated(left, right, cells)) == told(graphstore.rehydrate_similarity(grid, cells))
    assert graphstore.rehydrated(left.limit(0), right, cells).count() == 0
