import math
import os
import random

import numpy as np
import pyarrow.parquet as pq

from twinweave.llm import topk
from twinweave.llm.topk import DEPTHS, HEAD, best_of, exact_top_k, no_random_access


def brute(rows, k=10, every=100):
    good = [(i, [math.floor(x * 1024) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in {(i, tuple(v)) for i, v in good if i % every == 0}:
        scores = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in good if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 3, "q") for i, v in rows], "vec_id long, embedding array<double>, rank int, query_id string")


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(12)]) for i in range(700)]
    rows += [(i, [0.25] * 12) for i in range(1000, 1120)]  # ties
    rows += [(2000, None), (2100, [0.1] * 11 + [None]), (2200, [float("nan")] + [0.1] * 11), (2300, [float("inf")] * 12), (None, [0.1] * 12), (2400, [0.0] * 12), (2500, [1e6, -1e6] * 6), (1019, [0.25] * 12)]
    assert sorted(map(tuple, exact_top_k(frame(spark, rows).repartition(6)).collect())) == brute(rows)


def test_large_components_that_cancel(spark):
    """Products near 1e18 whose sum is small: bounds must go with the products, not the score."""
    rng = random.Random(5)
    for seed in range(6):
        rows = []
        for i in range(300):
            big = rng.uniform(0.8e6, 1e6)
            rows.append((i, [big, -big + rng.uniform(-1, 1) / 1024, rng.gauss(0, 3), 1.0]))
        rows += [(100 * i, [1e6, 1e6, 1.0, 2.0]) for i in range(3, 6)]
        rows += [(5000 + seed, [1e300, -1e300, 1.0, 1.0])] * (seed == 5)
        kept = [r for r in rows if r[0] != 5000 + seed]
        got = sorted(map(tuple, exact_top_k(frame(spark, kept).repartition(3)).collect()))
        assert got == brute(kept)
    assert exact_top_k(frame(spark, rows)).count() > 0  # beyond a long: the nearest long, no crash


def read_share(rows, queries, k=10):
    """Mean share of the lists that queries read, over all rows as one block."""
    x = np.floor(np.array([v for _, v in rows]) * 1024).astype(np.int64)
    ids = np.array([i for i, _ in rows])
    ordered = np.sort(x, axis=0)
    at = [min(len(x) - 1, int(len(x) * d)) for d in DEPTHS]
    edges = ordered[::-1][at].astype(float), ordered[at].astype(float)
    pick = np.flatnonzero(np.isin(ids, queries))
    order = np.argsort(x, axis=0)
    head = np.unique(np.concatenate([order[:HEAD].ravel(), order[-HEAD:].ravel()]))
    floor = np.array([-best_of(ids[head], x[head], int(ids[i]), x[i], k)[-1][0] for i in pick], float)
    found = list(no_random_access(ids, x, ids[pick], x[pick], k, floor, edges))
    for i, best, _ in found:
        assert best == best_of(ids, x, int(ids[pick][i]), x[pick][i], k)
    return np.mean([share for *_, share in found])


def test_reading_stops_early():
    rng = np.random.default_rng(1)
    peaked = rng.exponential(0.2, (4000, 8)) ** 3  # a few entries hold most of each list
    assert read_share(list(enumerate(peaked.tolist())), range(0, 4000, 40)) < 0.3
    even = rng.normal(0, 0.1, (4000, 64))  # independent components: the hardest case
    assert read_share(list(enumerate(even.tolist())), range(0, 4000, 40)) < 0.9
    path = "/root/testdata/sf0.1/embeddings.parquet"
    if os.path.exists(path):
        table = pq.read_table(path)
        share = read_share(list(zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist(), strict=True)), range(0, 10**6, 100))
        assert share < 0.9, share


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 50)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(5)]) for i in range(1200)] + [(7, [0.5] * 5)] * 200
    assert sorted(map(tuple, exact_top_k(frame(spark, rows).repartition(3)).collect())) == brute(rows)


def test_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0])]
    assert sorted(map(tuple, exact_top_k(frame(spark, rows)).collect())) == brute(rows)
    assert exact_top_k(frame(spark, [(0, [1.0])])).collect() == []
    assert exact_top_k(frame(spark, [(5, [1.0]), (6, [2.0])])).collect() == []
    assert exact_top_k(frame(spark, [])).collect() == []
