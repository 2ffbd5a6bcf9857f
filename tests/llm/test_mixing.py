import random
import re
from collections import Counter, defaultdict

import numpy as np
from cases import AWKWARD, documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from twinweave.llm.mixing import SHARDS, apportion, bounded, mix, shard_words, targets


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=8), st.integers(0, 60))
def test_apportion_takes_the_highest_quotients(weights, seats):
    got = np.zeros(len(weights), int)
    if sum(weights):
        for _ in range(seats):
            got[max(range(len(weights)), key=lambda i: (weights[i] / (2 * got[i] + 1), -i))] += 1
    found = apportion(weights, seats)
    assert found.sum() == got.sum()
    # Equal quotients may be dealt in either order; the quotients themselves must agree.
    quotients = lambda g: sorted(w / (2 * k + 1) for w, n in zip(weights, g, strict=True) for k in range(n))
    assert np.allclose(quotients(found), quotients(got))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 9)), min_size=1, max_size=8), st.integers(0, 60))
def test_bounded_apportionment_deals_on_what_is_full(entries, seats):
    weights, most = zip(*entries, strict=True)
    got = np.zeros(len(weights), int)
    for _ in range(seats):
        free = [i for i in range(len(weights)) if weights[i] and got[i] < most[i]]
        if free:
            got[max(free, key=lambda i: (weights[i] / (2 * got[i] + 1), -i))] += 1
    found = bounded(weights, seats, most)
    assert (found <= np.array(most)).all()
    assert found.sum() == got.sum()
    quotients = lambda g: sorted(w / (2 * k + 1) for w, n in zip(weights, g, strict=True) for k in range(n))
    assert np.allclose(quotients(found), quotients(got))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 90), min_size=1, max_size=9), st.integers(0, 200))
def test_shards_come_within_a_block(sizes, blocks):
    words = shard_words(sizes, blocks, 8, 3)
    assert (words <= 3 * np.array(sizes)).all()
    assert min(8 * blocks, 3 * sum(sizes)) - words.sum() in range(8)


def brute_taken(spark, rows, order, goal, seed=11, block=8, cap=3):
    """taken of every row by one pass over each shard's rows in order of hash, id and size."""
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    hashed = spark.createDataFrame([(i, r[0], None if r[0] is not None else r[1]) for i, r in enumerate(rows)], "i long, id long, t string").selectExpr("i", f"xxhash64({seed}, id, t) h").collect()
    h = {r.i: r.h for r in hashed}
    cells = max(1, len(rows) // (SHARDS * 256))
    sizes = [count(r[1]) for r in rows]
    blocks = apportion([goal[s] for s in order], -(-sum(sizes) // block))
    out = Counter()
    for k, source in enumerate(order):
        shards = defaultdict(list)
        for i, r in enumerate(rows):
            if r[3] == source:
                shards[h[i] % SHARDS].append(((h[i] % 2**64 >> 20) % cells, h[i], r[0] is not None, r[0] or 0, sizes[i]))
        own = sorted(shards)
        quota = shard_words([sum(x[4] for x in shards[s]) for s in own], int(blocks[k]), block, cap)
        for s, words in zip(own, quota.tolist(), strict=True):
            total = sum(x[4] for x in shards[s])
            again, rest = divmod(words, total) if total else (0, 0)
            for _, _, has, doc_id, size in sorted(shards[s]):
                part = min(rest, size)
                rest -= part
                out[doc_id if has else None, size, again * size + part] += 1
    return out


def test_taken_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(0, 60)), "en", rng.choice(["big", "big", "big", "mid"])) for i in range(500)] + [(600 + i, prose(rng, rng.randint(0, 12)), "en", "a small one") for i in range(30)]
    rows += [(None, f"no id {i}", "en", "mid") for i in range(9)]
    got = mix(documents(spark, rows).repartition(3)).collect()
    totals, words = {}, Counter()
    for i, r in enumerate(rows):
        totals.setdefault(r[3], 0)
        totals[r[3]] += len((r[1] or "").split())
    order = sorted(totals)
    goal = dict(zip(order, targets([totals[s] for s in order], [5.0, 2.0, 1.0], 3), strict=True))
    assert Counter((r.doc_id, r["size"], r.taken) for r in got) == brute_taken(spark, rows, order, goal)
    source = {r[0]: r[3] for r in rows}
    for r in got:
        words[source[r.doc_id]] += r.taken
    assert goal["a small one"] == 3 * totals["a small one"]  # capped: every shard is filled
    assert all(abs(words[s] - goal[s]) <= 16 for s in order), (words, goal)


def test_targets_stop_at_the_cap():
    t = targets([10, 1000, 1000], [5.0, 2.0, 1.0], 3)
    assert t[0] == 30
    assert abs(sum(t) - 2010) < 1e-9
    assert abs(t[1] - 2 * t[2]) < 1e-9
    assert targets([], [], 3) == []
    assert targets([0, 0], [5.0, 2.0], 3) == [0, 0]


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(0, 80)), "en", rng.choice(["a", "b", "ä", "c", None]) if rng.random() > 0.4 else "a") for i in range(400)]
    rows += [(*r, "en", "tiny") for r in AWKWARD]
    docs = documents(spark, rows)
    got = [tuple(r) for r in mix(docs).collect()]
    assert sorted(got, key=repr) == sorted((tuple(r) for r in mix(docs.repartition(7)).collect()), key=repr)
    size = lambda t: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")])
    by_source = defaultdict(int)
    for r in rows:
        by_source[r[3]] += size(r[1])
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, targets([by_source[s] for s in order], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(order))], 3), strict=True))
    assert len(got) == len(rows)
    taken = defaultdict(int)
    source_of = {}
    for r in rows:
        source_of.setdefault((r[0], size(r[1])), r[3])
    for doc_id, n, source_size, target, k in got:
        s = source_of[doc_id, n]
        assert source_size == by_source[s]
        assert abs(target - goal[s]) < 1e-6
        assert 0 <= k <= 3 * n
        taken[s] += k
    for s in order:
        assert abs(taken[s] - goal[s]) <= max(16, 0.02 * goal[s])


def test_empty(spark):
    assert mix(documents(spark, [])).collect() == []
    assert [r.taken for r in mix(documents(spark, [(1, None), (2, "")])).collect()] == [0, 0]
