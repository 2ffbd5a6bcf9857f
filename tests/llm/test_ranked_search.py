import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from cases import AWKWARD, documents, prose

from twinweave.llm import ranked_search as module
from twinweave.llm.ranked_search import Dictionary, Treaps, ranked_search


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    bags = [(r[0], Counter(terms(r[1]))) for r in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in {(i, tuple(sorted(set(terms(t))))) for i, t in items}:
        scored = []
        for i, b, n in bags:
            m = 100 - 50 + (50 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m)) for t in text if t in b)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def questions(spark, rows):
    return spark.createDataFrame([(*r, 5, 6) for r in rows], "item_id long, text string, doc_id long, score long")


def told(df):
    return Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def corpus(seed, n=300):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(0, 80))) for i in range(n)] + [(1000 + i, rows_text) for i, rows_text in enumerate([prose(rng, 30)] * 70)] + AWKWARD
    rng.shuffle(rows)
    items = [(i, prose(rng, rng.randint(1, 40))) for i in range(12)] + [(50, None), (51, ""), (52, "no such term zzz"), (53, "é ñ 日本語 one TWO"), (54, prose(rng, 5)), (54, prose(rng, 5)), (None, "one two"), (55, "one"), (55, "one")]
    return rows, items


@pytest.mark.parametrize(("postings", "queries", "opened"), [(1_500_000, 20_000, 256), (400, 5, 3)])
def test_against_brute_force(spark, monkeypatch, postings, queries, opened):
    monkeypatch.setattr(module, "POSTINGS", postings)
    monkeypatch.setattr(module, "QUERIES", queries)
    rows, items = corpus(postings)
    for k in (7, 50):
        assert told(ranked_search(documents(spark, rows).repartition(3), questions(spark, items), k)) == brute(rows, items, k)


def block(rng, n, lists, equal=False):
    out = []
    for t in range(lists):
        docs = np.sort(rng.choice(n, int(rng.integers(1, n)), replace=False))
        impact = np.full(len(docs), 7) if equal else rng.integers(1, 50, len(docs))
        out.append((np.full(len(docs), 3 * t), docs, impact))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def test_treaps_are_trees_in_both_orders():
    for seed, equal in ((1, False), (2, True), (3, False)):
        term, doc, impact = block(np.random.default_rng(seed), 300, 6, equal)
        t = Treaps(term, doc, impact)
        for number, root in zip(t.terms, t.root, strict=True):
            own, stack, seen = set(doc[term == number].tolist()), [(root, -1, 10**9, 10**9, 1)], []
            while stack:
                x, low, high, above, depth = stack.pop()
                if x == t.size:
                    continue
                assert low < t.doc[x] < high
                assert t.impact[x] <= above
                assert depth < 60
                seen.append(int(t.doc[x]))
                stack += [(t.left[x], low, t.doc[x], t.impact[x], depth + 1), (t.right[x], t.doc[x], high, t.impact[x], depth + 1)]
            assert sorted(seen) == sorted(own)


def test_sorted_impacts_make_deep_trees_and_right_results():
    doc = np.arange(500)
    t = Treaps(np.zeros(500, int), doc, doc + 1)
    assert t.best(np.array([0]), 3)[0].tolist() == [499, 498, 497]
    t = Treaps(np.zeros(500, int), doc, 500 - doc)
    assert t.best(np.array([0]), 3)[0].tolist() == [0, 1, 2]


def dense(term, doc, impact, terms, k):
    score = Counter()
    for t, d, i in zip(term.tolist(), doc.tolist(), impact.tolist(), strict=True):
        if t in terms:
            score[d] += i
    best = sorted((-s, d) for d, s in score.items())[:k]
    return [d for _, d in best], [-s for s, _ in best]


@pytest.mark.parametrize("cells", [4_000_000, 1])
def test_traversal_against_dense_sums(monkeypatch, cells):
    monkeypatch.setattr(module, "CELLS", cells)
    rng = np.random.default_rng(5)
    for _ in range(20):
        term, doc, impact = block(rng, 400, 8)
        t = Treaps(term, doc, impact)
        pick = rng.choice(30, 12, replace=False)
        docs, scores, _ = t.best(pick, 10)
        assert (docs.tolist(), scores.tolist()) == dense(term, doc, impact, set(pick.tolist()), 10)


def test_subtrees_are_pruned():
    """A few documents of high impact: most of the lists are never scored."""
    rng = np.random.default_rng(8)
    term, doc, _ = block(rng, 20_000, 5)
    impact = np.ceil(rng.exponential(1, len(doc)) ** 4 * 100).astype(np.int64)
    docs, scores, seen = Treaps(term, doc, impact).best(np.unique(term), 10)
    assert (docs.tolist(), scores.tolist()) == dense(term, doc, impact, set(term.tolist()), 10)
    assert seen < 4_000


def test_terms_with_one_name_are_told_apart(monkeypatch):
    """Names are held against the terms themselves."""
    known = Dictionary(["alpha", "beta", "日本"])
    data = np.frombuffer("xalphaxbetaxgammax日本x".encode(), np.uint8)
    starts, ends = np.array([1, 7, 12, 18]), np.array([6, 11, 17, 24])
    assert known.numbers(data, starts, ends).tolist() == [0, 1, -1, 2]
    known.names[:] = np.sort(module.run_names(data, starts, ends))[:3]  # wrong names: nothing is taken on trust
    assert (known.numbers(data, starts, ends) <= 2).all()
    found = known.numbers(data, starts, ends).tolist()
    assert all(f in (-1, want) for f, want in zip(found, [0, 1, -1, 2], strict=True))


def test_empty(spark):
    rows, items = [(1, "one two")], [(1, "one")]
    assert ranked_search(documents(spark, []), questions(spark, items)).collect() == []
    assert ranked_search(documents(spark, rows), questions(spark, [])).collect() == []
    assert told(ranked_search(documents(spark, rows), questions(spark, items))) == brute(rows, items, 50)
