import hashlib
import random
import re
from collections import defaultdict

from cases import AWKWARD, documents

from twinweave.llm.exact_dedup import directory, exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    out = []
    for body, own in groups.items():
        best = min(own, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        kept = [False] * len(own)
        kept[own.index(best)] = True
        out += [(r[0], best[0], len(own), k, hashlib.sha256(body.encode()).hexdigest()) for r, k in zip(own, kept, strict=True)]
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 4)))) for i in range(300)] + AWKWARD
    docs = documents(spark, rows)
    for budget in (1, 1 << 20):  # with 1, a task's summary is sent on after every batch
        got = sorted((tuple(r) for r in exact_dedup(docs.repartition(5), budget=budget).collect()), key=repr)
        assert got == brute(rows)


def test_directory_doubles_where_needed():
    pages = directory({0: 100, 1: 100, 9: 1}, 100, depth=4)
    bucket = dict(pages)
    assert len(bucket) == 16
    assert bucket[0] != bucket[1]
    assert bucket[8] == bucket[15]  # an almost empty half stays one bucket
    assert len(set(dict(directory({}, 1, depth=4)).values())) == 1
    assert len(set(dict(directory({3: 10**9}, 1, depth=2)).values())) == 3  # one key can't be split


def test_empty(spark):
    assert exact_dedup(documents(spark, [])).collect() == []
