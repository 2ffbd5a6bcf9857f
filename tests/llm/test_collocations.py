import random
import re
from collections import Counter

import numpy as np
import pytest
from cases import AWKWARD, documents

from twinweave.llm import collocations as module
from twinweave.llm.collocations import collocations, grow


def brute(rows, least, most, covered, top):
    counts, totals = {}, Counter()
    for r in rows:
        lang = r[2] if len(r) > 2 and r[2] is not None else "und"
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")):
            words = tuple(re.findall("[^ \t]+", piece))
            totals[lang] += len(words)
            for size in range(1, most + 1):
                for i in range(len(words) - size + 1):
                    counts.setdefault(lang, Counter())[words[i : i + size]] += 1
    out = []
    for lang, f in counts.items():
        frequent = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        told = []
        for p, a in frequent.items():
            inside = [n for q, n in frequent.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * n >= covered * a for n in inside):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            told.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, totals[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(told)[:top], 1)]
    return sorted(out)


def corpus(seed, n=250):
    rng = random.Random(seed)
    words = [*"abcdefgh", "The", "é", "日本", "x\x85y", "ünd", "longer-than-eight-bytes", "w" * 300]
    rows = []
    for i in range(n):
        text = "".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))])[0] + rng.choice([" ", " ", "  ", "\t", ". ", ", ", "\n", "\v", " ?"]) for _ in range(rng.randint(0, 60)))
        rows.append((i, text, rng.choice(["en", "en", "en", "fr", None])))
    rows += [(1000 + i, "new york city of new york", "en") for i in range(15)] + [(2000, "hot pair " * 500, "en"), (2001, "a a a a a a a a a a a a", "de")]
    return rows + [(r[0], r[1], "en") for r in AWKWARD]


def told(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize(("least", "most", "covered", "top", "pointers"), [(10, 3, 50, 2000, 400_000), (3, 3, 50, 40, 60), (2, 4, 80, 2000, 30)])
def test_against_brute_force(spark, monkeypatch, least, most, covered, top, pointers):
    """Few pointers a task: prefixes are dealt out over several."""
    monkeypatch.setattr(module, "POINTERS", pointers)
    monkeypatch.setattr(module, "GROUP", 3000)
    rows = corpus(least)
    got = collocations(documents(spark, rows).repartition(4), least, most, covered, top)
    assert told(got) == brute(rows, least, most, covered, top)


def test_without_marks(spark, monkeypatch):
    monkeypatch.setattr(module, "marked", lambda tokens: None)
    rows = corpus(7, 60)
    assert told(collocations(documents(spark, rows), 4)) == brute(rows, 4, 3, 50, 2000)


def test_names_are_made_anew_when_two_words_share_one(spark):
    def weak(seed):
        def run(batches):
            for batch in module._counted(seed)(batches):
                names = np.asarray(batch.column(2))
                yield batch.set_column(2, "name", module.pa.array(names % 64 if seed < 2 else names))

        return run

    words, _, seed = module.vocabulary(spark.createDataFrame([("en", " ".join(f"w{i}" for i in range(200)))], "lang string, text string"), weak)
    assert seed == 2
    assert words.count() == words.select("name").distinct().count() == 200


def test_growth_is_depth_first_and_whole():
    right = [np.array(x, np.uint64) for x in ([1, 1, 1, 2, 2], [5, 5, 6, 5, 5], [7, 0, 7, 7, 8])]
    phrases, counts = grow(right, np.array([3, 2, 1, 4, 4]), np.zeros(5, int), 4)
    found = {tuple(int(p[i]) for p in phrases): int(n) for i, n in enumerate(counts)}
    assert found == {(1, 5, 0): 5, (2, 5, 0): 8, (2, 5, 7): 4, (2, 5, 8): 4}
    phrases, counts = grow(right, np.array([3, 2, 1, 4, 4]), np.array([2, 2, 1, 0, 0]), 9)  # the first phrase lies in other tasks too
    assert [(int(p[0]), int(p[1]), int(p[2]), int(n)) for p, n in zip(zip(*phrases), counts)] == [(1, 5, 0, 5)]


def test_large_counts_are_exact(spark):
    """10^6 a^2 passes 64 bits."""
    a, x, y = 10**13 + 7, 3 * 10**13 + 1, 10**13 + 9
    rows = spark.createDataFrame([(a, x, y), (10, 10, 10)], "a long, x long, y long")
    assert [r.s for r in rows.select(module.exact_score("a", "x", "y").alias("s")).collect()] == [10**6 * a * a // (x * y), 10**6]


def test_empty(spark):
    assert collocations(documents(spark, [])).collect() == []
    assert collocations(documents(spark, [(1, None), (2, ""), (3, ". , ;")])).collect() == []
