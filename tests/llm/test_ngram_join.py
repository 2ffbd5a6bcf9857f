import random
import re
from collections import Counter

import numpy as np
from cases import AWKWARD, documents, prose

from twinweave.llm import ngram_join
from twinweave.llm.ngram_join import jaccard_components, need, prefix_plan, shingle_sets


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return Counter((r[0], len(s), least.get(root(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randint(0, 10**6)}"
    return " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    rows, passage = [], prose(rng, 30)
    for i in range(60):
        rows.append((i, prose(rng, rng.randint(0, 120))))
    for g in range(6):
        base = prose(rng, rng.randint(60, 300))
        for k in range(25):
            rows.append((1000 + 100 * g + k, edited(rng, base, rng.randint(0, 1 + len(base.split()) // 40))))
    for i in range(60):
        rows.append((3000 + i, prose(rng, rng.randint(5, 60)) + " " + passage + " " + prose(rng, rng.randint(5, 40))))
    for i in range(40):
        rows.append((4000 + i, passage + f" tail{rng.randint(0, 25)}"))
    rows += [(5000 + i, rows[7][1]) for i in range(30)] + AWKWARD
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark, monkeypatch):
    for seed, most in ((1, 48), (2, 3), (3, 1)):  # short lists make most tokens heavy
        monkeypatch.setattr(ngram_join, "LIST", most)
        rows = corpus(seed)
        got = Counter(tuple(r) for r in jaccard_components(documents(spark, rows).repartition(5)).collect())
        assert got == brute(rows), (seed, most)


def test_without_probes_the_join_finds_the_same(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PROBES", 0)
    rows = corpus(4)
    assert Counter(tuple(r) for r in jaccard_components(documents(spark, rows)).collect()) == brute(rows)


def test_members_meet_where_no_leader_fits(spark):
    """Leaders are all truncated copies; the whole ones still meet each other."""
    template = [f"t{i}" for i in range(200)]
    rows = [(100 + i, " ".join([*template[:150], f"a{i}"])) for i in range(70)] + [(200 + i, " ".join([*template[110:], f"b{i}"])) for i in range(70)]
    rows += [(300 + i, " ".join(template + [f"own{i}x{j}" for j in range(20)])) for i in range(3)]
    assert Counter(tuple(r) for r in jaccard_components(documents(spark, rows)).collect()) == brute(rows)


def test_blocks_against_brute_force(spark, monkeypatch):
    """Every list is long and blocks hold a few sets: one group of near copies about the threshold spans many blocks."""
    monkeypatch.setattr(ngram_join, "LIST", 1)
    monkeypatch.setattr(ngram_join, "PROBES", 0)
    monkeypatch.setattr(ngram_join, "BLOCK_WEIGHT", 4000)
    rng = random.Random(9)
    base = prose(rng, 120)
    rows = [(i, edited(rng, base, rng.randint(1, 4))) for i in range(60)] + [(100 + i, edited(rng, prose(rng, 60), 1)) for i in range(5)] + AWKWARD
    assert Counter(tuple(r) for r in jaccard_components(documents(spark, rows)).collect()) == brute(rows)


def test_common_counts():
    rng = np.random.default_rng(2)
    for size, most in ((3, 40), (60, 90), (150, 5000)):
        x, y = ([rng.choice(6000, int(rng.integers(0, most)), replace=False).astype(np.uint64) for _ in range(size)] for _ in "xy")
        x += [np.arange(100, dtype=np.uint64)] * 5
        got = ngram_join.common_counts(x, y)
        assert (got == [[len(np.intersect1d(a, b)) for b in y] for a in x]).all()


def test_sets_with_one_name_are_told_apart(spark):
    rows = [(1, 3, 77, 5, b"a"), (2, 4, 77, 6, b"b"), (3, 3, 77, 5, None), (4, 9, 78, 5, b"c"), (5, 0, None, None, None)]
    named = ngram_join.distinctly_named(spark.createDataFrame(rows, "doc_id long, n long, cls long, second long, tokens binary"))
    cls = {r.doc_id: r.cls for r in named.collect()}
    assert cls[1] == cls[3] != cls[2]
    assert cls[4] == 78
    assert cls[5] is None


def test_one_long_text_and_many_short_ones(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, long), (2, long + " more"), (3, "x" * 2_000_000), (4, "x" * 2_000_000)]
    assert sorted(tuple(r) for r in jaccard_components(documents(spark, rows)).collect()) == [(1, 299_996, 1), (2, 299_997, 1), (3, 1, 3), (4, 1, 3)]


def test_words_that_linear_hashes_confuse(spark):
    """A Thue-Morse string and its complement, as words, are different words."""
    bits = [bin(i).count("1") & 1 for i in range(4096)]
    rows = []
    for size in (1024, 2048, 4096):
        for k, pair in enumerate(("ab", "ba")):
            word = "".join(pair[b] for b in bits[:size])
            rows += [(10 * size + k, word + " x"), (10 * size + 2 + k, word + " one two three four five six")]
        blocks = ("abcdefgh", "hgfedcba")  # whole blocks of the hash
        for k in range(2):
            rows.append((10 * size + 4 + k, "".join(blocks[b ^ k] for b in bits[: size // 8]) + " y"))
    assert Counter(tuple(r) for r in jaccard_components(documents(spark, rows)).collect()) == brute(rows)


def test_shingle_sets_name_equal_shingles_alike():
    texts = [t or "" for _, t in AWKWARD] + ["A b C d e f g", "a B c D e F g", "x a b c d e f g"]
    tokens, bounds, classes, _ = shingle_sets([t.encode() for t in texts])
    found = [tokens[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert [len(x) for x in found] == [len(shingles(t)) for t in texts]
    assert all((np.diff(x.astype(np.int64)) > 0).all() for x in found)
    assert classes[-3] == classes[-2] != classes[-1]
    assert [c == 0 for c in classes] == [len(x) == 0 for x in found]
    assert shingle_sets([])[1].tolist() == [0]
    assert (found[-3] == found[-2]).all()
    assert set(found[-2].tolist()) < set(found[-1].tolist())


def test_prefixes_share_enough_light_tokens():
    rng = np.random.default_rng(0)
    heavy = np.sort(rng.choice(10_000, 2500, replace=False)).astype(np.uint64)
    for _ in range(400):
        base = np.sort(rng.choice(10_000, int(rng.integers(5, 300)), replace=False)).astype(np.uint64)
        other = np.unique(np.concatenate([base[rng.random(len(base)) > 0.08], rng.choice(10_000, int(rng.integers(0, 8))).astype(np.uint64)]))
        both = len(np.intersect1d(base, other))
        if 100 * both < 80 * (len(base) + len(other) - both):
            continue
        plans = [prefix_plan(x[: ngram_join.longest_prefix(len(x))], len(x), heavy) for x in (base, other)]
        kept = [x[:n][light[:n]] for x, (n, _, light) in zip((base, other), plans, strict=True)]
        if any(e for _, e, _ in plans):
            assert len(np.intersect1d(*kept)) >= min(e or 1 for _, e, _ in plans)
        assert need(len(base)) <= both or need(len(other)) <= both


def test_empty(spark):
    assert jaccard_components(documents(spark, [])).collect() == []
    assert sorted(map(tuple, jaccard_components(documents(spark, [(3, None), (4, "a b c d e f")])).collect())) == [(3, 0, 3), (4, 2, 4)]
