import random
import re
from collections import Counter, defaultdict

import pytest
from test_language_id import WORDS
from test_line_dedup import brute as brute_lines
from test_ngram_join import brute as brute_join
from test_packing import check as check_pieces

import corpus_pipeline
from twinweave.llm.line_dedup import MIN_WORDS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows():
    rng = random.Random(12)
    out = []
    for i in range(150):
        lang = list(WORDS)[i % 3]
        lines = [" ".join(rng.choice(WORDS[lang]) + str(rng.randint(0, 30)) for _ in range(rng.randint(3, 40))) for _ in range(rng.randint(1, 6))]
        out.append((i, "\n".join(lines), lang, rng.choice(["a", "b", None])))
    passage = " ".join(rng.choice(WORDS["en"]) for _ in range(60))
    out += [(300 + i, f"the first line {i}\n{passage}", "en", "a") for i in range(5)]
    copied = "\n".join(" ".join(rng.choice(WORDS["fr"]) + str(rng.randint(0, 99)) for _ in range(12)) for _ in range(5))
    out += [(400 + i, copied, "fr", "b") for i in range(4)]
    long = " ".join(rng.choice(WORDS["de"]) + str(k) for k in range(200))
    out += [(500 + i, re.sub(f" {WORDS['de'][0]}\\d+", f" anders{i}", long, count=2), "de", "b") for i in range(4)]
    out += [(600, "12 345 !!", None, "a"), (601, None, None, None), (602, "", "en", "a"), (None, "the text without an id and with words", "en", "a")]
    return [(*r, len(r[1] or "")) for r in out]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    return at


def test_stages_against_brute_force(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "mixture", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    key = lambda df: Counter((r.doc_id, r.text, r.lang, r.source) for r in df.collect())

    known = stage["language"](spark, docs, folder)
    gone = set((key(docs) - key(known)).keys())
    assert {g[0] for g in gone} == {600, 601, 602}

    known = spark.createDataFrame(known.collect(), SCHEMA)
    lines = stage["lines"](spark, known, folder)
    given = [(r.doc_id, r.text) for r in known.collect()]
    want = Counter({k: n for k, n in brute_lines(given, MIN_WORDS).items() if k[2] == 0 or (k[1] or "").split()})
    assert Counter((r.doc_id, r.text) for r in lines.collect()) == Counter({k[:2]: n for k, n in want.items()})
    assert {r.doc_id for r in lines.where("doc_id between 400 and 403").collect()} == {400}

    lines = spark.createDataFrame(lines.collect(), SCHEMA)
    stay = stage["near_copies"](spark, lines, folder)
    classes = brute_join([(r.doc_id, r.text) for r in lines.collect()])
    assert {r.doc_id for r in stay.collect()} == {k[2] for k in classes} | {None}

    stay = spark.createDataFrame(stay.collect(), SCHEMA)
    mixed = stage["mixture"](spark, stay, folder)
    whole = {r.doc_id: r.text for r in stay.collect()}
    words, copies = defaultdict(int), defaultdict(int)
    for r in mixed.collect():
        assert whole[r.doc_id].startswith(r.text)
        assert r.n_chars == len(r.text)
        words[r.doc_id] += len(r.text.split())
        copies[r.doc_id] += r.text == whole[r.doc_id]
    taken = {r.doc_id: r.taken for r in corpus_pipeline.mix(stay).collect() if r.taken}
    assert words == taken
    assert all(n <= 3 for n in copies.values())

    mixed = spark.createDataFrame(mixed.collect(), SCHEMA)
    assert check_pieces([(r.doc_id, r.text) for r in mixed.collect()], stage["packing"](spark, mixed, folder).collect()) == 0
    for df in (known, lines, stay, mixed):
        assert df.columns == COLUMNS


def test_run_and_empty(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_mixture_takes_whole_documents(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), "en", rng.choice("abc"), 0) for i in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA)
    text, goal, got = {r[0]: r[1] for r in rows}, defaultdict(int), Counter()
    for r in corpus_pipeline.mixing.mix(docs).collect():
        goal[rows[r.doc_id][3]] += r.taken
    copies = Counter()
    for r in corpus_pipeline.mixture(spark, docs.repartition(4), "").collect():
        assert r.text == text[r.doc_id]
        got[r.source] += len(r.text.split())
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 3
    assert all(2 * abs(goal[s] - got[s]) <= 60 for s in "abc"), (goal, got)


def test_rows_that_share_an_id_or_have_none(spark):
    text = lambda name, n=30: " ".join(f"{name}{i}" for i in range(n))
    rows = [(1, text("a"), "en", "s", 0), (1, text("b"), "en", "s", 0), (1, text("b"), "en", "s", 0), (2, text("b") + " more", "en", "s", 0), (None, text("c"), "en", "s", 0), (None, text("c") + " more", "en", "s", 0), (None, text("d"), "en", "s", 0), (5, text("d"), "en", "s", 0)]
    stay = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, SCHEMA), "")
    found = sorted((r.doc_id or 0, r.text[0]) for r in stay.collect())
    assert found == [(0, "c"), (1, "a"), (1, "b"), (5, "d")]

    rows = [(3, "", "en", "s", 0), (3, "", "en", "s", 0), (None, None, None, None, None), (None, None, None, None, None), (4, " \n", "en", "s", 0), (6, text("e"), "en", "s", 0), (6, text("e"), "en", "t", 0)]
    stay = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id or 0, r.text and r.text[:1]) for r in stay if not (r.text or "").strip()) == [(0, None), (0, None), (3, ""), (3, ""), (4, " ")]
    assert [r.doc_id for r in stay if (r.text or "").strip()] == [6]  # two sources, one text

    rows = [(None, text(f"x{i}_", 8 + i % 5), "en", "a", 0) for i in range(40)] + [(7, text(f"y{i}_", 9), "en", "a", 0) for i in range(20)] + [(9, text("z", 9), "en", "a", 0)] * 6
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    mixed = Counter(r.text for r in corpus_pipeline.mixture(spark, docs, "").collect())
    want = Counter(r[1] for r in rows)  # one source: as many words as there are, each shard's quota in blocks of 8
    words = lambda c: sum(len(t.split()) * n for t, n in c.items())
    assert abs(words(mixed) - words(want)) <= 8 + 12
    assert all(n <= 2 * want[t] for t, n in mixed.items())
    assert sum((mixed - want).values()) + sum((want - mixed).values()) <= len(rows) // 4
