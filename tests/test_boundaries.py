"""Learnt sentence boundaries: counts against plain loops, and what the cuts are."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from twinweave.operators import boundaries
from twinweave.operators.boundaries import association, learn, learnt_sentences, token_counts

WORDS = ["house", "river", "stone", "garden", "window", "letter", "market", "summer", "winter", "bridge", "paper", "doctor", "street", "music", "mountain"]


def corpus(seed=1, n=300):
    """Prose in which dr., approx. and e.g. are abbreviations, J. an initial, 3. october an ordinal date; The and However open sentences."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        out = []
        for _ in range(rng.randint(3, 8)):
            words = [rng.choice(["The", "However", "The", rng.choice(WORDS).title()])] + [rng.choice(WORDS) for _ in range(rng.randint(3, 9))]
            where = rng.randint(1, len(words) - 1)
            words[where:where] = rng.choice([[], [], ["Dr.", rng.choice(["Miller", "Brown", "Stone"])], ["approx.", str(rng.randint(2, 99)), "meters"], ["e.g.", "stone"], ["J.", "Miller"], ["3.", "october"], ["the", "dr.", "said"]])
            out.append(" ".join(words) + rng.choice([".", ".", ".", "!", "?"]))
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(out)))
    return rows


@pytest.fixture(scope="module")
def learnt(spark):
    docs = spark.createDataFrame([*corpus(), (900, None), (901, ""), (902, "  ")], "doc_id long, text string")
    return docs, learn(docs)


def test_counts(spark, learnt):
    docs, _ = learnt
    ended, free = Counter(), Counter()
    for r in docs.collect():
        for token in re.findall(r"[^\x20\x09-\x0d]+", r.text or ""):
            c = re.sub(r"""^["'(\[{]+|["')\]}]+$""", "", token)
            if re.search(r"[^.]\.$", c):
                ended[c[:-1].lower()] += 1
            elif c:
                free[c.lower()] += 1
    assert {r.type: (r.ended, r.free) for r in token_counts(docs).collect()} == {t: (ended[t], free[t]) for t in {*ended, *free}}


def test_what_is_learnt(learnt):
    _, found = learnt
    short = {r.type for r in found.abbreviations.collect()}
    assert {"dr", "approx", "e.g", "j"} <= short
    assert not short & set(WORDS)
    starters = {r.type for r in found.starters.collect()}
    assert {"the", "however"} <= starters
    assert not starters & {"miller", "october"}
    pairs = {(r.w1, r.w2) for r in found.collocations.collect()}
    assert {("j", "miller"), ("3", "october")} <= pairs


def cut(spark, learnt, text):
    return [r.sentence for r in learnt_sentences(spark.createDataFrame([(1, text)], "doc_id long, text string"), learnt[1]).orderBy("pos").collect()]


@pytest.mark.parametrize(("text", "want"), [
    ("The doctor met Dr. Miller. The stone fell.", ["The doctor met Dr. Miller.", "The stone fell."]),
    ("It is approx. 12 meters long! Is it?  Yes.", ["It is approx. 12 meters long!", "Is it?", "Yes."]),
    ("J. Miller came on 3. october to us. However it rained.", ["J. Miller came on 3. october to us.", "However it rained."]),
    ("We saw the dr. The house was empty.", ["We saw the dr.", "The house was empty."]),
    ("It was in 1912. Window and door.", ["It was in 1912.", "Window and door."]),
    ("Wait... what? Wait... What?", ["Wait... what?", "Wait...", "What?"]),
    ('He said "stop." Then he left.', ['He said "stop."', "Then he left."]),
    ("  inner   space\tstays. Yes ", ["inner   space\tstays.", "Yes"]),
    ("no end", ["no end"]), ("", []), ("   ", []), ("...", ["..."]),
])
def test_cuts(spark, learnt, text, want):
    assert cut(spark, learnt, text) == want


def test_repeated_rows_nulls_and_empty(spark, learnt):
    docs = spark.createDataFrame([(1, "Some bee. Cats do."), (1, "Some bee. Cats do."), (2, None), (None, "x")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.pos, r.sentence) for r in learnt_sentences(docs, learnt[1]).collect()), key=repr) == sorted([(1, 0, "Some bee."), (1, 0, "Some bee."), (1, 1, "Cats do."), (1, 1, "Cats do."), (None, 0, "x")], key=repr)
    nothing = learn(docs.limit(0))
    assert [nothing.abbreviations.count(), nothing.starters.count(), nothing.collocations.count()] == [0, 0, 0]
    assert learnt_sentences(docs.limit(0), nothing).collect() == []


def test_association(spark):
    def plain(both, first, second, total):
        part = lambda k, n, p: (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n - k else 0.0)
        k2, n2 = second - both, total - first
        return 2 * (part(both, first, both / first) + part(k2, n2, k2 / n2) - part(both, first, second / total) - part(k2, n2, second / total))

    rows = [(30, 40, 50, 1000), (40, 40, 40, 1000), (1, 500, 3, 1000)]
    got = [r.s for r in spark.createDataFrame(rows, "a long, b long, c long, d long").select(association(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("s")).collect()]
    assert got[:2] == pytest.approx([plain(*r) for r in rows[:2]])
    assert got[2] == 0.0


def test_texts_that_were_learnt_from_are_cut_once_and_no_text_is_sorted(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"Dr. Ant no. {k} came... It went! (Who?) \n Yes. ") for k in range(30)] + [(30, None), (31, "")], "doc_id long, text string")
    read, plain = [], boundaries.cut
    monkeypatch.setattr(boundaries, "cut", lambda *a: read.append(1) or plain(*a))
    found = boundaries.learn(docs)
    mine = learnt_sentences(docs, found)
    assert len(read) == 1
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    apart = learnt_sentences(docs.select("*"), found)  # other docs, as far as is known
    assert len(read) == 2
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(mine) == rows(apart)
    assert len({r[0] for r in rows(mine)}) == 30
    found.drop()
