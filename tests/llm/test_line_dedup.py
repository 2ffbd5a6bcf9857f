import random
from collections import Counter, defaultdict

from cases import AWKWARD, documents

from twinweave.llm.line_dedup import line_dedup

WS = " \t\n\x0b\x0c\r"


def brute(rows, min_words):
    """All lines inside later copies of any run of at least min_words words."""
    docs = {}
    for r in rows:
        docs.setdefault((r[0] is None, r[0] or 0, r[1]), r)
    lines = {k: (r[1] or "").split("\n") if r[1] is not None else [] for k, r in docs.items()}
    runs, gone = defaultdict(list), defaultdict(set)
    for k in sorted(docs, key=lambda k: (k[0], k[1], k[2] or "")):
        filled = [(i, x.strip(WS)) for i, x in enumerate(lines[k]) if x.strip(WS)]
        for p in range(len(filled)):
            words = 0
            for q in range(p, len(filled)):
                words += len([w for w in filled[q][1].translate(str.maketrans(WS, " " * 6)).split(" ") if w])
                if words >= min_words:
                    runs[tuple(x for _, x in filled[p : q + 1])].append((k, [i for i, _ in filled[p : q + 1]]))
    for places in runs.values():
        for k, own in places[1:]:
            gone[k].update(own)
    out = []
    for r in rows:
        k = (r[0] is None, r[0] or 0, r[1])
        kept = None if r[1] is None else "\n".join(x for i, x in enumerate(lines[k]) if i not in gone[k])
        out.append((r[0], kept, len(gone[k])))
    return Counter(out)


def test_against_brute_force(spark):
    rng = random.Random(1)
    pool = [" ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.randint(1, 6))) for _ in range(12)]
    rows = []
    for i in range(120):
        own = [rng.choice([*pool, f"own {i} {j}", "", "  "]) for j in range(rng.randint(0, 14))]
        if i % 4 == 0:
            own[2:2] = pool[3:8]
        if i % 9 == 0:
            own += [pool[0] + " "] * 6
        rows.append((i, "\n".join(own)))
    rows += [*AWKWARD, rows[5], (None, "\n".join(pool))]
    for min_words in (1, 6, 13):
        got = Counter(tuple(r) for r in line_dedup(documents(spark, rows).repartition(5), min_words).collect())
        assert got == brute(rows, min_words), min_words


def test_passage_of_many_words_goes_once(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"start {i}\n{passage}\nend {i}") for i in range(40)] + [(99, "a clean one\nwith lines")]
    got = {r.doc_id: r for r in line_dedup(documents(spark, rows)).collect()}
    assert [i for i in range(40) if passage in got[i].text] == [0]
    assert got[7].text == "start 7\nend 7"
    assert got[99].lines_removed == 0


def test_kept_columns_and_empty(spark):
    docs = documents(spark, [(1, "x y", "en", "s")])
    row = line_dedup(docs, keep=("lang", "k", "row")).first()
    assert (row.lang, row.k, row.row) == ("en", 9, 7)
    assert line_dedup(documents(spark, [])).collect() == []


def test_whole_runs_leave_no_last_lines(spark):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    two, three = [words("a", 30), words("b", 20)], [words("c", 30), words("d", 10), words("e", 10)]
    rows = [(i, "\n".join([f"first {i}", *two, f"middle {i}", *three, f"last {i}"])) for i in range(5)]
    got = {r.doc_id: r for r in line_dedup(documents(spark, rows)).collect()}
    assert got[0].lines_removed == 0
    assert all(got[i].text == f"first {i}\nmiddle {i}\nlast {i}" for i in range(1, 5))

    rng = random.Random(5)
    pool = [" ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.randint(1, 9))) for _ in range(9)]
    rows = []
    for i in range(90):
        own = [rng.choice([*pool, f"own {i} {j}", " "]) for j in range(rng.randint(0, 12))]
        own[1:1] = pool[2:7] if i % 3 == 0 else []
        rows.append((i, "\n".join(own + pool[:1] * (6 if i % 8 == 0 else 0))))
    rows += [(200, None), (201, "")]
    for min_words in (1, 6, 13, 25):
        got = Counter(tuple(r) for r in line_dedup(documents(spark, rows).repartition(5), min_words).collect())
        assert got == brute(rows, min_words), min_words


def test_long_runs_and_runs_inside_each_other(spark):
    """Copies far longer than the prefix that is sought, nested and overlapping ones, and one line again and again."""
    rng = random.Random(11)
    long = [f"line {rng.randint(0, 10**6)} of the long one" for _ in range(150)]
    rows = [(1, "\n".join(long)), (2, "\n".join(["own", *long[20:120], "end"])), (3, "\n".join(long[100:] + long[:30])), (4, "\n".join(long[60:64])), (5, "\n".join(["same line here"] * 40)), (6, "\n".join(["same line here"] * 70 + long[:3]))]
    for min_words in (3, 25, 60):
        got = Counter(tuple(r) for r in line_dedup(documents(spark, rows), min_words).collect())
        assert got == brute(rows, min_words), min_words


def test_pipeline_stage_takes_whole_runs(spark):
    import corpus_pipeline

    passage = " ".join(f"a{i}" for i in range(30)) + "\n" + " ".join(f"b{i}" for i in range(20))
    docs = documents(spark, [(i, f"first {i}\n{passage}", "en", "s") for i in range(3)])
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()} == {0: f"first 0\n{passage}", 1: "first 1", 2: "first 2"}
