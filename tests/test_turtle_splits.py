"""Turtle read in splits against the parse of the whole text."""

import random

import pytest

from twinweave.runtime import settings
from twinweave.sources import turtle
from twinweave.sources.turtle_splits import DOUBLE, OUT, SINGLE, read_turtle, walk, write_turtle

HEAD = '@prefix ex: <http://e/> .\nPREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n# a comment . with a dot\n'
BODY = [
    'ex:a ex:p ex:b , ex:c ;\n    ex:q "one . two"@en ;\n    a ex:T .', '<http://x/s#1> ex:p "3"^^xsd:integer . ex:v1.5 ex:p 1.5 .', "ex:Grover's_algorithm ex:p '''long\nwith . dots \" and '' quotes\n. \nend''' .",
    'ex:d ex:p """triple\n\n# no comment .\nex:x ex:y ex:z .\n\\"""more""" ;\n ex:q true .  # ex:no ex:no ex:no .', 'ex:e\n  ex:p\n\n  ex:f\n.', 'ex:l ex:p "tab\\t\\"q\\" \\\\ é 日本"@de-AT .', "ex:m ex:p 'a # b' . # c",
]


def full(text):
    return turtle.parse_terms(text)


def rows(df):
    got = [tuple(r)[1:] for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("size", [40, 250, 100_000])
def test_splits_equal_the_whole(spark, tmp_path, size):
    rng = random.Random(size)
    body = "\n".join(rng.choice(BODY).replace("ex:p", f"ex:p{k % 7}") for k in range(25))
    text = HEAD + body + "\n"
    (tmp_path / "g.ttl").write_text(text)
    with settings(spark, spark__sql__files__maxPartitionBytes=str(size), spark__sql__files__openCostInBytes="0", spark__sql__files__minPartitionNum="1"):
        assert rows(read_turtle(spark, str(tmp_path / "g.ttl"), "g")) == full(text)


def test_folders_globs_names_and_predicates(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"n{k}.ttl").write_text(f"@prefix ex: <http://e{k}/> .\nex:a ex:p ex:b ; ex:q {k} .")
    (tmp_path / "empty.ttl").write_text("")
    found = read_turtle(spark, str(tmp_path)).collect()
    assert {(r.graph, r.s, r.p) for r in found} == {(f"n{k}", f"http://e{k}/a", f"http://e{k}/{p}") for k in range(3) for p in "pq"}
    assert {r.graph for r in read_turtle(spark, str(tmp_path / "n[12].ttl")).collect()} == {"n1", "n2"}
    assert {r.graph for r in read_turtle(spark, str(tmp_path), names=r"^n0\.").collect()} == {"n0"}
    only = read_turtle(spark, str(tmp_path), "all", predicates=["http://e1/q"])
    assert [tuple(r) for r in only.collect()] == [("all", "http://e1/a", "http://e1/q", "1", False, None, "http://www.w3.org/2001/XMLSchema#integer")]


def test_prefixes_with_two_meanings(spark, tmp_path):
    text = "@prefix ex: <http://one/> .\nex:a ex:p ex:b .\n@prefix ex: <http://two/> .\nex:a ex:p ex:b .\n"
    (tmp_path / "g.ttl").write_text(text)
    assert rows(read_turtle(spark, str(tmp_path / "g.ttl"))) == full(text) == {(f"http://{n}/a", f"http://{n}/p", f"http://{n}/b", True, None, None) for n in ("one", "two")}


def test_no_turtle_is_an_error(spark, tmp_path):
    (tmp_path / "g.ttl").write_text("<a> <b> ]")
    with pytest.raises(Exception, match="not Turtle"):
        read_turtle(spark, str(tmp_path / "g.ttl")).collect()


def test_states():
    assert walk('a b """x . y', OUT) == (DOUBLE, [])
    assert walk('x . y""" . # "" .', DOUBLE) == (OUT, [10])
    assert walk("<a#b> '.' 1.5 c.d .", OUT) == (OUT, [19])
    assert walk('"""', SINGLE) == (SINGLE, [])
    assert walk('a \\""" b""" .', DOUBLE) == (OUT, [13])
    assert walk("PREFIX ex: <http://e/> ex:a ex:prefix <b>.", OUT) == (OUT, [22, 42])


def test_written_with_prefixes_and_read_back(spark, tmp_path):
    given = [("http://e/a", "http://e/p", f"value {k}\n\"q\" \\ '", False, "en" if k % 2 else None, None) for k in range(40)]
    given += [("http://e/a", "http://e/p", "5", False, None, "http://www.w3.org/2001/XMLSchema#integer"), ("http://e/b c", "http://o/q", "http://e/x.y", True, None, None), ("http://e/z", "http://e/p", "http://e/a", True, None, None)]
    triples = spark.createDataFrame(given * 2, "s string, p string, o string, o_is_uri boolean, lang string, datatype string")
    write_turtle(triples.where("s <> 'http://e/b c'"), str(tmp_path / "out"), {"ex": "http://e/", "xsd": "http://www.w3.org/2001/XMLSchema#"})
    text = "".join(f.read_text() for f in (tmp_path / "out").iterdir() if f.name.startswith("part-"))
    assert "ex:a ex:p" in text
    assert "xsd:integer" in text
    assert rows(read_turtle(spark, str(tmp_path / "out"))) == {t for t in given if t[0] != "http://e/b c"}
