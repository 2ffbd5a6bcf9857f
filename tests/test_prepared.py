"""Prepared tables: found again when nothing changed, built anew and stale ones dropped when something did."""

from dataclasses import replace

import pytest

from twinweave.config import Settings
from twinweave.plans.prepared import Prepared, digest, fingerprint


@pytest.fixture
def store(spark, tmp_path):
    return Prepared(spark, f"file://{tmp_path}/prepared")


def frames(spark):
    return spark.createDataFrame([(0, "a", [1.0]), (1, "b", [2.0]), (2, None, None)], "idx long, label string, vec array<double>")


def asked(store, df, settings=Settings(), mode="text", name="embeddings"):
    """(rows, whether it was built, fingerprint)."""
    built = []

    def build():
        built.append(1)
        return df.select("idx")

    found, key = store.table(name, build, {"nodes": df}, settings, mode)
    return sorted(r.idx for r in found.collect()), bool(built), key


def test_found_again(spark, store):
    df = frames(spark)
    rows, built, key = asked(store, df)
    assert (rows, built) == ([0, 1, 2], True)
    assert asked(store, df.repartition(5).orderBy("label")) == (rows, False, key)  # another order is the same table


@pytest.mark.parametrize("change", ["mode", "setting", "value", "null", "repeated", "row", "type"])
def test_built_anew(spark, store, change):
    df = frames(spark)
    _, _, first = asked(store, df)
    settings, mode = Settings(), "text"
    if change == "mode":
        mode = "graph"
    elif change == "setting":
        settings = replace(settings, epochs=7)
    elif change == "value":
        df = spark.createDataFrame([(0, "a", [1.0]), (1, "c", [2.0]), (2, None, None)], df.schema)
    elif change == "null":
        df = spark.createDataFrame([(0, "a", [1.0]), (1, "b", [2.0]), (2, "", None)], df.schema)
    elif change == "repeated":
        df = df.unionByName(df.limit(1))
    elif change == "row":
        df = df.where("idx < 2")
    else:
        df = df.withColumn("idx", df.idx.cast("int"))
    _, built, key = asked(store, df, settings, mode)
    assert built
    assert key != first
    assert store.versions("embeddings") == [key]  # the stale one is gone


def test_settings_that_a_table_does_not_depend_on(spark, store):
    df = frames(spark)
    asked(store, df)
    asked(store, df, name="variables")
    other = replace(Settings(), similarity_threshold=0.5)
    assert not asked(store, df, other)[1]
    assert asked(store, df, other, name="variables")[1]


def test_a_run_cut_short_leaves_none(spark, store):
    df = frames(spark)

    def broken():
        return df.selectExpr("assert_true(idx < 2, 'lost') as x", "idx")

    with pytest.raises(Exception, match="lost"):
        store.table("similarity", broken, {"nodes": df})
    assert not store.known("similarity", fingerprint("similarity", {"nodes": df}, Settings()))
    assert asked(store, df, mode=None, name="similarity")[1]


def test_changes_drop_what_depends_on_them(spark, store):
    df, names = frames(spark), ["embeddings", "similarity", "variables", "structure", "objective"]

    def fill():
        for n in names:
            asked(store, df, name=n)

    fill()
    assert store.changed(Settings(), "text", Settings(), "text") == []
    assert store.changed(replace(Settings(), left_penalty=3.0), "text", Settings(), "text") == ["objective"]
    assert [n for n in names if store.versions(n)] == names[:4]
    fill()
    assert store.changed(replace(Settings(), similarity_threshold=None), "text", Settings(), "text") == names[2:]
    fill()
    assert store.changed(Settings(), "graph", Settings(), "text") == names
    assert not any(store.versions(n) for n in names)


def test_digest_and_mode(spark):
    none = frames(spark).limit(0)
    assert digest(none) == digest(none)
    assert digest(none) != digest(none.drop("vec"))
    with pytest.raises(ValueError):
        fingerprint("embeddings", {}, Settings(), "no such mode")
