"""Turtle files as a batch data source and as text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from twinweave.config import RDF_TYPE

SCHEMA = "graph string, s string, p string, o string, o_is_uri boolean"
_LEXEMES = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<uri><[^<>\s]*>)
    |(?P<literal>\"\"\"(?:[^\\]|\\.)*?\"\"\"|\"(?:[^"\\\n]|\\.)*\"|\'\'\'(?:[^\\]|\\.)*?\'\'\'|'(?:[^'\\\n]|\\.)*')(?:@(?P<lang>[A-Za-z0-9\-]+)|\^\^(?P<datatype><[^>]*>|[\w\-]*:[\w\-.]*))?
    |(?P<directive>@prefix|@base|PREFIX\b|BASE\b)
    |(?P<name>[\w\-]*:(?:[\w\-']|\.(?=[\w\-])|%[0-9A-Fa-f]{2}|\\.)*)
    |(?P<a>a(?=[\s<]))
    |(?P<number>[+-]?\d+(?:\.\d+)?|true\b|false\b)
    |(?P<mark>[.;,])""",
    re.X | re.S,
)
XSD = "http://www.w3.org/2001/XMLSchema#"
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "'": "'", "\\": "\\"}


def parse(text: str) -> set[tuple[str, str, str, bool]]:
    """(s, p, o, o is a URI) of a Turtle text: prefixes, base, a, lists by ; and , and literals."""
    return {t[:4] for t in parse_terms(text)}


def parse_terms(text: str, prefixes: dict[str, str] | None = None, base: str = "") -> set[tuple]:
    """(s, p, o, o is a URI, language, datatype) of a Turtle text; ``prefixes`` and ``base`` hold before it."""
    prefixes, out = dict(prefixes or {}), set()
    lexemes, at = [], 0
    while at < len(text):
        m = _LEXEMES.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"not Turtle at {text[at : at + 40]!r}")
        if m["literal"] is not None:
            lexemes.append(("literal", m["literal"], m["lang"], m["datatype"]))
        elif m.lastgroup:
            lexemes.append((m.lastgroup, m[m.lastgroup], None, None))
        at = m.end()

    def term(kind: str, value: str, lang=None, datatype=None) -> tuple:
        if kind == "uri":
            inner = value[1:-1]
            return (inner if re.match(r"[A-Za-z][\w+.\-]*:", inner) else base + inner), True, None, None
        if kind == "name":
            prefix, _, local = value.partition(":")
            return prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), True, None, None
        if kind == "a":
            return RDF_TYPE, True, None, None
        if kind == "literal":
            inner = value[3:-3] if value[:3] in ('"""', "'''") and len(value) > 5 else value[1:-1]
            named = datatype and term("uri" if datatype.startswith("<") else "name", datatype)[0]
            return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), inner), False, lang, named
        kind = "boolean" if value in ("true", "false") else "decimal" if "." in value else "integer"
        return value, False, None, f"{XSD}{kind}"

    i, dot = 0, ("mark", ".", None, None)
    while i < len(lexemes):
        kind, value = lexemes[i][:2]
        if kind == "directive":
            if "prefix" in value.lower():
                prefixes[lexemes[i + 1][1].rstrip(":")] = term(*lexemes[i + 2])[0]
                i += 3
            else:
                base = term(*lexemes[i + 1])[0]
                i += 2
            i += i < len(lexemes) and lexemes[i] == dot
            continue
        subject, i = term(kind, value)[0], i + 1
        while i < len(lexemes) and lexemes[i] != dot:
            predicate, i = term(*lexemes[i])[0], i + 1
            while True:
                out.add((subject, predicate, *term(*lexemes[i])))
                i += 1
                if i >= len(lexemes) or lexemes[i][:2] != ("mark", ","):
                    break
                i += 1
            while i < len(lexemes) and lexemes[i][:2] == ("mark", ";"):
                i += 1
        i += 1
    return out


class TurtleSource(DataSource):
    """``spark.read.format("turtle").load(file)``: a file's triples; option graph names them.

    The file may lie in any store that Arrow opens by URI; scan_turtle reads whatever Spark reads.
    """

    @classmethod
    def name(cls) -> str:
        return "turtle"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TurtleReader(self.options)


class _TurtleReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.graph = options["path"], options.get("graph", "")

    def read(self, partition):
        from pyarrow.fs import FileSystem, LocalFileSystem

        store, at = FileSystem.from_uri(self.path) if "://" in self.path else (LocalFileSystem(), self.path.removeprefix("file:"))
        with store.open_input_stream(at) as f:
            for s, p, o, is_uri in parse(f.read().decode()):
                yield self.graph, s, p, o, is_uri


def scan_turtle(spark: SparkSession, path: str, graph: str = "") -> DataFrame:
    """Triples of all Turtle files under a path, as a set; files are read by Spark and parsed in the tasks."""
    files = spark.read.text(path, wholetext=True)

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [(graph, *t) for text in frame.value for t in parse(text)]
            yield pd.DataFrame(rows, columns=["graph", "s", "p", "o", "o_is_uri"])

    return files.mapInPandas(run, SCHEMA).distinct()


def turtle_lines(triples: DataFrame) -> DataFrame:
    """s, text: one statement block per subject, full URIs, predicates and objects in order."""
    uri = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), F.lit('"'))
    pairs = triples.select("s", F.concat_ws(" ", uri(F.col("p")), F.when(F.col("o_is_uri"), uri(F.col("o"))).otherwise(quoted)).alias("po")).distinct()
    return pairs.groupBy("s").agg(F.concat(uri(F.col("s")), F.lit(" "), F.array_join(F.array_sort(F.collect_list("po")), " ;\n    "), F.lit(" .")).alias("text"))


def write_turtle(triples: DataFrame, path: str) -> None:
    """Subjects in order, as text files that Turtle readers take."""
    turtle_lines(triples).repartitionByRange("s").sortWithinPartitions("s").select("text").write.mode("overwrite").text(path)
