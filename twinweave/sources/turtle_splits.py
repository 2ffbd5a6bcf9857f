"""Turtle files of any size: splits are read in parallel and put together where a statement crosses them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinweave.runtime import materialise, materialise_at
from twinweave.sources.turtle import parse_terms

SCHEMA = "graph string, s string, p string, o string, o_is_uri boolean, lang string, datatype string"
#: States between two lines: outside, or within a literal of three double or single quotes.
OUT, DOUBLE, SINGLE = 0, 1, 2
_OPENERS = {'"""': DOUBLE, "'''": SINGLE}
_CLOSE = {DOUBLE: re.compile(r'(?:[^"\\]|\\.|"(?!""))*"""', re.S), SINGLE: re.compile(r"(?:[^'\\]|\\.|'(?!''))*'''", re.S)}
#: What a line is made of outside of long literals; names may hold dots and apostrophes.
_PART = re.compile(r'''\s+|\#.*|<[^<>\s]*>|"""|\'\'\'|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^\s<"'\#.;,](?:[^\s<"\#.;,]|\.(?=[\w\-%\\]))*|.''')
#: Directives without a dot, on one line.
_PLAIN = re.compile(r"(?:PREFIX\s+[^\s:]*:\s*|BASE\s*)<[^<>\s]*>", re.I)


def walk(line: str, state: int) -> tuple[int, list[int]]:
    """(the state after a line, places in it where a statement ends: after its dot, or a directive without one)."""
    at, ends = 0, []
    while at < len(line):
        if state:
            m = _CLOSE[state].match(line, at)
            if not m:
                return state, ends
            at, state = m.end(), OUT
            continue
        m = _PLAIN.match(line, at) or _PART.match(line, at)
        state = _OPENERS.get(m[0], OUT)
        if m[0] == "." or m.re is _PLAIN:
            ends.append(m.end())
        at = m.end()
    return state, ends


def _splits(batches) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """((file, start), lines) of each split in a task, line by line."""
    for batch in batches:
        for file, start, value in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            yield (file, start), value


def _states(batches):
    """file, start and the state after a split for each state before it."""
    of: dict[tuple[str, int], list[int]] = {}
    for key, line in _splits(batches):
        now = of.setdefault(key, [OUT, DOUBLE, SINGLE])
        known = {s: walk(line, s)[0] for s in set(now)}
        of[key] = [known[s] for s in now]
    if of:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in of]), pa.array([k[1] for k in of], pa.int64()), pa.array(list(of.values()), pa.list_(pa.int32()))], names=["file", "start", "after"])


def _cut(begins):
    """file, start, seq, whole and text: the statements of a split, its first and last piece not known to be whole."""

    def run(batches):
        rows: list[tuple] = []
        key, state, seq, held, first = None, OUT, 0, [], True

        def rest():
            text = "\n".join(held)
            if text.strip() or not first:
                rows.append((*key, seq, False, text))

        for now, line in _splits(batches):
            if now != key:
                if key is not None:
                    rest()
                key, state, seq, held, first = now, begins.value.get(now, OUT), 0, [], True
            state, ends = walk(line, state)
            at = 0
            for end in ends:
                rows.append((*key, seq, not first, "\n".join([*held, line[at:end]])))
                seq, held, at, first = seq + 1, [], end, False
            held.append(line[at:])
            if len(rows) >= 5_000:
                yield _table(rows)
                rows = []
        if key is not None:
            rest()
        if rows:
            yield _table(rows)

    return run


def _table(rows):
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "start", "seq", "whole", "text"])


def _joined(rows: pa.Table) -> pa.Table:
    """The pieces at the edges of a file's splits, put together and cut into statements."""
    pieces = sorted(zip(*(rows.column(c).to_pylist() for c in ("start", "seq", "text")), strict=True))
    out, held, state = [], [], OUT
    for _, _, text in pieces:
        for line in text.split("\n"):
            state, ends = walk(line, state)
            at = 0
            for end in ends:
                out.append("\n".join([*held, line[at:end]]))
                held, at = [], end
            held.append(line[at:])
    if "\n".join(held).strip():
        out.append("\n".join(held))  # no final dot: the parser says whether that is an error
    return pa.table({"file": pa.array([rows.column("file")[0].as_py()] * len(out), pa.string()), "text": pa.array(out, pa.string())})


def read_turtle(spark: SparkSession, path: str | list[str], graph: str | None = None, predicates: list[str] | None = None, names: str | None = None) -> DataFrame:
    """graph, s, p, o, o_is_uri, lang and datatype of all triples under a path, folder or glob, as a set.

    ``graph`` names all of them, else each file's name without its ending. ``names`` is
    a pattern of file names: other files are not opened. ``predicates`` keeps the
    triples of those predicates; the others are left in the parsing task.

    1. Spark cuts files into splits of whole lines. A first pass tells for every split
       how it leaves each state (outside, or within a long literal) that it may be
       entered in; states then compose along each file.
    2. Each split is cut into statements from the state it begins in. What crosses
       splits, at most a piece at each end of one, is put together per file.
    3. Prefixes and bases are those of a file's directives. A file that gives one
       prefix two meanings, or two bases, is read as a whole, since place decides there.
    4. Statements are parsed in the tasks that hold them.

    An empty file has no triples; a text that is no Turtle is an error.
    """
    lines = spark.read.text(path)
    if names:
        lines = lines.where(F.col("_metadata.file_name").rlike(names))
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    after = lines.mapInArrow(_states, "file string, start long, after array<int>").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "after"))).alias("splits"))
    begin = F.aggregate("splits", F.struct(F.lit(0).alias("now"), F.array().cast("array<struct<start:bigint,state:int>>").alias("seen")), lambda s, x: F.struct(x["after"][s["now"]].alias("now"), F.concat(s["seen"], F.array(F.struct(x["start"].alias("start"), s["now"].alias("state")))).alias("seen")), lambda s: s["seen"])
    odd = after.select("file", F.explode(begin).alias("b")).where("b.state <> 0").select("file", "b.start", "b.state")
    begins = spark.sparkContext.broadcast({(r.file, r.start): r.state for r in odd.collect()})  # only splits that begin within a long literal
    pieces, _ = materialise_at(lines.mapInArrow(_cut(begins), "file string, start long, seq long, whole boolean, text string"), "turtle-pieces")
    joined = pieces.where("not whole").groupBy("file").applyInArrow(_joined, "file string, text string")
    statements = materialise(pieces.where("whole").select("file", "text").unionByName(joined), "turtle-statements")
    directive = F.col("text").rlike(r"(?i)^\s*(#[^\n]*\n\s*)*(@prefix|@base|prefix\b|base\b)")
    heads = statements.where(directive).select("file", F.regexp_replace("text", r"(?m)^\s*#[^\n]*$", "").alias("text"))
    keyed = heads.select("file", "text", F.coalesce(F.nullif(F.regexp_extract("text", r"(?i)prefix\s+([^\s:]*):", 1), F.lit("")), F.when(F.col("text").rlike(r"(?i)^\s*@?base"), "<base>").otherwise("")).alias("prefix")).distinct()
    twice = keyed.groupBy("file", "prefix").agg(F.countDistinct(F.regexp_extract("text", r"<([^>]*)>", 1)).alias("n")).where("n > 1").select("file").distinct()
    header = keyed.groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("text")), "\n").alias("header"))
    whole = [r.file for r in twice.collect()]
    body = statements.where(~directive).join(twice, "file", "left_anti").join(header, "file", "left").select("file", "header", "text")
    if whole:
        body = body.unionByName(spark.read.text(whole, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.lit(None).cast("string").alias("header"), F.col("value").alias("text")))
    wanted, name = set(predicates) if predicates is not None else None, graph

    def run(batches):
        known: tuple = (None, {}, "")
        for batch in batches:
            rows = []
            for file, head, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if known[0] != head:
                    known = (head, *directives(head or ""))
                own = name if name is not None else re.sub(r"\.[^.]*$", "", file.rsplit("/", 1)[-1])
                rows.extend((own, *t) for t in parse_terms(text, known[1], known[2]) if wanted is None or t[1] in wanted)
            if rows:
                kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return body.mapInArrow(run, SCHEMA).distinct()


def directives(header: str) -> tuple[dict[str, str], str]:
    """(prefixes, base) that a header of directives gives; a base holds for all of it."""
    base = re.search(r"(?i)base\s*<([^>]*)>", header)
    base = base[1] if base else ""
    full = lambda iri: iri if re.match(r"[A-Za-z][\w+.\-]*:", iri) else base + iri
    return {m[1]: full(m[2]) for m in re.finditer(r"(?i)prefix\s+([^\s:]*):\s*<([^>]*)>", header)}, base


def written(triples: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """s, text: a statement block per subject of triples(s, p, o, o_is_uri[, lang, datatype]) with names for the prefixes' URIs."""
    optional = [F.col(c) if c in triples.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "datatype")]
    rows = triples.select("s", "p", "o", "o_is_uri", *optional).distinct()

    def uri(c):
        out = F.concat(F.lit("<"), c, F.lit(">"))
        for name, space in prefixes.items():
            tail = F.substring(c, F.lit(len(space) + 1), F.length(c))
            out = F.when(c.startswith(space) & tail.rlike(r"^[A-Za-z_][A-Za-z0-9_\-]*\z"), F.concat(F.lit(f"{name}:"), tail)).otherwise(out)
        return out

    escaped = F.col("o")
    for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(code))
    literal = F.concat(F.lit('"'), escaped, F.lit('"'), F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).when(F.col("datatype").isNotNull(), F.concat(F.lit("^^"), uri(F.col("datatype")))).otherwise(F.lit("")))
    pairs = rows.select("s", F.concat_ws(" ", uri(F.col("p")), F.when(F.col("o_is_uri"), uri(F.col("o"))).otherwise(literal)).alias("po"))
    return pairs.withColumn("k", F.row_number().over(Window.partitionBy("s").orderBy("po"))).select("s", "k", F.concat(F.when(F.col("k") == 1, uri(F.col("s"))).otherwise(F.lit("   ")), F.lit(" "), "po").alias("line"))


def write_turtle(triples: DataFrame, path: str, prefixes: dict[str, str] | None = None) -> None:
    """Files in the order of subjects, each with the prefixes; a subject's triples are lines, so no subject is held as a whole.

    Every file stands for itself. Spark's committer moves files in when all tasks are done.
    """
    prefixes = dict(sorted((prefixes or {}).items()))
    rows = written(triples, prefixes)
    sizes = rows.groupBy("s").agg(F.max("k").alias("last"))
    closed = rows.join(sizes, "s").select("s", "k", F.concat("line", F.when(F.col("k") == F.col("last"), " .").otherwise(" ;")).alias("line"))
    header = [f"@prefix {n}: <{u}> ." for n, u in prefixes.items()]

    def run(batches):
        first = True
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if first and lines:
                lines, first = header + lines, False
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    closed.repartitionByRange("s").sortWithinPartitions("s", "k").select("line").mapInArrow(run, "value string").write.mode("overwrite").text(path)
