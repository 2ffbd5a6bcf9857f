"""Secret scans: fixed patterns, and assignments whose names are sensitive."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.llm.pieces import give_back
from twinweave.runtime import small_batches

#: Kinds in the order that counts at one start; the last one is the lexer's.
KINDS = ("assign", "access", "hex", "literal")
#: Literals that a joined value, or a name that holds one, stands for: its first ones.
PARTS = 64
#: A literal is a secret if its name's weight times its own is at least this.
ENOUGH = 0.45

_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
_STARTS = re.compile(rb"password|passwd|secret|token|api_?key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")

#: What a part of a name adds to, or takes from, the name's weight.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.8, "secret": 1.0, "token": 0.8, "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "bearer": 0.8, "auth": 0.5,
    "authorization": 0.6, "private": 0.5, "access": 0.4, "api": 0.4, "client": 0.1, "signing": 0.5, "encryption": 0.5, "signature": 0.4, "session": 0.3, "key": 0.5, "salt": 0.5, "seed": 0.3,
    "url": -0.5, "uri": -0.5, "path": -0.5, "file": -0.5, "name": -0.5, "id": -0.4, "type": -0.5, "length": -0.6, "count": -0.6, "size": -0.6, "public": -0.6, "expiry": -0.6, "field": -0.5, "label": -0.5, "prompt": -0.5, "regex": -0.6, "pattern": -0.6,
}
#: Literals that only stand for a secret.
PLACEHOLDERS = re.compile(rb"(?i)change.?me|example|placeholder|your[_-]|dummy|sample|redacted|xxxx|\*\*\*\*|\.\.\.\.|^<.*>$|^\$\{?\w+|^%\(|\{\{|^(none|null|true|false|todo|undefined|string|text|password|secret|token)$")
_STEMS = (b"pass", b"pwd", b"secret", b"token", b"key", b"cred", b"auth", b"bearer", b"priv", b"salt", b"sign", b"seed")

_OPERATOR = re.compile(rb"[=:]")
#: A name before an operator, perhaps quoted, indexed or with a type.
_NAME = re.compile(rb"([A-Za-z_$][\w$.-]*)[\"']?\]?[ \t]*(?::[ \t]*[A-Za-z_][\w.\[\]|]*[ \t]*)?$")
_QUOTED = re.compile(rb"[rbuf]{0,2}(\"\"\"|'''|[\"'`])((?:\\.|(?!\1)[^\\\r\n])*)\1", re.I)
_BARE = re.compile(rb"[^\s\"'`,;(){}\[\]<>&|#]+")
_REFERENCE = re.compile(rb"[A-Za-z_$][\w$.]*")
_JOINED = re.compile(rb"[ \t]*(?:\+|\.\.)[ \t]*|[ \t]+(?=[\"'])")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: Bytes before an operator that are read for its name.
_BEFORE = 200


def name_weight(name: str) -> float:
    """How sensitive a variable's, field's or option's name is, 0 to 1: its parts' weights summed."""
    last = name.rsplit(".", 1)[-1] or name
    return min(1.0, max(0.0, sum(NAME_WEIGHTS.get(w.lower(), 0.0) for w in _WORDS.findall(last))))


def literal_weight(literal: bytes) -> float:
    """How much a literal looks like a secret, 0 to 1: its entropy in bits over 32; 0 for placeholders, short ones, numbers and plain words."""
    if len(literal) < 8 or literal.isalpha() or literal.isdigit() or any(c in literal for c in b" \t") or PLACEHOLDERS.search(literal):
        return 0.0
    n = len(literal)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    return min(1.0, bits * n / 32) if bits > 1.5 else 0.0


def _value(data: bytes, at: int, known: dict[bytes, list]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(literals, own literals) of an expression at ``at``: quoted parts and what its names hold."""
    found, own = [], []
    while True:
        if m := _QUOTED.match(data, at):
            span = m.span(2)
            if span[1] > span[0]:
                found.append(span)
                own.append(span)
        elif m := _REFERENCE.match(data, at):
            held = known.get(m[0]) or known.get(m[0].rsplit(b".", 1)[-1])
            if held is None or data[m.end() : m.end() + 1] in (b"(", b"["):  # no constant; perhaps a bare literal
                if not found and (m := _BARE.match(data, at)):
                    found.append(m.span())
                    own.append(m.span())
                return found, own
            found += [s for s in held if s not in found]
        elif not found and (m := _BARE.match(data, at)):
            found.append(m.span())
            own.append(m.span())
        else:
            return found, own
        more = _JOINED.match(data, m.end())
        if not more or len(found) >= PARTS:
            return found, own
        at = more.end()


def assignments(data: bytes) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """(name, spans of its literals) of every assignment, field and option, in order of the text.

    A name that was assigned before stands for its literals, so a constant that goes
    through other names is found at the place where it is written. The last
    assignment before a use counts.
    """
    known: dict[bytes, list] = {}
    found, done = [], 0
    for m in _OPERATOR.finditer(data):
        at = m.start()
        if at < done or data[at : at + 2] in (b"==", b":=", b"::") or data[at : at + 3] == b"://":
            continue  # an operator that is no assignment, or one that ends at the next byte
        before = data[at - 1 : at] if at else b""
        if before in (b"=", b"!", b"<", b">") or before + m[0] == b"::":
            continue
        name = _NAME.search(data[max(done, at - _BEFORE) : at - (m[0] == b"=" and before in (b":", b"+", b"?"))])
        if not name:
            continue
        begin = at + 1 + (data[at + 1 : at + 2] == b">")
        while data[begin : begin + 1] in (b" ", b"\t"):
            begin += 1
        literals, own = _value(data, begin, known)
        if not literals:
            continue
        known[name[1]] = known[name[1].rsplit(b".", 1)[-1]] = literals
        found.append((name[1], literals))
        if data[begin : begin + 1] in (b'"', b"'", b"`"):
            done = own[-1][1]  # what is quoted holds no assignment of its own
    return found


def base_spans(data: bytes, low: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes of the fixed patterns; low is data with A-Z folded."""
    out, end = [], 0
    for start in _STARTS.finditer(low):  # as a match can only begin there
        if start.start() >= end and (m := _ASSIGN.match(data, start.start())):
            end = m.end()
            if len(m[2]) >= 8:
                out.append((m.start(), end, "assign"))
    if b"AKIA" in data:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(data) if m.end() - m.start() >= 16]
    return out + [(*m.span(), "hex") for m in _HEX.finditer(data)]


def spans_of(data: bytes) -> list[tuple[str, int, int, str | None, float | None]]:
    """(kind, start, end, name, score) of a text's secrets, in code points, by start, then kind.

    A literal within a span of the fixed patterns is not told again; of names that
    hold one literal the most sensitive counts, then the first.
    """
    low = data.lower()
    base = base_spans(data, low)
    best: dict[tuple[int, int], tuple[float, bytes]] = {}
    if (b"=" in data or b":" in data) and any(s in low for s in _STEMS):
        for name, literals in assignments(data):
            weight = name_weight(name.decode("utf-8", "replace"))
            if weight < ENOUGH:
                continue
            whole = b"".join(data[a:b] for a, b in literals)
            score = weight * literal_weight(whole)
            if score >= ENOUGH:
                for span in literals:
                    if score > best.get(span, (0.0, b""))[0]:
                        best[span] = (score, name)
    found = [(a, KINDS.index(k), b, None, None) for a, b, k in base]
    found += [(a, 3, b, name.decode("utf-8", "replace"), score) for (a, b), (score, name) in best.items() if not any(x <= a and b <= y for x, y, _ in base)]
    if not found:
        return []
    places, before, points = sorted({x for f in found for x in (f[0], f[2])}), 0, {}
    count = 0
    for p in places:  # from bytes to code points
        count += len(data[before:p].decode("utf-8", "replace"))
        points[p], before = count, p
    return [(KINDS[k], points[a], points[b], name, score) for a, k, b, name, score in sorted(found, key=lambda f: f[:3])]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])


def _scanned(batches):
    for batch in batches:
        rows = []
        for x in batch.column(batch.num_columns - 1).cast(pa.binary()):
            text = x.as_py()
            rows.append([dict(zip(("kind", "start", "end", "name", "score"), s, strict=True)) for s in spans_of(text)] if text else [])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(_SPAN))], names=[*batch.schema.names[:-1], "secrets"])
    give_back()


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep``, and secrets: an array of (kind, start, end, name, score) of every whole text.

    Places are in code points, end exclusive; spans are sorted by start, then kind.

    * assign, access and hex are fixed patterns, leftmost and non-overlapping per kind.
    * literal spans come from lexing: source and configuration text is read as
      assignments (``name = "x"``, ``"name": "x"``, ``name: x``, ``name := a + "y"``),
      names that were assigned before stand for their literals, and a literal is told
      if the weight of the most sensitive name that holds it, times its own weight, is
      at least ENOUGH. Parts of a joined value are weighed together and told each.
      What lies within a fixed span is not told again.

    A null or empty text has none; repeated rows are scanned each; an empty table gives
    no rows. One pass without a shuffle: a task holds one batch, and of a very long
    text no more than a few copies. A joined value counts with its first PARTS literals.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(text_col).cast("string").alias("_text"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    small_batches(docs.sparkSession)
    return given.mapInArrow(_scanned, f"{ddl}, secrets array<struct<kind: string, start: bigint, end: bigint, name: string, score: double>>")


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of a secret_scan."""
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = joined_spans(F.filter("secrets", lambda s: s["kind"] != KINDS[3]))
    return scanned.select("doc_id", *(of(k) for k in KINDS[:3]), F.sha2(base, 256).alias("base_sha256"), joined_spans(F.col("secrets")).alias("spans"))
