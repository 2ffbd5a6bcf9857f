"""Table-valued text functions: chunks, sentences, batches, aliases."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.operators.numbering import numbered


def chunks_of(text: str, limit: int = 3500) -> list[str]:
    """Chunks of up to ``limit`` code points, cut at a line end where one is late enough.

    The text is stripped first. A window that isn't the last ends before its last
    line feed if that lies over 100 characters in; chunks are stripped, blank ones
    dropped.
    """
    text, start, out = text.strip(), 0, []
    while start < len(text):
        end = min(start + limit, len(text))
        if end < len(text):
            line = text.rfind("\n", start, end)
            if line > start + 100:
                end = line
        piece = text[start:end].strip()
        if piece:
            out.append(piece)
        start = end
    return out


def chunk_text(docs: DataFrame, limit: int = 3500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pos (from 1), chunk; cuts depend on the cut before, so a text is walked in one place."""

    def run(batches):
        for batch in batches:
            rows = [(d, i, c) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, c in enumerate(chunks_of(t or "", limit), 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.string()), strict=True)], names=["doc_id", "pos", "chunk"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, pos int, chunk string")


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pos, sentence by a documented rule: cut after . ! or ? before white space."""
    marked = F.split(F.regexp_replace(text_col, r"([.!?])\s+", "$1\u0001"), "\u0001")
    stripped = F.filter(F.transform(marked, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(stripped).alias("pos", "sentence"))


def name_batches(names: DataFrame, size: int) -> DataFrame:
    """name, batch: sorted names in consecutive batches; one batch if size isn't positive."""
    if size <= 0:
        return names.select("name", F.lit(0).cast("long").alias("batch"))
    return numbered(names.select("name"), ["name"], "n").select("name", F.floor(F.col("n") / size).alias("batch"))


def alias_lookup(mappings: DataFrame) -> DataFrame:
    """key, canonical of mappings(pos, canonical, aliases): a later mapping, and a name after its aliases, wins."""
    from twinweave.functions.text import strip_lower

    names = mappings.select("pos", "canonical", F.posexplode(F.concat("aliases", F.array("canonical"))).alias("k", "alias"))
    keyed = names.withColumn("key", strip_lower(F.col("alias"))).where("key <> ''")
    return keyed.groupBy("key").agg(F.max_by("canonical", F.struct("pos", "k")).alias("canonical"))
