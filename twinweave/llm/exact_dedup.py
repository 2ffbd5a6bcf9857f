"""Exact dedup with an extendible-hash index on shared files."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.runtime import drop_table, materialise_at, small_batches

#: Deleted before texts are compared: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"
#: Deepest directory: 2 ** GLOBAL_DEPTH entries, a proven bound for its broadcast.
GLOBAL_DEPTH = 16
LEAST_CAPACITY = 64

_LOCAL = pa.schema(
    [
        ("pid", pa.int32()), ("slot", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()),
        ("key", pa.int64()), ("sha", pa.string()), ("copies", pa.int64()), ("chars", pa.int64()),
        ("body", pa.binary()),
    ]
)
_LOCAL_DDL = "pid int, slot long, row long, doc_id long, key long, sha string, copies long, chars long, body binary"
_INDEX = pa.schema(
    [
        ("pid", pa.int32()), ("slot", pa.int64()), ("gpid", pa.int32()), ("gslot", pa.int64()),
        ("bucket", pa.int32()), ("sha", pa.string()), ("copies", pa.int64()), ("chars", pa.int64()),
        ("row", pa.int64()), ("doc_id", pa.int64()),
    ]
)
_INDEX_DDL = "pid int, slot long, gpid int, gslot long, bucket int, sha string, copies long, chars long, row long, doc_id long"


def _local_slots(budget: int):
    """Per partition: a slot for each distinct text; entries carry the text once."""

    def run(batches):
        pid, slots, entries, held, slot, row = TaskContext.get().partitionId(), {}, {}, 0, 0, 0

        def flush():
            out = [(pid, s, e[3], e[2], e[0], e[1], e[4], e[5], e[6]) for s, e in entries.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _LOCAL, strict=True)], schema=_LOCAL)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1)
            lengths = pa.compute.utf8_length(texts).to_pylist()
            docs: tuple[list, list, list] = ([], [], [])
            for doc_id, raw, chars in zip(ids, texts.cast(pa.binary()).to_pylist(), lengths, strict=True):
                body, chars = (raw or b"").translate(None, SPACES), chars or 0
                digest = hashlib.sha256(body).digest()
                at = slots.get(digest)
                if at is not None and entries[at][6] != body:
                    at = None  # another text with this digest: a slot of its own
                if at is None:
                    at, slot = slot, slot + 1
                    slots[digest] = at
                    entries[at] = [int.from_bytes(digest[:8], "big", signed=True), digest.hex(), doc_id, row, 1, chars, body]
                    held += len(body) + 400
                else:
                    e = entries[at]
                    e[4] += 1
                    if (-chars, doc_id is None, doc_id or 0, row) < (-e[5], e[2] is None, e[2] or 0, e[3]):
                        e[2], e[3], e[5] = doc_id, row, chars
                docs[0].append(at)
                docs[1].append(row)
                docs[2].append(doc_id)
                row += 1
            n = len(ids)
            if n:
                nothing = [pa.nulls(n, t.type) for t in _LOCAL]
                yield pa.RecordBatch.from_arrays([pa.array([pid] * n, pa.int32()), pa.array(docs[0], pa.int64()), pa.array(docs[1], pa.int64()), pa.array(docs[2], pa.int64()), *nothing[4:]], schema=_LOCAL)
            if held > budget:
                yield flush()
                slots, entries, held = {}, {}, 0
        if entries:
            yield flush()

    return run


def directory(counts: dict[int, int], capacity: int, depth: int = GLOBAL_DEPTH) -> list[tuple[int, int]]:
    """(prefix, bucket) for every prefix of ``depth`` bits.

    Starts with one bucket of local depth 0 and doubles: a bucket that holds more
    than ``capacity`` entries splits on its next bit until it fits or no bits are
    left. ``counts`` has the entries by prefix.
    """
    total = [0] * ((1 << depth) + 1)
    for i in range(1 << depth):
        total[i + 1] = total[i] + counts.get(i, 0)
    out, stack, bucket = [], [(0, 1 << depth)], 0
    while stack:
        low, high = stack.pop()
        if total[high] - total[low] > capacity and high - low > 1:
            mid = (low + high) // 2
            stack += [(mid, high), (low, mid)]
        else:
            out += [(p, bucket) for p in range(low, high)]
            bucket += 1
    return out


def _chain(batches):
    """Owner of whole buckets, sorted by key: chains entries of a key, comparing bytes."""
    key, chain = None, []
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in ("pid", "slot", "key", "body")}
        heads = []
        for pid, slot, k, body in zip(cols["pid"], cols["slot"], cols["key"], cols["body"], strict=True):
            if k != key:
                key, chain = k, []
            for head, other in chain:
                if other == body:
                    break
            else:
                head = (pid, slot)
                chain.append((head, body))
            heads.append(head)
        if heads:
            column = {n: batch.column(n) for n in ("pid", "slot", "bucket", "sha", "copies", "chars", "row", "doc_id")}
            column |= {"gpid": pa.array([h[0] for h in heads], pa.int32()), "gslot": pa.array([h[1] for h in heads], pa.int64())}
            yield pa.RecordBatch.from_arrays([column[t.name].cast(t.type) for t in _INDEX], schema=_INDEX)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 24 << 20) -> DataFrame:
    """One row per input row with the row of its group that stays.

    Texts are equal when identical after SPACES are deleted; a null text counts
    as empty. The longest original (code points) stays, then the least id (null
    last); of rows that agree in both, the first read. Columns: doc_id, keep_id,
    group_size, kept, text_sha256. An empty table gives no rows; other columns of
    ``docs`` are not read, so their names can't clash.

    Every map task first keeps one copy of each text it meets (``budget`` bytes at
    a time), so a group of any size sends at most a few entries per task. The
    entries are spread over buckets by an extendible-hash directory on the first
    64 bits of the digest; owner tasks take whole buckets in key order and compare
    bytes along each key's chain, holding one chain at a time.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    local, local_path = materialise_at(source.mapInArrow(_local_slots(budget), _LOCAL_DDL), "exact-local")
    entries = local.where("key is not null").withColumn("prefix", F.shiftrightunsigned("key", 64 - GLOBAL_DEPTH).cast("int"))
    counts = {r.prefix: r["count"] for r in entries.groupBy("prefix").count().collect()}  # at most 2 ** GLOBAL_DEPTH rows
    capacity = max(LEAST_CAPACITY, sum(counts.values()) >> (GLOBAL_DEPTH - 3))
    pages = spark.createDataFrame(directory(counts, capacity), "prefix int, bucket int")
    owned = entries.join(F.broadcast(pages), "prefix").repartition("bucket").sortWithinPartitions("bucket", "key", "pid", "slot")
    index, _ = materialise_at(owned.select("pid", "slot", "key", "bucket", "sha", "copies", "chars", "row", "doc_id", "body").mapInArrow(_chain, _INDEX_DDL), "exact-index")
    rows, _ = materialise_at(local.where("key is null").select("pid", "slot", "row", "doc_id"), "exact-rows")
    drop_table(spark, local_path)
    best = F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("pid").alias("p"), F.col("row").alias("r"))
    groups = index.groupBy("gpid", "gslot").agg(F.sum("copies").alias("group_size"), F.min(best).alias("best"))
    slots = index.select("pid", "slot", "gpid", "gslot", "sha").join(groups, ["gpid", "gslot"])
    return rows.join(slots, ["pid", "slot"]).select(
        "doc_id", F.col("best.d").alias("keep_id"), "group_size",
        ((F.col("pid") == F.col("best.p")) & (F.col("row") == F.col("best.r"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
