"""Mixing sources to target weights by Sainte-Laguë apportionment."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinweave.runtime import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARDS = 256
#: Rows of one cell of a shard, on average; a shard's cells are summed before rows meet.
CELL_ROWS = 256


def apportion(weights, seats: int) -> np.ndarray:
    """Seats by highest quotients weight / (2 k + 1); ties go to the earlier entry.

    Rounding by a common divisor gives all but a few seats; the last ones are
    given or taken one by one in quotient order, which yields the same result.
    """
    w = np.asarray(weights, float)
    total = w.sum()
    got = np.zeros(len(w), np.int64)
    if seats <= 0 or total <= 0:
        return got
    got = np.maximum(np.ceil(w * (seats / total) - 0.5), 0).astype(np.int64)
    gap = seats - int(got.sum())
    if gap > 0:
        heap = [(-w[i] / (2 * got[i] + 1), i) for i in range(len(w)) if w[i] > 0]
        heapq.heapify(heap)
        for _ in range(gap):
            _, i = heap[0]
            got[i] += 1
            heapq.heapreplace(heap, (-w[i] / (2 * got[i] + 1), i))
    elif gap < 0:
        heap = [(w[i] / (2 * got[i] - 1), -i) for i in range(len(w)) if got[i] > 0]
        heapq.heapify(heap)
        for _ in range(-gap):
            _, i = heapq.heappop(heap)
            got[-i] -= 1
            if got[-i] > 0:
                heapq.heappush(heap, (w[-i] / (2 * got[-i] - 1), i))
    return got


def bounded(weights, seats: int, most) -> np.ndarray:
    """As apportion, but no entry gets more than its ``most`` seats; the others get what it can't hold."""
    w, most = np.asarray(weights, float), np.asarray(most, np.int64)
    got, open_ = np.zeros(len(w), np.int64), w > 0
    while open_.any():
        part = np.zeros(len(w), np.int64)
        part[open_] = apportion(w[open_], seats - int(got[~open_].sum()))
        full = open_ & (part >= most)
        if not (part > most).any():
            got[open_] = part[open_]
            break
        got[full] = most[full]
        open_ &= ~full
    return got


def shard_words(sizes, blocks: int, block: int, cap: int) -> np.ndarray:
    """Words that each shard gives when ``blocks`` blocks are dealt by size and none gives more than cap times its words.

    A shard's last block may be cut by its cap; what that leaves is dealt on in
    whole blocks, so less than one block is short unless all shards are full.
    """
    sizes = np.asarray(sizes, np.int64)
    room = cap * sizes
    want, seats = min(blocks * block, int(room.sum())), blocks
    while True:
        words = np.minimum(bounded(sizes, seats, -(-room // block)) * block, room)
        short = want - int(words.sum())
        if short < block:
            return words
        seats += short // block


def targets(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Shares of the total by weight, at most cap * size each, the excess reshared by weight."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        level = (total - sum(out[i] for i in range(len(sizes)) if i not in open_)) / sum(weights[i] for i in open_)
        above = [i for i in open_ if level * weights[i] > cap * sizes[i]]
        for i in open_ if not above else above:
            out[i] = float(cap * sizes[i]) if above else level * weights[i]
        open_ = open_ - set(above) if above else set()
    return out


def _carried(rows: pd.DataFrame) -> pd.DataFrame:
    """Whether the document that ends each shard's quota is taken; at most SHARDS rows."""
    rows, carry, up = rows.sort_values("shard"), 0, []
    for part, size in zip(rows.part.tolist(), rows["size"].tolist(), strict=True):
        carry += part
        up.append(2 * carry >= size)
        carry -= size if up[-1] else 0
    return rows.assign(up=up)[["src", "shard", "up"]]


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = 3, block: int = 8, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", whole: bool = False, row_cols: tuple[str, ...] = ()) -> DataFrame:
    """How many words of every document a mix of the sources takes.

    Returns doc_id, size, source_size, target, taken. Size counts WORD in the text
    (null: 0). Sources in code point order, null last, weigh ``weights`` in turn
    and share all words; a target stops at ``cap`` times its source's size.
    ``block`` words make a block. Sainte-Laguë gives blocks to sources by target,
    then to each source's shards by size, none more than ``cap`` times its words (what
    one can't hold goes to the next quotients), so a source's words come within one
    block of its apportioned blocks. A shard's documents lie in seeded order; its
    blocks are taken from the start, again and again if the quota exceeds the shard,
    so no document gives more than ``cap`` times its words. Reruns agree: the order
    is a hash of seed and id (without id, of the text); ties go by id and size.
    Repeated rows share the words in turn. An empty table gives no rows; other
    columns are not read.

    With ``row_cols``, those columns (numbers that rows alike in everything share) are
    returned in place of doc_id, and order rows alike in id and size. With
    ``whole``, documents are taken whole only. At most one document of a shard
    is taken in part; its part is carried along the source's shards in turn, and the
    document is taken where that reaches half of it, so a source's total differs
    from the one above by at most half of its longest document.

    The source totals (a row per source: the mix's own settings table) are the only
    rows the driver sees. Words are summed by cells of about CELL_ROWS rows before
    documents are ordered, and cells are summed along a shard, so neither a hot
    source nor a large table puts many rows in one group.
    """
    spark = docs.sparkSession
    key = [f"row_{i}" for i in range(len(row_cols))]
    sized = materialise(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.when(F.col(id_col).isNull(), F.col(text_col).cast("string"))).alias("h"), *[F.col(c).cast("long").alias(k) for c, k in zip(row_cols, key, strict=True)],
        ), "mix-sized",
    )
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], cap)
    blocks = apportion(goal, -(-sum(sizes) // block))
    cells = max(1, sum(r.n for r in found) // (SHARDS * CELL_ROWS))
    sources = spark.createDataFrame([(i, r.source, r["size"], goal[i], int(blocks[i])) for i, r in enumerate(found)], "src int, source string, source_size long, target double, blocks long")
    keyed = (
        sized.join(F.broadcast(sources.select("src", "source")) if len(found) <= 100_000 else sources.select("src", "source"), sized.source.eqNullSafe(sources.source))
        .select("doc_id", *key, "size", "h", "src", F.pmod("h", F.lit(SHARDS)).cast("int").alias("shard"), F.pmod(F.shiftrightunsigned("h", 20), F.lit(cells)).alias("cell"))
    )
    by_cell = keyed.groupBy("src", "shard", "cell").agg(F.sum("size").alias("cell_size"))
    along = Window.partitionBy("src", "shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = by_cell.select("src", "shard", "cell", "cell_size", F.coalesce(F.sum("cell_size").over(along), F.lit(0)).alias("cell_start"))
    by_shard = by_cell.groupBy("src", "shard").agg(F.sum("cell_size").alias("shard_size")).join(sources.drop("source"), "src")

    def quotas(rows: pd.DataFrame) -> pd.DataFrame:  # at most SHARDS rows
        rows = rows.sort_values("shard")
        rows["words"] = shard_words(rows.shard_size.to_numpy(), int(rows.blocks.iloc[0]), block, cap)
        return rows[["src", "shard", "shard_size", "source_size", "target", "words"]]

    shares = by_shard.groupBy("src").applyInPandas(quotas, "src int, shard int, shard_size long, source_size long, target double, words long")
    cell_plan = placed.join(shares, ["src", "shard"])
    inside = Window.partitionBy("src", "shard", "cell").orderBy("h", "doc_id", "size", *key).rowsBetween(Window.unboundedPreceding, -1)
    lined = keyed.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(cell_plan, ["src", "shard", "cell"])
    rounds, rest = F.expr("words div greatest(shard_size, 1)"), F.expr("words % greatest(shard_size, 1)")
    part = F.least(F.greatest(rest - F.col("cell_start") - F.col("start"), F.lit(0)), F.col("size"))
    lined = lined.select("src", "shard", "doc_id", *key, "size", "source_size", "target", (rounds * F.col("size")).alias("again"), part.alias("part"))
    if whole:
        lined = materialise(lined, "mix-lined")
        ends = lined.where("part > 0 and part < size").select("src", "shard", "part", "size").groupBy("src").applyInPandas(_carried, "src int, shard int, up boolean")
        lined = lined.join(ends, ["src", "shard"], "left").withColumn("part", F.when(F.col("part") < F.col("size"), F.when(F.col("part") > 0, F.when(F.col("up"), F.col("size")).otherwise(0)).otherwise(0)).otherwise(F.col("part")))
    return lined.select(*([F.col(k).alias(c) for c, k in zip(row_cols, key, strict=True)] or ["doc_id"]), "size", "source_size", "target", (F.col("again") + F.col("part")).cast("long").alias("taken"))
