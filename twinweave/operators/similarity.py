"""An exact similarity join over a threshold: pivots, triangle-inequality pruning of blocks, then of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.functions.vectors import EPSILON, blob, grid, shares, similarity_pairs, unblob
from twinweave.operators.numbering import numbered, summed_before
from twinweave.runtime import drop_table, materialise_at, small_batches

#: Vectors of a block.
BLOCK = 1_024
#: Pivots at most: they, and a block's angles to them, bound what is broadcast and kept per block.
PIVOTS = 256
#: Vectors that pivots are chosen from, a side.
SAMPLE = 2_048
#: Rows of other blocks that a block is compared with at once.
STRETCH = 1_024
#: Angles are held this much wider than they are, for the rounding of their parts.
SLACK = 1e-6


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), EPSILON)


def choose_pivots(x: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` unit vectors of x that lie far from each other: each next one is the farthest from all before."""
    x = _unit(x)
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(most, len(x)):
        far = int(nearest.argmin())
        if nearest[far] > 1 - 1e-9:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, x @ x[far])
    return x[chosen]


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(x) @ pivots.T, -1, 1))


def _angled(pivots):
    """side, idx, vec, home (nearest pivot) and away (angle to it)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            angles = _angles(_rows(batch.column(2)), pivots.value)
            home = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int64)), pa.array(angles[np.arange(len(home)), home])], names=["side", "idx", "vec", "home", "away"])

    return run


def _grouped(pivots):
    """A group of blocks as one row: its blocks' names, first rows, least and largest angles to all pivots, and its rows block by block."""

    def run(rows: pa.Table) -> pa.Table:
        block, ids = np.asarray(rows.column("block")), np.asarray(rows.column("idx"))
        by = np.lexsort((ids, block))
        x = _rows(rows.column("vec").combine_chunks())[by]
        names, first = np.unique(block[by], return_index=True)
        low, high = (np.empty((len(names), len(pivots.value))) for _ in range(2))
        for k, (a, b) in enumerate(zip(first, [*first[1:], len(by)], strict=True)):
            angles = _angles(x[a:b], pivots.value)
            low[k], high[k] = angles.min(axis=0), angles.max(axis=0)
        found = {"block": blob(names, np.int64), "first": blob(first, np.int64), "low": blob(low, float), "high": blob(high, float), "ids": blob(ids[by], np.int64), "vec": blob(x)}
        return pa.table({"side": rows.column("side").slice(0, 1), "part": rows.column("part").slice(0, 1)} | {k: pa.array([v], pa.binary()) for k, v in found.items()})

    return run


GROUP = ("block", "first", "low", "high", "ids", "vec")


class _Group:
    """A row of _grouped."""

    def __init__(self, values: list[bytes]):
        self.block, self.first, self.ids = (np.frombuffer(values[k], np.int64) for k in (0, 1, 4))
        self.low, self.high = (np.frombuffer(values[k], float).reshape(len(self.block), -1) for k in (2, 3))
        self.x, self.end = values[5], [*self.first[1:], len(self.ids)]

    def unpacked(self) -> _Group:
        if isinstance(self.x, bytes):
            self.x = _unit(unblob(self.x, len(self.ids)))
        return self


def _admissible(a: _Group, b: _Group, widest: float):
    """Of each block of a the blocks of b that some pair of vectors within the angle may lie in."""
    for k in range(len(a.block)):
        gap = np.maximum(a.low[k] - b.high, b.low - a.high[k]).max(axis=1)
        yield k, np.flatnonzero(gap <= widest + SLACK)


def _pairs_of(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            values = [batch.column(k)[row].as_py() for k in range(2 * len(GROUP))]
            yield _Group(values[: len(GROUP)]), _Group(values[len(GROUP) :])


def _named(widest: float):
    def run(batches):
        for a, b in _pairs_of(batches):
            for k, met in _admissible(a, b, widest):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), a.block[k])), pa.array(b.block[met])], names=["p", "q"])

    return run


class Plan:
    """Blocks of both sides and the pairs of them that can hold a pair over the threshold."""

    def __init__(self, left: DataFrame, right: DataFrame, threshold: float, digits: int | None = None, block: int | None = None):
        self.spark, self.digits, self.threshold = left.sparkSession, digits, threshold
        block = block or BLOCK
        side = lambda df, name: df.where("idx is not null and vec is not null").select(F.lit(name).alias("side"), F.col("idx").cast("long").alias("idx"), F.col("vec").cast("array<double>").alias("vec"))
        both = side(left, "left").unionByName(side(right, "right"))
        # What rounds up to the threshold counts.
        least = threshold - (0.5 * 10.0**-digits if digits is not None else 0.0)
        self.widest = float(np.arccos(np.clip(least, -1, 1)))
        sample = [r.vec for s in ("left", "right") for r in both.where(F.col("side") == s).orderBy(F.xxhash64("idx"), "idx").limit(SAMPLE).collect()]
        pivots = choose_pivots(np.array(sample, float), max(1, min(PIVOTS, both.count() // (2 * block)))) if sample else np.zeros((0, 0))
        self.paths: list[str] = []
        if not len(pivots):
            self.blocks = self.pairs = None
            return
        small_batches(self.spark)
        shared = self.spark.sparkContext.broadcast(pivots)
        angled = both.mapInArrow(_angled(shared), "side string, idx long, vec array<double>, home long, away double")
        # Blocks are stretches of a pivot's vectors in the order of their angle: a pivot with very many has many rings.
        placed = [numbered(angled.where(F.col("side") == s), ["away", "idx"], "n", partition="home") for s in ("left", "right")]
        placed = placed[0].unionByName(placed[1]).withColumn("block", F.expr(f"home + {PIVOTS} * (n div {block})"))
        self.blocks, path = materialise_at(placed.select("side", "block", "idx", "vec"), "blocks")
        self.paths.append(path)
        # Blocks next to each other lie in one group: what a task holds of a side.
        sizes = self.blocks.groupBy("side", "block").agg(F.count("*").alias("n")).withColumns({"home": F.expr(f"block % {PIVOTS}"), "ring": F.expr(f"block div {PIVOTS}")})
        parts, many = [], {}
        for s in ("left", "right"):
            before, path = summed_before(sizes.where(F.col("side") == s), ["home", "ring"], F.col("n"), "before")
            self.paths.append(path)
            total = self.blocks.where(F.col("side") == s).count()
            width = max(1, -(-total // shares(total)))
            parts.append(before.select("side", "block", F.expr(f"before div {width}").alias("part")))
            many[s] = (total - 1) // width + 1 if total else 0
        grouped = self.blocks.join(parts[0].unionByName(parts[1]), ["side", "block"]).groupBy("side", "part").applyInArrow(_grouped(shared), "side string, part long, " + ", ".join(f"{c} binary" for c in GROUP))
        groups, path = materialise_at(grouped, "block-groups")
        self.paths.append(path)
        named = lambda s, key: groups.where(F.col("side") == s).select(F.col("part").alias(key), *(F.col(c).alias(f"{c}_{key}") for c in GROUP))
        met = grid(named("left", "p"), named("right", "q"), max(1, many["left"]), max(1, many["right"]))
        self.met = met.select(*(f"{c}_{key}" for key in "pq" for c in GROUP))
        self.pairs = self.met.mapInArrow(_named(self.widest), "p long, q long")

    def rows(self) -> DataFrame:
        """i, a and sim of every pair over the threshold."""
        schema = "i long, a long, sim double"
        if self.pairs is None:
            return self.spark.createDataFrame([], schema)
        return self.met.mapInArrow(_compared(self.threshold, self.digits, self.widest), schema)

    def drop(self) -> None:
        for path in self.paths:
            drop_table(self.spark, path)


def close_pairs(x: np.ndarray, y: np.ndarray, least: float, head: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (r, c) of unit rows whose product may reach ``least``, by the first ``head`` components and the norms of the rest."""
    if head <= 0 or head >= x.shape[1]:
        return np.indices((len(x), len(y))).reshape(2, -1)
    rest = lambda m: np.linalg.norm(m[:, head:], axis=1)
    return np.nonzero(x[:, :head] @ y[:, :head].T + np.outer(rest(x), rest(y)) >= least - SLACK)


def _compared(threshold: float, digits: int | None, widest: float):
    """i, a and sim of two groups' pairs over the threshold: a block with up to STRETCH rows of the blocks it can meet at a time."""

    def over(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # Components in order of their weight, so that the first ones hold most of a vector.
        order = np.argsort(-((x**2).sum(axis=0) + (y**2).sum(axis=0)), kind="stable")
        r, c = close_pairs(x[:, order], y[:, order], np.cos(widest), x.shape[1] // 4)
        if 8 * len(r) >= len(x) * len(y):
            sim = x @ y.T
        else:  # few are left: only they are multiplied
            sim = np.full((len(x), len(y)), -np.inf)
            for at in range(0, len(r), 1 << 16):
                u, v = r[at : at + (1 << 16)], c[at : at + (1 << 16)]
                sim[u, v] = np.einsum("ij,ij->i", x[u], y[v])
        if digits is not None:
            sim = np.round(sim, digits)
        u, v = np.nonzero(sim >= threshold)
        return u, v, sim[u, v]

    def run(batches):
        for a, b in _pairs_of(batches):
            for k, met in _admissible(a, b, widest):
                if not len(met):
                    continue
                own = slice(a.first[k], a.end[k])
                rows = np.concatenate([np.arange(b.first[j], b.end[j]) for j in met])
                x, y = a.unpacked().x[own], b.unpacked().x
                for at in range(0, len(rows), STRETCH):
                    some = rows[at : at + STRETCH]
                    u, v, sim = over(x, y[some])
                    yield pa.RecordBatch.from_arrays([pa.array(a.ids[own][u]), pa.array(b.ids[some[v]]), pa.array(sim)], names=["i", "a", "sim"])

    return run


def threshold_pairs(left: DataFrame, right: DataFrame, threshold: float, digits: int | None = None) -> DataFrame:
    """i, a and sim of all pairs of left(idx, vec) and right(idx, vec) whose cosine, rounded to ``digits``, is at least the threshold.

    No pair is lost, ties at the threshold included; a vector without length has the
    cosine 0 with all. Rows with a null idx or vec, or an empty side, give nothing;
    repeated rows pair each. All vectors have one length.

    1. Up to PIVOTS unit vectors of a bounded sample that lie far from each other are
       pivots, as many as the sides fill blocks. Every vector has its angles to them.
    2. The vectors nearest to one pivot are cut into blocks of up to BLOCK in the order
       of their angle; a block keeps its least and largest angle to every pivot.
    3. Blocks next to each other form groups, each one row; a task holds a group of
       either side, so a vector is sent once per group of the other side.
    4. By the triangle inequality, two vectors are no closer than their angles to any
       pivot differ. So a task leaves out the pairs of blocks whose angle ranges to
       any pivot lie further apart than the threshold's angle.
    5. Of the pairs left, pairs leave by the first quarter of the heaviest components
       and the norms of the rest; what stays is compared in full.

    Where vectors have no structure at all, no block can be left out and the work is
    that of all pairs.
    """
    whole = [side.where("idx is not null and vec is not null").select("idx", "vec") for side in (left, right)]
    if all(side.count() <= BLOCK for side in whole):
        return similarity_pairs(*whole, threshold, digits)  # a block each: nothing can be left out
    return Plan(left, right, threshold, digits).rows()
