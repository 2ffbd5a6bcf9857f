"""Vector functions: Column expressions, and block products for whole grids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.runtime import small_batches

EPSILON = 1e-12
#: Vectors of one side that are compared with as many of the other at once.
BLOCK = 1_024
#: Vectors of one side that a task holds, at least; more of few components, up to ROOM numbers.
WIDE, ROOM = 8_192, 1 << 22
#: Bins of a histogram of distances, and distances that may be read.
BINS = 4_096
READ = 100_000


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))


def l2_normalize(x: Column) -> Column:
    """x over its norm, at least EPSILON; a zero vector stays zero."""
    return F.transform(x, lambda v: v / F.greatest(norm(x), F.lit(EPSILON)))


def relation_cosine(x: Column, y: Column) -> Column:
    """Cosine, null where a vector is missing or has no length."""
    return F.when((norm(x) > 0) & (norm(y) > 0), dot(x, y) / (norm(x) * norm(y)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bce_with_logits(x: Column, y: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def one_hot(index: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.when(k == index, 1.0).otherwise(0.0))


def exploded(df: DataFrame, *ids: str, vec: str = "vec") -> DataFrame:
    """ids, pos, value of every component."""
    return df.select(*ids, F.posexplode(vec).alias("pos", "value"))


def mean_pool(df: DataFrame, by: list[str], vec: str = "vec") -> DataFrame:
    """by, pos, value: the mean of a group's vectors."""
    return exploded(df, *by, vec=vec).groupBy(*by, "pos").agg(F.avg("value").alias("value"))


def gathered(df: DataFrame, by: list[str]) -> DataFrame:
    """by, vec from exploded components; a vector's components are one group."""
    return df.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("vec"))


def blob(x: np.ndarray, kind=None) -> bytes:
    """An array's bytes; without ``kind`` numbers are kept as floats of four bytes where that loses nothing, with a mark before."""
    if kind is not None:
        return np.ascontiguousarray(x, kind).tobytes()
    with np.errstate(over="ignore", invalid="ignore"):
        short = np.ascontiguousarray(x, np.float32)
    return b"4" + short.tobytes() if np.array_equal(short, x, equal_nan=True) else b"8" + np.ascontiguousarray(x, float).tobytes()


def unblob(x: bytes, rows: int) -> np.ndarray:
    """The matrix of ``rows`` rows that blob() took."""
    return np.frombuffer(x, np.float32 if x[:1] == b"4" else float, offset=1).astype(float).reshape(rows, -1)


def shares(n: int, dim: int | None = None) -> int:
    """In how many blocks a side of a grid of pairs lies: every vector is sent to each block of the other side, so no more than tasks are wanted or memory asks for."""
    wide = max(WIDE, ROOM // max(1, dim)) if dim is not None else WIDE
    return max(1, -(-n // wide), min(16, -(-n // 256)))


def grid(left: DataFrame, right: DataFrame, across: int, down: int, half: bool = False) -> DataFrame:
    """left(p, ...) and right(q, ...), one row for each block, as the rows of all p below ``across`` and q below ``down``; with ``half``, of p up to q only."""
    every = lambda low, n: F.explode(F.sequence(low, F.lit(n - 1).cast("long")))
    first = F.lit(0).cast("long")
    beyond = F.explode(F.sequence(first, F.col("q"))) if half else every(first, across)
    return left.withColumn("q", every(F.col("p") if half else first, down)).join(right.withColumn("p", beyond), ["p", "q"])


def _packed(rows: pa.Table) -> pa.Table:
    """A block as one row: its ids and its matrix."""
    vec = rows.column("vec").combine_chunks()
    m = np.asarray(vec.flatten()).reshape(rows.num_rows, -1)
    return pa.table({"own": rows.column("own").slice(0, 1), "ids": pa.array([blob(np.asarray(rows.column("idx")), np.int64)], pa.binary()), "vec": pa.array([blob(m)], pa.binary())})


def block_pairs(left: DataFrame, right: DataFrame | None, work, schema: str) -> DataFrame:
    """Rows of work(left ids, left matrix, right ids, right matrix) for every block of left(idx, vec) with every one of right.

    The grid is inherent to what compares all pairs. Vectors lie in blocks of up to
    about WIDE, or ROOM numbers, each a row that goes to the tasks that need it, so a
    vector is sent once per block of the other side. A task holds two blocks, compares
    BLOCK vectors with BLOCK at a time and passes on what it finds before the next;
    neither side passes through the driver.

    Without right, left meets itself: two different blocks meet once, and work's fifth
    argument says for how many meetings its result stands, 2 for them and 1 for a block
    with itself, where every pair comes both ways.
    """
    small_batches(left.sparkSession)
    half = right is None
    sizes = [df.agg(F.count("*"), F.max(F.size("vec"))).first() for df in ((left,) if half else (left, right))]
    across, down = shares(*sizes[0]), shares(*sizes[-1])
    right = left if half else right

    def packed(df, n, name):
        own = F.pmod(F.xxhash64("idx"), F.lit(n))
        rows = df.select(F.col("idx").cast("long").alias("idx"), F.col("vec").cast("array<double>").alias("vec")).withColumn("own", own)
        return rows.groupBy("own").applyInArrow(_packed, "own long, ids binary, vec binary").select(F.col("own").alias(name), F.col("ids").alias(f"ids_{name}"), F.col("vec").alias(f"vec_{name}"))

    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, x, others, y, *stands = (batch.column(k)[row].as_py() for k in range(batch.num_columns))
                ids, others = np.frombuffer(ids, np.int64), np.frombuffer(others, np.int64)
                x, y = unblob(x, len(ids)), unblob(y, len(others))
                for i in range(0, len(ids), BLOCK):
                    for j in range(0, len(others), BLOCK):
                        found = work(ids[i : i + BLOCK], x[i : i + BLOCK], others[j : j + BLOCK], y[j : j + BLOCK], *stands)
                        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[f[1]]) for c, f in zip(found, fields, strict=True)], names=[f[0] for f in fields])

    met = grid(packed(left, across, "p"), packed(right, down, "q"), across, down, half)
    stands = [F.when(F.col("p") == F.col("q"), 1).otherwise(2).alias("stands")] if half else []
    return met.select("ids_p", "vec_p", "ids_q", "vec_q", *stands).mapInArrow(run, schema)


def similarity_pairs(left: DataFrame, right: DataFrame, threshold: float | None = None, digits: int | None = None) -> DataFrame:
    """i, a, sim for all pairs of left(idx, vec) and right(idx, vec), or those at the threshold.

    Pairs are made block by block as matrix products, and the threshold is applied
    before a row is built.
    """
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), EPSILON)

    def work(ids, x, others, y):
        sim = unit(x) @ unit(y).T
        if digits is not None:
            sim = np.round(sim, digits)
        r, c = np.nonzero(~(sim < threshold)) if threshold is not None else np.indices(sim.shape).reshape(2, -1)
        return ids[r], others[c], sim[r, c]

    return block_pairs(left, right, work, "i long, a long, sim double")


def best_pairs(left: DataFrame, right: DataFrame, digits: int | None = None) -> DataFrame:
    """side (0 left, 1 right), idx, best: the highest cosine of every vector with one of the other side; maxima leave the tasks, not pairs."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), EPSILON)

    def work(ids, x, others, y):
        sim = unit(x) @ unit(y).T
        if digits is not None:
            sim = np.round(sim, digits)
        side = np.repeat([0, 1], [len(ids), len(others)])
        return side, np.concatenate([ids, others]), np.concatenate([sim.max(axis=1), sim.max(axis=0)])

    return block_pairs(left, right, work, "side long, idx long, best double").groupBy("side", "idx").agg(F.max("best").alias("best"))


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T, 0)


def kernel_mean(x: DataFrame, y: DataFrame, gamma: float, same: bool) -> DataFrame:
    """One row, value: the mean Gaussian kernel of pairs; off the diagonal (by idx) for the same side, 0 for up to one vector."""

    def work(ids, a, others, b, stands=1):
        kernel = np.exp(-gamma * _squared(a, b))
        total, n = float(kernel.sum()), kernel.size
        if same:
            one = ids[:, None] == others[None, :] if stands == 1 else np.zeros(0, bool)  # no id lies in two blocks
            total, n = (total - float(kernel[one].sum()), n - int(one.sum())) if one.any() else (total, n)
        return [stands * total], [stands * n]

    sums = block_pairs(x, None if same else y, work, "total double, n long")
    return sums.agg(F.coalesce(F.sum("total") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("value"))


def lower_median_distance(vectors: DataFrame) -> float | None:
    """The lower median of the distances of all ordered pairs of different idx; none if there is no pair.

    A histogram of BINS bins is narrowed to the bin that holds the middle until it
    holds few enough distances to be read, so no list of all distances is made.
    """
    largest = vectors.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))).first()[0]
    if largest is None:
        return None
    chosen: list[tuple[float, float, int]] = []  # ranges so far, and the bin taken of each
    low, high, middle = 0.0, 2 * largest**0.5 + 1e-9, None
    finest = 1e-12 * high

    def bin_of(d, low, high):
        return np.minimum(((d - low) * (BINS / (high - low))).astype(np.int64), BINS - 1)

    def inside(a, b, ids, others, chosen, stands):
        d = np.sqrt(_squared(a, b))
        d = d[ids[:, None] != others[None, :]] if stands == 1 else d.ravel()  # no id lies in two blocks
        for low, high, at in chosen:  # the same arithmetic as when it was chosen, so that no distance is lost at an edge
            d = d[bin_of(d, low, high) == at]
        return d

    while True:

        def work(ids, a, others, b, stands, low=low, high=high, chosen=tuple(chosen)):
            counts = stands * np.bincount(bin_of(inside(a, b, ids, others, chosen, stands), low, high), minlength=BINS)
            at = np.flatnonzero(counts)
            return at, counts[at]

        bins = sorted(map(tuple, block_pairs(vectors, None, work, "at long, n long").groupBy("at").agg(F.sum("n")).collect()))  # at most BINS rows
        if not bins:
            return None
        middle = (sum(n for _, n in bins) + 1) // 2 if middle is None else middle  # how many of this range come up to the median
        for at, n in bins:
            if middle <= n:
                break
            middle -= n
        chosen.append((low, high, at))
        width = (high - low) / BINS
        low, high = low + at * width, low + (at + 1) * width
        if n > READ and width <= finest:
            return low  # so many equal distances, to the last digits
        if n <= READ:

            def read(ids, a, others, b, stands, chosen=tuple(chosen)):
                return [np.repeat(inside(a, b, ids, others, chosen, stands), stands)]

            return float(sorted(r.d for r in block_pairs(vectors, None, read, "d double").collect())[middle - 1])


def mmd(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row, mmd: squared maximum mean discrepancy with a median bandwidth.

    The bandwidth is the lower median of the pooled off-diagonal distances, 1 if
    that isn't positive. An empty side gives 0. Pairs are compared block by block
    and only sums leave the tasks.
    """
    spark = x.sparkSession
    if x.isEmpty() or y.isEmpty():
        return spark.createDataFrame([(0.0,)], "mmd double")
    pooled = x.select((2 * F.col("idx")).alias("idx"), "vec").unionByName(y.select((2 * F.col("idx") + 1).alias("idx"), "vec"))
    median = lower_median_distance(pooled)
    sigma = median if median and median > 0 else 1.0
    gamma = 1 / (2 * sigma * sigma)
    parts = kernel_mean(x, x, gamma, True).select(F.col("value").alias("xx")).join(kernel_mean(y, y, gamma, True).select(F.col("value").alias("yy"))).join(kernel_mean(x, y, gamma, False).select(F.col("value").alias("xy")))
    return parts.select((F.col("xx") + F.col("yy") - 2 * F.col("xy")).alias("mmd"))


def moment_alignment(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row, loss: mean over components of squared differences of mean and deviation."""
    side = lambda d, s: exploded(d).groupBy("pos").agg(F.avg("value").alias(f"m{s}"), F.sqrt(F.var_pop("value") + 1e-6).alias(f"d{s}"))
    return side(x, "x").join(side(y, "y"), "pos").agg(F.avg(F.pow(F.col("mx") - F.col("my"), 2) + F.pow(F.col("dx") - F.col("dy"), 2)).alias("loss"))
