"""Exact top-k inner products by no-random-access aggregation of sorted lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinweave.runtime import drop_table, materialise_at

#: Candidates and queries of one task.
CANDIDATES = 8_192
QUERIES = 4_096
#: Queries whose bounds are kept side by side.
LANES = 128
#: Shares of a list that have been read after each step.
DEPTHS = (1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2, 9 / 16, 5 / 8, 11 / 16, 3 / 4, 7 / 8)
#: Entries at either end of a list whose rows give queries their first k scores, in so many lists.
HEAD = 16
HEAD_LISTS = 64
#: Below this sum of absolute products integers of 64 bits can't overflow.
SAFE = 1 << 62

_OUT = "query_id long, vec_id long, score long"


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products of rows with one query; beyond 64 bits they stop at the ends of a long."""
    if float(np.abs(x.astype(float)).max(axis=0, initial=0) @ np.abs(q.astype(float))) < SAFE:
        return x @ q
    return np.array([max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(row, q.tolist(), strict=True)))) for row in x.tolist()], np.int64)


def best_of(ids: np.ndarray, x: np.ndarray, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (-score, id) among rows that aren't the query's own, ties to the smaller id."""
    own = ids != query_id
    return sorted(zip((-scores(x[own], q)).tolist() if own.any() else [], ids[own].tolist(), strict=True))[:k]


def no_random_access(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray, edges: tuple[np.ndarray, np.ndarray]):
    """(query position, its k best here, share of its lists read) of every query.

    ``edges``: values of all components' table-wide lists after each step, read from
    the top and from the bottom (steps x components). A query reads a list from the
    end that suits its sign; an unread entry counts as the list's current value, so
    a candidate's upper bound is the product with its row raised (or lowered) to
    these values. ``floor`` is a score that k rows of the table reach. Candidates
    whose upper bound is below it leave; once the bound of rows seen nowhere is
    below it too and few remain, their scores are resolved. Bounds are widened by
    more than the products' rounding, which goes with the sum of absolute products.
    """
    xf = x.astype(float)
    for a in range(0, len(q), LANES):
        lanes = np.arange(a, min(a + LANES, len(q)))
        up, down = np.maximum(q[lanes], 0).astype(float), np.minimum(q[lanes], 0).astype(float)
        widest = np.abs(xf).max(axis=0, initial=0)
        for step, (high, low) in enumerate(zip(*edges, strict=True)):
            size = (np.maximum(widest, np.abs(high)) * up - np.maximum(widest, np.abs(low)) * down).sum(axis=1)
            bar = floor[lanes] - (q.shape[1] + 4) * 2.0**-51 * size
            can = up @ np.maximum(xf, high).T + down @ np.minimum(xf, low).T >= bar[:, None]
            ready = (can.sum(axis=1) <= max(4 * k, len(x) // 16)) & (up @ high + down @ low < bar)
            for j in np.flatnonzero(ready).tolist():
                at = np.flatnonzero(can[j])
                yield int(lanes[j]), best_of(ids[at], x[at], int(query_ids[lanes[j]]), q[lanes[j]], k), DEPTHS[step]
            lanes, up, down = lanes[~ready], up[~ready], down[~ready]
            if not len(lanes):
                break
        for i in lanes.tolist():  # read to the end
            yield i, best_of(ids, x, int(query_ids[i]), q[i], k), 1.0


def _rows(table) -> tuple[np.ndarray, np.ndarray]:
    ids = np.asarray(table.column("vec_id"), np.int64)
    column = table.column("x")
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return ids, np.asarray(flat.flatten(), np.int64).reshape(len(ids), -1)


def _ends(batches):
    """list, value, vec_id of the first HEAD entries of this task's part of each list, from both ends."""
    held = None
    for batch in batches:
        if batch.num_rows:
            ids, x = _rows(batch)
            x = x[:, :HEAD_LISTS]
            if held is not None:
                ids, x = np.concatenate([held[0], ids]), np.concatenate([held[1], x])
            order = np.argsort(x, axis=0, kind="stable")
            keep = np.unique(np.concatenate([order[:HEAD].ravel(), order[-HEAD:].ravel()]))
            held = ids[keep], x[keep]
    if held is not None:
        ids, x = held
        order = np.argsort(x, axis=0, kind="stable")
        n = min(HEAD, len(ids))
        at = np.concatenate([order[:n], order[len(ids) - n :]])
        lists = np.broadcast_to(np.arange(x.shape[1]), at.shape)
        columns = (lists.ravel().astype(np.int32), x[at, lists].ravel(), ids[at].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["list", "value", "vec_id"])


def _task(k: int, shared):
    """Two blocks: the candidates' part of the lists, and queries."""

    def run(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        head_ids, head, edges = shared.value
        out: tuple[list, list, list] = ([], [], [])
        if candidates.num_rows and asked.num_rows:
            (ids, x), (query_ids, q) = _rows(candidates), _rows(asked)
            firsts = [best_of(head_ids, head, i, v, k) for i, v in zip(query_ids.tolist(), q, strict=True)]
            floor = np.array([-f[-1][0] if len(f) == k else -np.inf for f in firsts], float)
            for i, found, _ in no_random_access(ids, x, query_ids, q, k, floor, edges):
                out[0].extend([int(query_ids[i])] * len(found))
                out[1].extend(v for _, v in found)
                out[2].extend(-s for s, _ in found)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest integer inner products of every query with all other rows.

    Components become floor(scale * x), at most a long's range. Rows whose id is
    divisible by ``every`` are queries; a query meets every row whose id isn't its
    own. Returns query_id, rank (from 1), vec_id, score; ties go to the smaller
    vec_id, then equal rows share ranks in turn. Scores are exact; one beyond a
    long is the nearest long. Vectors that are null or hold null or non-finite
    components, and rows without id, take no part; shorter vectors count as filled
    up with zeros. A query row that is repeated is answered once per distinct
    (id, vector). Fewer than k others give all of them; an empty table gives no
    rows; other columns are not read.

    1. Each component is a table-wide list in order of value. Its values at the
       shares DEPTHS, from either end, come from one aggregation (rank errors of the
       sketch only move the steps).
    2. The rows at the ends of the lists (at most 2 * HEAD * HEAD_LISTS) are scored
       exactly for every query: k rows reach the k-th of these scores, its floor.
    3. Candidates and queries meet block by block in a grid: a task holds at most
       about CANDIDATES rows, their part of the lists, and QUERIES queries, reads the
       lists by the table-wide steps and drops what can't reach the floor. k rows per
       query and block are shuffled; the driver sees the list ends and steps only.
    """
    spark = vectors.sparkSession
    value = F.col(vector_col).cast("array<double>")
    usable = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = vectors.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(value, lambda x: F.floor(x * scale).cast("long")).alias("x"))
    clean, clean_path = materialise_at(clean, "topk-rows")
    size = clean.agg(F.max(F.size("x")).alias("width"), F.count("*").alias("n"), F.sum((F.pmod("vec_id", F.lit(every)) == 0).cast("long")).alias("queries")).first()
    width = size.width or 0
    if not width or not size.queries:
        drop_table(spark, clean_path)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    even = clean.select("vec_id", F.expr(f"slice(concat(x, array_repeat(0L, {width})), 1, {width})").alias("x"))
    shares = [1 - d for d in DEPTHS] + list(DEPTHS)
    steps = even.select(F.posexplode("x").alias("list", "value")).groupBy("list").agg(F.percentile_approx("value", shares, 1000).alias("at")).orderBy("list").collect()  # a row per component
    table = np.array([r["at"] for r in steps], float)
    edges = table[:, : len(DEPTHS)].T.copy(), table[:, len(DEPTHS) :].T.copy()
    ends = even.mapInArrow(_ends, "list int, value long, vec_id long")
    low, high = (Window.partitionBy("list").orderBy(*order) for order in (("value", "vec_id"), (F.desc("value"), "vec_id")))
    chosen = ends.withColumn("a", F.row_number().over(low)).where(F.col("a") <= HEAD).unionByName(ends.withColumn("a", F.row_number().over(high)).where(F.col("a") <= HEAD)).select("vec_id").distinct()
    head_ids, head = _rows(even.join(F.broadcast(chosen), "vec_id", "left_semi").dropDuplicates(["vec_id"]).toArrow())  # at most 2 * HEAD * HEAD_LISTS rows
    shared = spark.sparkContext.broadcast((head_ids, head.reshape(-1, width), edges))
    across, down = -(-size.n // CANDIDATES), -(-size.queries // QUERIES)
    candidates = even.withColumn("c", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(across))).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    asked = even.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates()
    asked = asked.withColumn("g", F.pmod(F.xxhash64("vec_id", "x"), F.lit(down)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))))
    found = candidates.groupBy("c", "g").cogroup(asked.groupBy("c", "g")).applyInArrow(_task(k, shared), _OUT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
