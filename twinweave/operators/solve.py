"""Greedy matching, annealing, exact minima, and reading their results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.functions.vectors import similarity_pairs
from twinweave.operators.components import connected_components
from twinweave.operators.similarity import threshold_pairs
from twinweave.runtime import drop_table, materialise, materialise_at

#: Variables of a part that may be solved by counting all states.
EXACT = 20
#: Pairs left at which one task finishes a greedy matching.
FINISH = 200_000
#: Pairs of free nodes that are compared at once, whatever their similarity.
AT_ONCE = 30_000_000
#: Vectors a side that tell how similarities are spread, and pairs a free node that a stage shall have.
TOLD = 1_024
PAIRS = 8


def greedy(candidates: DataFrame) -> DataFrame:
    """i, a, sim: pairs taken by similarity, then (i, a), as long as both ends are free.

    Each round takes the pairs that are best for both their ends; that is what the
    sequential rule would take, whatever the order of the rest. The best pair of an end
    is an aggregate, so a task sends one pair per end; taken ends leave by
    anti-joins. Once at most FINISH pairs are left, one task takes them in order.
    """
    spark = candidates.sparkSession
    schema = "i long, a long, sim double"
    left, path = materialise_at(candidates.selectExpr("cast(i as long) i", "cast(a as long) a", "cast(sim as double) sim"), "greedy")
    out = spark.createDataFrame([], schema)
    order = F.struct("sim", -F.col("i"), -F.col("a"))
    while (n := left.count()) > FINISH:
        best = left.groupBy("i").agg(F.max_by("a", order).alias("a"), F.max("sim").alias("sim"))
        top = left.groupBy("a").agg(F.max_by("i", order).alias("i"))
        won = materialise(best.join(top, ["i", "a"]).select("i", "a", "sim"), "greedy-won")
        out = out.unionByName(won)
        rest, rest_path = materialise_at(left.join(won.select("i"), "i", "left_anti").join(won.select("a"), "a", "left_anti").select("i", "a", "sim"), "greedy")
        drop_table(spark, path)
        left, path = rest, rest_path
    if n:
        out = out.unionByName(left.coalesce(1).mapInPandas(_in_order, schema))
    return out


def _in_order(frames):
    """Sequential greedy over one task's bounded rows."""
    rows = pd.concat(list(frames)).sort_values(["sim", "i", "a"], ascending=[False, True, True], kind="stable")
    used_i, used_a, keep = set(), set(), []
    for i, a in zip(rows.i, rows.a, strict=True):
        free = i not in used_i and a not in used_a
        keep.append(free)
        if free:
            used_i.add(i)
            used_a.add(a)
    yield rows[keep]


def match(similarity: DataFrame, threshold: float | None, fallback: bool = False) -> DataFrame:
    """Greedy pairs over the threshold; with fallback, then pairs of what is left, whatever their similarity."""
    from twinweave.operators.qubo import candidate_pairs

    first = greedy(candidate_pairs(similarity, threshold))
    if threshold is None or not fallback:
        return first
    rest = similarity.join(first.select("i"), "i", "left_anti").join(first.select("a"), "a", "left_anti")
    return first.unionByName(greedy(rest.select("i", "a", "sim")))


def match_vectors(left: DataFrame, right: DataFrame, threshold: float | None, digits: int | None = None, fallback: bool = False) -> DataFrame:
    """match() of all pairs of left(idx, vec) and right(idx, vec), without a table of them.

    The greedy rule takes pairs by similarity, so it can go down in stages: first the
    pairs over a high bound, then those over a lower one whose ends are still free. A
    bounded sample tells where a stage shall end, so that it has about PAIRS pairs a free node;
    where it ends changes no result. Up to AT_ONCE pairs of free nodes are one stage.
    """
    whole = lambda side: side.where("idx is not null and vec is not null").select("idx", "vec")
    free, paths, out = [whole(left), whole(right)], [], left.sparkSession.createDataFrame([], "i long, a long, sim double")
    for floor in [threshold, None] if fallback and threshold is not None else [threshold]:
        before = np.inf
        while all(sizes := [side.count() for side in free]):
            bound = _stage(free, sizes, floor, before)
            pairs = similarity_pairs(*free, None, digits) if bound is None else threshold_pairs(*free, bound, digits)
            won = materialise(greedy(pairs), "greedy-stage")
            out = out.unionByName(won)
            kept = [materialise_at(side.join(won.select(F.col(c).alias("idx")), "idx", "left_anti"), "greedy-free") for side, c in zip(free, "ia", strict=True)]
            for path in paths:
                drop_table(out.sparkSession, path)
            free, paths, before = [side for side, _ in kept], [path for _, path in kept], bound
            if bound == floor:
                break
    for path in paths:
        drop_table(out.sparkSession, path)
    return out


def _stage(free: list[DataFrame], sizes: list[int], floor: float | None, before: float) -> float | None:
    """The least similarity of the next stage: under ``before``, not under ``floor``."""
    every = sizes[0] * sizes[1]
    if every <= AT_ONCE:
        return floor
    x, y = (np.array([r.vec for r in side.orderBy(F.xxhash64("idx"), "idx").limit(TOLD).collect()], float) for side in free)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    spread, wanted = np.sort((unit(x) @ unit(y).T).ravel())[::-1], PAIRS * sum(sizes)
    while (at := int(wanted / every * len(spread))) < len(spread):
        bound = float(spread[at])
        if bound < before:
            return bound if floor is None or bound > floor else floor
        wanted *= 4
    return floor


def parts(qubo: DataFrame) -> DataFrame:
    """var, part: variables coupled by off-diagonal terms."""
    return connected_components(qubo.select(F.col("u").alias("a"), F.col("v").alias("b"))).select(F.col("node").alias("var"), F.col("component").alias("part"))


def exact(qubo: DataFrame) -> DataFrame:
    """part, mask, energy, vars: the least state of every part of up to EXACT variables.

    Parts are independent, so their minima add up. Ties go to the least mask, bit k
    being the part's k-th variable. A part over EXACT is an error.
    """
    placed = qubo.join(parts(qubo).withColumnRenamed("var", "u"), "u")

    def least(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*rows.u, *rows.v})
        if len(names) > EXACT:
            raise ValueError(f"{len(names)} coupled variables are too many to count")
        k = {v: j for j, v in enumerate(names)}
        states = np.arange(1 << len(names), dtype=np.int64)
        cost = np.zeros(len(states))
        for u, v, c in zip(rows.u, rows.v, rows.coeff, strict=True):
            cost += c * ((states >> k[u]) & (states >> k[v]) & 1)
        at = int(cost.argmin())
        return pd.DataFrame({"part": [rows.part.iloc[0]], "mask": [at], "energy": [cost[at]], "vars": [[v for v in names if at >> k[v] & 1]]})

    return placed.select("part", "u", "v", "coeff").groupBy("part").applyInPandas(least, "part long, mask long, energy double, vars array<long>")


def anneal(qubo: DataFrame, reads: int = 100, sweeps: int = 1000, seed: int = 0) -> DataFrame:
    """read, energy, vars of independent annealing runs; the caller takes the least energy.

    Parts of the problem share no term, so each is annealed in a task of its own and
    a read's energies add up. A part's reads run side by side: one draw of order,
    one schedule from the largest to the smallest coefficient, energy changes kept up
    to date flip by flip. Equal seeds give equal runs. An empty problem has reads of
    energy 0 without variables.
    """
    runs = anneal_runs(qubo, reads, sweeps, seed)
    summed = runs.groupBy("read").agg(F.sum("energy").alias("energy"), F.array_sort(F.flatten(F.collect_list("vars"))).alias("vars"))
    empty = F.array().cast("array<long>")
    return qubo.sparkSession.range(reads).withColumnRenamed("id", "read").join(summed, "read", "left").select("read", F.coalesce("energy", F.lit(0.0)).alias("energy"), F.coalesce("vars", empty).alias("vars"))


def anneal_runs(qubo: DataFrame, reads: int = 100, sweeps: int = 1000, seed: int = 0) -> DataFrame:
    """part, read, energy, vars: the annealing runs of each part, which depend on that part's terms only."""
    ordered = qubo.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("coeff").alias("coeff"))
    placed = ordered.join(parts(qubo).withColumnRenamed("var", "u"), "u").select("part", "u", "v", "coeff")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["u", "v"])
        names = np.unique(np.concatenate([rows.u, rows.v]))
        u, v, c = np.searchsorted(names, rows.u), np.searchsorted(names, rows.v), rows.coeff.to_numpy(float)
        n, off = len(names), u != v
        own = np.bincount(u[~off], c[~off], n)
        ends, others, terms = np.concatenate([u[off], v[off]]), np.concatenate([v[off], u[off]]), np.concatenate([c[off], c[off]])
        by = np.argsort(ends, kind="stable")
        others, terms, start = others[by], terms[by], np.searchsorted(ends[by], np.arange(n + 1))
        size = np.abs(c[c != 0])
        betas = np.geomspace(0.1 / max(size.max(), 1e-9), 10 / max(size.min(), 1e-9), sweeps) if len(size) else np.ones(1)
        rng = np.random.default_rng([seed, int(rows.part.iloc[0]) & 0x7FFFFFFF])
        x = rng.integers(0, 2, (n, reads)).astype(float)
        field = np.repeat(own[:, None], reads, axis=1)
        np.add.at(field, ends[by], terms[:, None] * x[others])
        for beta in betas:
            draws = np.log(rng.random((n, reads)))
            for k in rng.permutation(n).tolist():
                change = (1 - 2 * x[k]) * field[k]
                flip = np.flatnonzero((change <= 0) | (draws[k] < -beta * change))
                if len(flip):
                    x[k, flip] = 1 - x[k, flip]
                    s = slice(start[k], start[k + 1])
                    field[others[s][:, None], flip[None, :]] += terms[s][:, None] * (2 * x[k, flip] - 1)[None, :]
        chosen = x > 0
        energy = c @ (chosen[u] & chosen[v])
        return pd.DataFrame({"part": rows.part.iloc[0], "read": np.arange(reads), "energy": energy, "vars": [names[chosen[:, r]].tolist() for r in range(reads)]})

    return placed.groupBy("part").applyInPandas(run, "part long, read long, energy double, vars array<long>")


def part_minima(qubo: DataFrame, reads: int = 100, sweeps: int = 1000, seed: int = 0) -> DataFrame:
    """part, var: what the least state of each part chooses; parts over EXACT variables are annealed, the best read of each counts."""
    placed = materialise(qubo.join(parts(qubo).withColumnRenamed("var", "u"), "u"), "parts")
    large = parts(qubo).groupBy("part").count().where(F.col("count") > EXACT).select("part")
    terms = lambda how: placed.join(large, "part", how).select("u", "v", "coeff")
    small = exact(terms("left_anti")).select("part", "vars")
    annealed = anneal_runs(terms("left_semi"), reads, sweeps, seed).groupBy("part").agg(F.min_by("vars", F.struct("energy", "read")).alias("vars"))
    return small.unionByName(annealed).select("part", F.explode("vars").alias("var"))


def best_read(runs: DataFrame) -> DataFrame:
    """The run of least energy, then least number."""
    return runs.orderBy("energy", "read").limit(1)


def decode(sample: DataFrame, variables: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """i, a, left_uri, right_uri, similarity of the chosen variables; nothing is repaired."""
    x, y = left.select(F.col("idx").alias("i"), F.col("uri").alias("left_uri")), right.select(F.col("idx").alias("a"), F.col("uri").alias("right_uri"))
    return variables.join(sample.select("var"), "var", "left_semi").join(x, "i").join(y, "a").select("i", "a", "left_uri", "right_uri", F.col("sim").alias("similarity"))


def violations(sample_pairs: DataFrame) -> DataFrame:
    """side, node, n: ends that a sample uses more than once."""
    count = lambda side, name: sample_pairs.groupBy(F.col(side).alias("node")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(name).alias("side"), "node", "n")
    return count("i", "left").unionByName(count("a", "right"))


def structure_support(structure: DataFrame, variables: DataFrame, sample: DataFrame, node_weight: float = 1.0) -> DataFrame:
    """var, structure_score, total_score of the chosen variables.

    Minus the sum of structure terms whose other end is chosen too; a diagonal term
    counts once.
    """
    ends = structure.select(F.col("u").alias("var"), F.col("v").alias("other"), "coeff").unionByName(structure.where("u <> v").select(F.col("v").alias("var"), F.col("u").alias("other"), "coeff"))
    chosen = sample.select("var")
    held = ends.join(chosen, "var", "left_semi").join(chosen.withColumnRenamed("var", "other"), "other", "left_semi").groupBy("var").agg((-F.sum("coeff")).alias("s"))
    score = F.coalesce("s", F.lit(0.0))
    return variables.join(chosen, "var", "left_semi").join(held, "var", "left").select("var", score.alias("structure_score"), (F.col("sim") * node_weight + score).alias("total_score"))
