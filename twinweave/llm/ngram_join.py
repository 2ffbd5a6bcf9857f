"""N-gram Jaccard self-join with adaptive multi-match prefixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.llm.pieces import give_back, mixed, run_names
from twinweave.operators.components import connected_components
from twinweave.operators.numbering import summed_before
from twinweave.runtime import drop_table, materialise, materialise_at, settings

SHINGLE = 5
#: Sets are told apart and counted by shingle hashes of 64 bits; this many of them are kept.
BITS = 48
#: Bytes of text hashed at once.
GROUP = 1 << 19
#: Prefix tokens by which close copies find a leader before the join.
PROBES = 8
#: Lists up to this long are joined; longer ones cost too much and lengthen prefixes.
LIST = 48
#: Weight of a block of sets: a set weighs its tokens and SET_WEIGHT.
BLOCK_WEIGHT = 600_000
SET_WEIGHT = 1_000
#: Bits that tell, with few mistakes, which tokens are shared (32 MB), and bits made in one task.
MARKS = 1 << 28
PAGE = 1 << 16
#: Classes whose sets are wanted are broadcast up to this many.
WANTED_BOUND = 1_000_000

_WEIGHTS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, bounds, classes, seconds) of fewer than 65,536 texts, whole.

    tokens[bounds[i] : bounds[i + 1]] are the kept bits of text i's sorted distinct shingle hashes,
    classes[i] is a signed 64-bit name of that set (0 if empty), seconds[i] another
    one; equal sets have equal names. Words are maximal runs without white space, A-Z folded. Under
    SHINGLE words, the whole sequence is the one shingle.
    """
    data = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    space = _IS_SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    bounds = np.searchsorted(starts, np.cumsum([1] + [len(t) + 1 for t in texts]))
    words = run_names(_FOLD[data], starts, ends)
    names = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        names = mixed(names + words[j : j + len(names)] * _WEIGHTS[j])
    sets = []
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if 0 < high - low < SHINGLE:
            own = words[low:high]
            sets.append(mixed((own * _WEIGHTS[: len(own)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(own))))
        elif high > low:
            own = np.sort(names[low : high - SHINGLE + 1])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            sets.append(names[:0])
    sizes = np.array([len(x) for x in sets], np.int64)
    limits = np.concatenate([[0], np.cumsum(sizes)])
    whole = np.concatenate([names[:0], *sets])
    classes, seconds = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        x = np.add.reduceat(mixed(whole), limits[full])
        y = np.add.reduceat(mixed(whole ^ np.uint64(0x5851F42D4C957F2D)), limits[full])
        classes[full] = mixed(x * np.uint64(3) + mixed(y) + sizes[full].astype(np.uint64)).view(np.int64)
        seconds[full] = mixed(y * np.uint64(5) + mixed(x ^ np.uint64(0x9E3779B97F4A7C15))).view(np.int64)
    return whole >> np.uint64(64 - BITS), limits, classes, seconds


def need(n):
    """Least shared shingles of a set of n with any partner at the threshold."""
    return -(-4 * n // 5)


def longest_prefix(n: int) -> int:
    """Tokens of a set's prefix that are kept for lengthening."""
    return min(n, n - need(n) + n // 10 + 4)


def matches_kept(n: int) -> int:
    """Tokens that kept prefixes of a set of n and of any partner share at least."""
    return min(need(n), need(n) // 10 + 4)


def _grouped(texts):
    run, size = [], 0
    for t in texts:
        if run and (size + len(t) > GROUP or len(run) >= 60_000):
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t) + 1
    if run:
        yield run


def _binary(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8]).tobytes()


def _tokens(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // (BITS // 8), 8), np.uint8)
    out[:, : BITS // 8] = np.frombuffer(data, np.uint8).reshape(-1, BITS // 8)
    return out.view("<u8").ravel()


def _fresh(seen: set, name) -> bool:
    """Whether a class is new to this task, as far as a bounded memory knows."""
    if name in seen:
        return False
    if len(seen) > 1_000_000:
        seen.clear()
    seen.add(name)
    return True


def _profiles(batches):
    """A row per document; the first of a class in this task carries the set."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        at = 0
        for run in _grouped(t or b"" for t in _texts(batch.column(1).cast(pa.binary()))):
            sizes, names, others, sets = [], [], [], []
            tokens, bounds, classes, seconds = shingle_sets(run)
            for i, name in enumerate(zip(classes.tolist(), seconds.tolist(), strict=True)):
                low, high = int(bounds[i]), int(bounds[i + 1])
                sizes.append(high - low)
                names.append(name[0] if high > low else None)
                others.append(name[1] if high > low else None)
                sets.append(_binary(tokens[low:high]) if high > low and _fresh(seen, name) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(run)), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(others, pa.int64()), pa.array(sets, pa.binary())], names=["doc_id", "n", "cls", "second", "tokens"])
            at += len(run)
    give_back()


def _texts(column: pa.Array):
    for x in column:
        yield x.as_py()


def _sliced(batches, rows: int = 500):
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    give_back()


def _links(batches):
    """The pairs whose sets pass 100 * intersection >= 80 * union."""
    for batch in _sliced(batches):
        keep = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = _tokens(a), _tokens(b)
            i = np.searchsorted(x, y)
            common = int((x[np.minimum(i, len(x) - 1)] == y).sum())
            keep.append(100 * common >= 80 * (len(x) + len(y) - common))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])


def _probes(most: int):
    """token, cls and n of the first ``most`` tokens of each prefix."""

    def run(batches):
        for batch in _sliced(batches):
            sets = [_tokens(x)[:most] for x in batch.column(2).to_pylist()]
            if sets:
                times = [len(x) for x in sets]
                columns = (np.concatenate(sets).astype(np.int64), np.repeat(np.asarray(batch.column(0)), times), np.repeat(np.asarray(batch.column(1)), times))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "cls", "n"])

    return run


def prefix_plan(tokens: np.ndarray, n: int, heavy: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(prefix length, light matches required, light mask) of one set.

    A prefix with l matches has n - need(n) + l tokens, and partners share l of
    them. It is lengthened until l exceeds its heavy tokens, so that at least one
    shared token is light, and further, for long sets, until several are: 0 matches
    if no kept prefix is long enough.
    """
    light = np.ones(len(tokens), bool)
    if len(heavy):
        i = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
        light = heavy[i] != tokens
    first = n - need(n)
    heavy_in = np.cumsum(~light)[first:]  # with l = 1, 2, ...
    spare = np.arange(1, len(heavy_in) + 1) - heavy_in
    spare = spare[: matches_kept(n)]
    aim = min(4, 1 + n // 100)
    for e in range(aim, 0, -1):
        at = np.flatnonzero(spare >= e)
        if len(at):
            return first + int(at[0]) + 1, e, light
    return len(tokens), 0, light


def _kept(marks):
    """token, cls, n and pos of every kept prefix token that is marked (None: of all)."""

    def run(batches):
        for batch in _sliced(batches):
            sets = [_tokens(x) for x in batch.column(2).to_pylist()]
            times = [len(x) for x in sets]
            columns = [np.concatenate(sets), np.repeat(np.asarray(batch.column(0)), times), np.repeat(np.asarray(batch.column(1)), times), np.concatenate([np.arange(t, dtype=np.int32) for t in times])]
            if marks is not None:
                at = columns[0] & np.uint64(8 * len(marks.value) - 1)
                use = marks.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1
                columns = [c[use] for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0].astype(np.int64)), *(pa.array(c) for c in columns[1:])], names=["token", "cls", "n", "pos"])

    return run


def _page(rows: pa.Table) -> pa.Table:
    bits = np.zeros(PAGE, np.uint8)
    bits[np.asarray(rows.column("slot")) % PAGE] = 1
    return pa.table({"page": rows.column("page").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()])})


def marked(tokens: DataFrame):
    """Broadcast bit map of the low bits of the tokens, at most MARKS bits; None if they are too many for it to tell."""
    n = tokens.count()
    if n > MARKS // 2:
        return None
    size = min(MARKS, max(PAGE, 1 << (16 * n).bit_length()))
    slots = tokens.select((F.col("token").bitwiseAND(F.lit(size - 1))).alias("slot")).distinct().withColumn("page", F.expr(f"slot div {PAGE}"))
    found = np.zeros((size // PAGE, PAGE // 8), np.uint8)
    for r in slots.groupBy("page").applyInArrow(_page, "page long, bits binary").collect():  # at most MARKS bits
        found[r.page] = np.frombuffer(r.bits, np.uint8)
    return tokens.sparkSession.sparkContext.broadcast(found.ravel())


def _planned(most: int):
    """Light postings of planned prefixes with the matches required; heavy ones (e = 0) of sets without a plan.

    Of a dense set's heavy tokens all but the most frequent of what kept prefixes
    share are posted: the rest of the shared ones must be among them.
    """

    def run(batches):
        for batch in _sliced(batches):
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for cls, n, shared in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                pos, token, df = (np.array([x[k] for x in shared], np.int64) for k in ("pos", "token", "df"))
                heavy = df > most
                places = np.arange(longest_prefix(n), dtype=np.uint64)
                length, e, _ = prefix_plan(places, n, np.sort(pos[heavy]).astype(np.uint64))
                light = np.flatnonzero(~heavy & (pos < length))
                rare = np.lexsort((token, df))
                rare = rare[heavy[rare]][: max(0, int(heavy.sum()) - matches_kept(n) + 1)] if not e else rare[:0]
                own = np.concatenate([light, rare])
                out[0].append(token[own])
                out[1].extend([cls] * len(own))
                out[2].extend([n] * len(own))
                out[3].append(df[own])
                out[4].extend([e or 1] * len(light) + [0] * len(rare))
            if out[1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0])), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(np.concatenate(out[3])), pa.array(out[4], pa.int64())], names=["token", "cls", "n", "df", "e"])

    return run


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every x with every y, sets of distinct tokens.

    Tokens in many of both go through matrix products, the others pair by pair.
    """
    out = np.zeros((len(x), len(y)))
    names, column = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    rows_x, rows_y = np.repeat(np.arange(len(x)), [len(t) for t in x]), np.repeat(np.arange(len(y)), [len(t) for t in y])
    at_x, at_y = column[: len(rows_x)], column[len(rows_x) :]
    in_x, in_y = np.bincount(at_x, minlength=len(names)), np.bincount(at_y, minlength=len(names))
    pairs = in_x * in_y
    many = pairs > max(16, len(x) * len(y) // 64)
    few = (pairs > 0) & ~many
    number = np.cumsum(many) - 1
    keep_x, keep_y = many[at_x], many[at_y]
    cx, rx, cy, ry = number[at_x[keep_x]], rows_x[keep_x], number[at_y[keep_y]], rows_y[keep_y]
    for first in range(0, int(many.sum()), 4096):
        a, b = np.zeros((len(x), 4096), np.float32), np.zeros((len(y), 4096), np.float32)
        m, k = (cx >= first) & (cx < first + 4096), (cy >= first) & (cy < first + 4096)
        a[rx[m], cx[m] - first] = 1
        b[ry[k], cy[k] - first] = 1
        out += a @ b.T
    keep_x, keep_y = few[at_x], few[at_y]
    cx, rx, cy, ry = at_x[keep_x], rows_x[keep_x], at_y[keep_y], rows_y[keep_y]
    order = np.argsort(cy, kind="stable")
    cy, ry = cy[order], ry[order]
    step = max(1, (1 << 19) // max(16, len(x) * len(y) // 64))
    for first in range(0, len(cx), step):
        c, r = cx[first : first + step], rx[first : first + step]
        low, n = np.searchsorted(cy, c), in_y[c]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out += np.bincount(np.repeat(r, n) * len(y) + ry[np.repeat(low, n) + inside], minlength=out.size).reshape(out.shape)
    return out


def _block_links(rows: pa.Table) -> pa.Table:
    """Of two blocks, links that join components; no more than they have sets."""
    block, cls, comp, n = (np.asarray(rows.column(c)) for c in ("block", "cls", "comp", "n"))
    tokens, up, found = [_tokens(t) for t in rows.column("tokens").to_pylist()], {}, []

    def root(c):
        while up.get(c, c) != c:
            up[c] = c = up.get(up[c], up[c])
        return c

    xs, ys = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    both = common_counts([tokens[i] for i in xs], [tokens[i] for i in ys])
    linked = (100 * both >= 80 * (n[xs][:, None] + n[ys][None, :] - both)) & (comp[xs][:, None] != comp[ys][None, :])
    for i in np.flatnonzero(linked.any(axis=1)).tolist():
        partners = ys[linked[i]]
        for j in partners[np.unique(comp[partners], return_index=True)[1]].tolist():
            a, b = root(int(comp[xs[i]])), root(int(comp[j]))
            if a != b:
                up[max(a, b)] = min(a, b)
                found.append((int(cls[xs[i]]), int(cls[j])))
    del both, linked, tokens
    give_back()
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def distinctly_named(profiles: DataFrame) -> DataFrame:
    """profiles, with different sets that share a name (cls) named anew by their second one."""
    clash = profiles.where("cls is not null").select("cls", "second").distinct().groupBy("cls").agg(F.count("*").alias("names")).where("names > 1").select("cls")
    clash = materialise(clash, "jaccard-clash")
    if not clash.count():
        return profiles
    found = profiles.join(clash.withColumn("clash", F.lit(True)), "cls", "left")
    return found.withColumn("cls", F.when(F.col("clash"), F.xxhash64("cls", "second")).otherwise(F.col("cls"))).drop("clash")


class _Join:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.spark = docs.sparkSession
        given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        profiles = materialise(given.mapInArrow(_profiles, "doc_id long, n long, cls long, second long, tokens binary"), "jaccard-profiles", "lz4")
        profiles = distinctly_named(profiles)
        self.rows = profiles.select("doc_id", "n", "cls")
        self.sets = profiles.where("tokens is not null").select("cls", "tokens")
        kept = F.expr(f"substring(tokens, 1, {BITS // 8} * cast(least(n, n - (4 * n + 4) div 5 + n div 10 + 4) as int))")
        self.classes = materialise(profiles.where("tokens is not null").select("cls", "n", kept.alias("prefix")).dropDuplicates(["cls"]), "jaccard-classes", "lz4")
        self.components = None

    def sets_of(self, wanted: DataFrame) -> tuple[DataFrame, str] | tuple[None, None]:
        """The sets of the classes ``wanted`` (cls), once each, and where they lie; None if there are none."""
        n = wanted.count()
        if not n:
            return None, None
        found = self.sets.join(F.broadcast(wanted) if n <= WANTED_BOUND else wanted, "cls", "left_semi").dropDuplicates(["cls"])
        return materialise_at(found, "jaccard-sets", "lz4")

    def joined(self, links: DataFrame, name: str) -> None:
        """Components with the links (a, b)."""
        if self.components is not None:
            links = links.unionByName(self.components.select(F.col("node").alias("a"), F.col("component").alias("b")))
        self.components = materialise(connected_components(links), f"jaccard-components-{name}")

    def verify(self, pairs: DataFrame, name: str) -> None:
        """Joins the components of the pairs (a, b) that pass."""
        pairs, path = materialise_at(pairs.select("a", "b").distinct(), "jaccard-pairs")
        sets, sets_path = self.sets_of(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct())
        if sets is not None:
            both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("y")), "b")
            found, found_path = materialise_at(both.select("a", "b", "x", "y").mapInArrow(_links, "a long, b long"), "jaccard-links")
            drop_table(self.spark, sets_path)
            self.joined(found, name)
            drop_table(self.spark, found_path)
        drop_table(self.spark, path)

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows with the component so far of their class."""
        if self.components is None:
            return rows.withColumn("comp", F.col("cls"))
        known = self.components.select(F.col("node").alias("cls"), "component")
        if self.components.count() <= WANTED_BOUND:
            known = F.broadcast(known)
        return rows.join(known, "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")

    def run(self) -> None:
        # Leaders: the least class in a token's list meets every member of fitting size.
        probes = self.classes.select("cls", "n", "prefix").mapInArrow(_probes(PROBES), "token long, cls long, n long")
        leaders = probes.groupBy("token").agg(F.min(F.struct("cls", "n")).alias("l"))
        led = probes.join(leaders, "token").where("cls <> l.cls and 5 * least(n, l.n) >= 4 * greatest(n, l.n)")
        self.verify(led.select(F.least("cls", "l.cls").alias("a"), F.greatest("cls", "l.cls").alias("b")), "led")
        # The tokens that kept prefixes share, with the lengths of their lists, and each set's plan.
        kept = lambda marks: self.classes.select("cls", "n", "prefix").mapInArrow(_kept(marks), "token long, cls long, n long, pos int")
        counts, counts_path = materialise_at(kept(None).groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "jaccard-counts")
        shared, shared_path = materialise_at(kept(marked(counts)).join(counts, "token"), "jaccard-shared")
        drop_table(self.spark, counts_path)
        of_class = shared.groupBy("cls").agg(F.first("n").alias("n"), F.collect_list(F.struct("pos", "token", "df")).alias("shared"))
        plan, plan_path = materialise_at(of_class.mapInArrow(_planned(LIST), "token long, cls long, n long, df long, e long"), "jaccard-plan")
        drop_table(self.spark, shared_path)
        light = self.placed(plan.where("e > 0").select("token", "cls", "n", "e"))
        a, b = (light.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("cls", "n", "e", "comp")]) for s in "ab")
        met = a.join(b, "token").where("cls_a < cls_b and comp_a <> comp_b and 5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)")
        enough = met.groupBy(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).agg(F.count("*").alias("m"), F.min(F.least("e_a", "e_b")).alias("e")).where("m >= e")
        self.verify(enough, "light")
        self.blocks(plan.where("e = 0").select("token", "cls", "n", "df"))
        drop_table(self.spark, plan_path)

    def blocks(self, dense: DataFrame) -> None:
        """Joins what is linked in long lists, block by block; no pair is ever a row."""
        lists = self.placed(dense)
        open_ = lists.groupBy("token").agg(F.min("comp").alias("p"), F.max("comp").alias("q")).where("p <> q").select("token")
        lists, lists_path = materialise_at(lists.join(open_, "token", "left_semi"), "jaccard-lists")
        # Sets that share their commonest token lie beside each other, by size.
        members = lists.groupBy("cls").agg(F.first("n").alias("n"), F.first("comp").alias("comp"), F.max(F.struct("df", "token")).alias("key")).select("cls", "n", "comp", "key.df", "key.token")
        members, members_path = summed_before(members, ["df", "token", "n", "cls"], F.col("n") + SET_WEIGHT, "weight")
        members = members.select("cls", "n", "comp", F.expr(f"weight div {BLOCK_WEIGHT}").alias("block"))
        sets, sets_path = self.sets_of(members.select("cls"))
        if sets is not None:
            around = members.groupBy("block").agg(*[f(c).alias(f"{c}_{f.__name__}") for c in ("n", "comp") for f in (F.min, F.max)])
            met = lists.select("token", "cls").join(members.select("cls", "block"), "cls").groupBy("token").agg(F.sort_array(F.collect_set("block")).alias("met")).select("met").distinct()
            each = F.expr("flatten(transform(met, (a, i) -> transform(slice(met, i + 1, size(met) - i), b -> struct(a as a, b as b))))")
            pairs = met.select(F.explode(each).alias("p")).select("p.*").distinct()
            x, y = (around.select(*[F.col(c).alias(f"{s}_{c}") for c in around.columns]) for s in "xy")
            pairs = pairs.join(x, F.col("a") == F.col("x_block")).join(y, F.col("b") == F.col("y_block"))
            pairs = pairs.where("5 * x_n_max >= 4 * y_n_min and 5 * y_n_max >= 4 * x_n_min and least(x_comp_min, y_comp_min) <> greatest(x_comp_max, y_comp_max)").select("a", "b")
            sent = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
            full = members.join(sets, "cls").join(sent, "block").select("a", "b", "block", "cls", "comp", "n", "tokens")
            found, found_path = materialise_at(full.groupBy("a", "b").applyInArrow(_block_links, "a long, b long"), "jaccard-links")
            drop_table(self.spark, sets_path)
            self.joined(found, "blocks")
            drop_table(self.spark, found_path)
        drop_table(self.spark, members_path)
        drop_table(self.spark, lists_path)

    def result(self) -> DataFrame:
        keyed = self.rows.withColumn("grp", F.col("cls"))
        if self.components is not None:
            known = self.components.select(F.col("node").alias("cls"), "component")
            keyed = self.rows.join(known, "cls", "left").withColumn("grp", F.coalesce("component", "cls"))
        # A table of its own, so that a group of very many rows is an ordinary skewed key of the join.
        least = materialise(keyed.where("grp is not null").groupBy("grp").agg(F.min("doc_id").alias("least_id")), "jaccard-least")
        return keyed.join(least, "grp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("grp").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links) of every row.

    Two rows link when their sets of distinct SHINGLE-word shingles pass
    100 * intersection >= 80 * union; words are runs without white space, A-Z
    folded. Rows with equal sets form one class. A null text or one without words
    has an empty set and links with nothing; a row without id gets the least id of
    its group, if any. An empty table gives no rows; other columns are not read.

    1. Texts are read once; each class's set is kept, its prefix in hash order too.
    2. The first PROBES tokens of a prefix name leaders (the least class in a
       token's list); pairs with leaders are verified, so that large groups of near
       copies become one component without all their pairs.
    3. Tokens in more than LIST prefixes are heavy: the estimated cost of their
       lists. Each set's prefix is lengthened until the matches it requires exceed
       its heavy tokens; light lists are joined, only between components, and pairs
       with enough matches are verified.
    4. Sets that no kept prefix serves (dense) meet in the rarest of their heavy
       tokens: kept prefixes of similar sets share several tokens, so all but the
       most frequent ones suffice. Such lists are never joined row by row: dense
       sets with an open list (one with several components) lie in blocks, sets of
       one commonest token beside each other by size; two blocks that share an open
       token and hold fitting sizes of different components are compared whole in
       one task, which returns only links that join components.

    A similar pair thus either is in one component already or shares enough light
    tokens, or a heavy list, and is verified with whole sets; none is lost. Memory
    of a task is two blocks; the work of step 4 is quadratic in those dense sets
    that share tokens and are not yet of one component.
    """
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxBytesPerBatch="4m"):
        join = _Join(docs, id_col, text_col)
        join.run()
    return join.result()
