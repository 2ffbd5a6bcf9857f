"""Ranked lexical search over inverted treaps."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinweave.llm.pieces import give_back, run_names
from twinweave.runtime import drop_table, materialise_at, small_batches

TOP = 50
#: Share of the length normalisation, in percent.
LENGTH_SHARE = 50
#: Postings of a block of documents, whose treaps one task holds.
POSTINGS = 1_500_000
#: Queries that go through the documents together, and the most bytes of their distinct terms: what is broadcast.
QUERIES = 20_000
TERM_BYTES = 64 << 20
#: Bytes of text whose words are counted together.
GROUP = 2 << 20
#: Ranges of a traversal that are opened at once, and cells (ranges times terms) beyond which it goes depth first.
OPENED = 256
CELLS = 4_000_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def term_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, owner) of the terms of whole texts, A-Z folded; owner is the text's number."""
    data = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    inside = _TERM[data]
    starts = np.flatnonzero(~inside[:-1] & inside[1:]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    bounds = np.searchsorted(starts, np.cumsum([1] + [len(t) + 1 for t in texts]))
    return _FOLD[data], starts, ends, np.repeat(np.arange(len(texts)), np.diff(bounds))


def distinct_terms(text: Column) -> Column:
    """The distinct terms of a text, sorted; none of a null one."""
    folded = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(folded, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))))


class Dictionary:
    """Numbers of the queries' terms, found by name and then held against the term itself."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(t) for t in raw], dtype=np.int64)
        starts = ends - np.array([len(t) for t in raw], np.int64)
        self.seed, names = -1, starts * 0
        while self.seed < 0 or len(np.unique(names)) < len(names):  # anew, should two terms share a name
            self.seed += 1
            names = run_names(self.data, starts, ends, self.seed)
        order = np.argsort(names)
        self.names, self.number, self.starts, self.length = names[order], order, starts[order], (ends - starts)[order]

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of every run that is a term, -1 of others."""
        if not len(self.names) or not len(starts):
            return np.full(len(starts), -1)
        names = run_names(data, starts, ends, self.seed)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        same = (self.names[at] == names) & (self.length[at] == ends - starts)
        hit = np.flatnonzero(same)
        n = self.length[at[hit]]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differ = data[np.repeat(starts[hit], n) + inside] != self.data[np.repeat(self.starts[at[hit]], n) + inside]
        same[hit[np.unique(np.repeat(np.arange(len(hit)), n)[differ])]] = False
        return np.where(same, self.number[at], -1)


def _postings(dictionary):
    """doc_id, n (terms with repeats), terms (numbers, ascending) and tfs of every document."""

    def grouped(batches):
        for batch in batches:
            ids, at, run, size = batch.column(0), 0, [], 0
            for text in batch.column(1).cast(pa.binary()):
                run.append(text.as_py() or b"")
                size += len(run[-1])
                if size >= GROUP:
                    yield ids.slice(at, len(run)), run
                    at, run, size = at + len(run), [], 0
            if run:
                yield ids.slice(at, len(run)), run

    def run(batches):
        known = dictionary.value
        size = np.int64(max(1, len(known.names)))
        for ids, texts in grouped(batches):
            data, starts, ends, owner = term_places(texts)
            n = np.bincount(owner, minlength=len(texts))
            number = known.numbers(data, starts, ends)
            held = number >= 0
            pairs, tf = np.unique(owner[held] * size + number[held], return_counts=True)
            offsets = pa.array(np.searchsorted(pairs, np.arange(len(texts) + 1) * size).astype(np.int32))
            lists = (pa.ListArray.from_arrays(offsets, pa.array((pairs % size).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int64))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"])
        give_back()

    return run


class Treaps:
    """The inverted treaps of a block: a list per term, search order by document, heap order by impact.

    Lists lie one after the other, each sorted by document. Of equal impacts a
    scrambled document number decides, which keeps trees shallow. ``size`` stands for
    no node: it has no impact.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        order = np.lexsort((doc, term))
        term, doc, impact = term[order], doc[order], impact[order]
        self.size = n = len(doc)
        self.doc = np.append(doc, -1)
        self.impact = np.append(impact, 0)
        self.terms, first = np.unique(term, return_index=True)
        tie = (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
        rank = np.empty(n, np.int64)
        rank[np.lexsort((tie, impact))] = np.arange(n)  # a total order of the whole block
        # The nearest node of higher rank on each side within the list; n + 1 where there is none.
        rank = np.append(rank, [-1, n])
        border = np.zeros(n, bool)
        border[first] = True
        left = np.where(border, n + 1, np.arange(n) - 1)
        right = np.where(np.append(border[1:], True)[:n], n + 1, np.arange(n) + 1)
        for side in (left, right):
            open_ = np.flatnonzero(rank[side] < rank[:n])
            while len(open_):  # what a passed neighbour has passed is lower too
                side[open_] = side[side[open_]]
                open_ = open_[rank[side[open_]] < rank[open_]]
        lower = rank[left] < rank[right]
        self.left, self.right = np.full(n + 1, n), np.full(n + 1, n)
        nodes = np.arange(n)
        inner = np.where(lower, left, right) <= n - 1
        self.right[left[inner & lower]] = nodes[inner & lower]
        self.left[right[inner & ~lower]] = nodes[inner & ~lower]
        self.root = nodes[~inner]
        self.root = self.root[np.argsort(term[self.root], kind="stable")]

    def roots(self, terms: np.ndarray) -> np.ndarray:
        """The roots of the lists of those terms that have one here."""
        return self.root[np.isin(self.terms, terms)]

    def within(self, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each node, the highest of its subtree with low < document < high; rows of nodes share a range."""
        out, width = nodes.ravel().copy(), nodes.shape[1]
        low, high = np.repeat(low, width), np.repeat(high, width)
        open_ = np.flatnonzero(out < self.size)
        while len(open_):
            at = out[open_]
            over, under = self.doc[at] >= high[open_], self.doc[at] <= low[open_]
            at = np.where(over, self.left[at], np.where(under, self.right[at], at))
            out[open_] = at
            open_ = open_[(over | under) & (at < self.size)]
        return out.reshape(nodes.shape)

    def best(self, terms: np.ndarray, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, documents scored) of the k highest sums over 0 of the terms' impacts; of equal ones the least documents.

        Ranges of documents are opened highest bound first. A range's bound is the
        sum of the highest impacts its lists have there, their subtrees' roots; a
        range whose bound is under the k-th score so far, or ``floor``, is left out.
        An opened one gives the document of its highest impact, scored in full, and the
        ranges on both its sides. Beyond CELLS held cells the last ranges are opened first.
        """
        roots = self.roots(terms)
        docs, scores, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        nodes, low, high = roots[None, :], np.array([-1]), np.array([np.iinfo(np.int64).max])
        bound = self.impact[nodes].sum(axis=1)
        least = max(1, floor)
        step = max(1, min(OPENED, CELLS // max(1, 4 * len(roots))))
        while True:
            stay = bound >= least
            if not stay.all():
                nodes, low, high, bound = nodes[stay], low[stay], high[stay], bound[stay]
            if not len(bound):
                return docs, scores, seen
            pick = np.arange(max(0, len(bound) - step), len(bound)) if nodes.size > CELLS else np.argpartition(-bound, step)[:step] if len(bound) > step else np.arange(len(bound))
            own, a, z = nodes[pick], low[pick], high[pick]
            rest = np.ones(len(bound), bool)
            rest[pick] = False
            pivot = self.doc[own[np.arange(len(pick)), self.impact[own].argmax(axis=1)]]
            found = self.impact[self.within(own, pivot - 1, pivot + 1)].sum(axis=1)
            seen += len(pick)
            docs, scores = np.concatenate([docs, pivot]), np.concatenate([scores, found])
            first = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[first], scores[first]
            if len(scores) == k:
                least = max(least, int(scores[-1]))
            parts = self.within(own, a, pivot), self.within(own, pivot, z)
            nodes = np.concatenate([nodes[rest], *parts])
            low, high = np.concatenate([low[rest], a, pivot]), np.concatenate([high[rest], pivot, z])
            bound = np.concatenate([bound[rest], *(self.impact[p].sum(axis=1) for p in parts)])


def _searched(queries, k: int):
    """Of a block's documents, each query's k best: item, doc_id, null, score."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("z", "ascending"), ("doc_id", "ascending")])
        plans, weights = queries.value
        lists, tfs = rows.column("terms").combine_chunks(), rows.column("tfs").combine_chunks()
        doc = np.repeat(np.arange(rows.num_rows), np.diff(np.asarray(lists.offsets)))
        term, tf, m = np.asarray(lists.flatten()), np.asarray(tfs.flatten()), np.asarray(rows.column("m"))
        treaps = Treaps(term, doc, weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])))
        items, places, scores = [], [], []
        for item, terms in enumerate(plans):
            docs, score, _ = treaps.best(terms, k)
            items.append(np.full(len(docs), item))
            places.append(docs)
            scores.append(score)
        places = np.concatenate(places) if places else np.zeros(0, np.int64)
        found = pa.table({"item": np.concatenate(items).astype(np.int64) if items else places, "doc_id": rows.column("doc_id").take(pa.array(places)), "score": np.concatenate(scores) if scores else places})
        del treaps
        give_back()
        return found

    return run


def _blocks_of_queries(items: DataFrame):
    """Lists of up to QUERIES (item_id, distinct terms), with up to TERM_BYTES bytes of terms, as items are read."""
    held, size, known = [], 0, set()
    for row in items.toLocalIterator():
        terms = row.terms
        fresh = sum(len(t) + 64 for t in terms if t not in known)
        if held and (len(held) >= QUERIES or size + fresh > TERM_BYTES):
            yield held
            held, size, known = [], 0, set()
            fresh = sum(len(t) + 64 for t in terms)
        held.append((row.item_id, terms))
        known.update(terms)
        size += fresh
    if held:
        yield held


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score: each item's k best documents with a score over 0.

    Terms are maximal runs of letters, digits and all that is not ASCII, A-Z folded,
    of whole texts. With N documents that have terms, L terms in all, n of a
    document's and df documents with a term: w = floor(1000 ln((2 N + 2) / (2 df + 1))),
    m = 50 + 50 n N div L, and a score sums w ((10^9 tf) div (1000 tf + 20 m)) over an
    item's distinct terms. Equal scores go by ascending doc_id, null last; repeated
    rows are documents of their own. Rows of items that are alike in id and text are
    one item; rows that share an id only are ranked each, as are rows without id. A
    null text has no terms. Without documents or items there are no rows.

    1. Items go in blocks of up to QUERIES with TERM_BYTES of terms, whose dictionary is
       broadcast; one pass over the documents keeps of each its length and the
       postings of the block's terms.
    2. Documents are dealt out into blocks of about POSTINGS postings. A task builds the
       inverted treaps of a block and takes every query through them, all terms
       at once, and returns k rows per query.
    3. The best k of all blocks are the result.

    A document's own postings are never dealt out: they are at most the block's terms.
    """
    spark = docs.sparkSession
    small_batches(spark)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked, asked_path = materialise_at(items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).distinct().select("item_id", distinct_terms(F.col("text")).alias("terms")), "search-items")
    schema = "item_id long, rank int, doc_id long, score long"
    found = spark.createDataFrame([], schema)
    for block in _blocks_of_queries(asked.orderBy("item_id", "terms")):
        found = found.unionByName(_block(given, block, k))
    drop_table(spark, asked_path)
    return found


def _block(given: DataFrame, block: list[tuple[int | None, list[str]]], k: int) -> DataFrame:
    """The result of one block of queries."""
    spark = given.sparkSession
    terms = sorted({t for _, own in block for t in own})
    place = {t: i for i, t in enumerate(terms)}
    dictionary = spark.sparkContext.broadcast(Dictionary(terms))
    postings, path = materialise_at(given.mapInArrow(_postings(dictionary), "doc_id long, n long, terms array<int>, tfs array<long>"), "search-postings")
    count, total, held = postings.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms").cast("long")), F.lit(0))).first()
    df = np.zeros(len(terms), np.int64)
    for r in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # a row per term of the block
        df[r.term] = r.df
    weights = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    plans = [np.array([place[t] for t in own], np.int64) for _, own in block]
    queries = spark.sparkContext.broadcast((plans, weights))
    blocks = max(1, -(-held // POSTINGS))
    length = F.expr(f"cast({100 - LENGTH_SHARE} + (({LENGTH_SHARE} * cast(n as decimal(17,0)) * cast({count} as decimal(19,0))) div cast({max(1, total)} as decimal(19,0))) as long)")
    dealt = postings.where(F.size("terms") > 0).select("doc_id", F.col("doc_id").isNull().alias("z"), "terms", "tfs", length.alias("m"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).alias("block"))
    best = dealt.repartition(blocks, "block").groupBy("block").applyInArrow(_searched(queries, k), "item long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "item long, item_id long")
    told = best.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
    found, _ = materialise_at(told, "search-found")
    drop_table(spark, path)
    return found
