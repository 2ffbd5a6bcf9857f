"""Phrase collocations: contiguous pattern growth over projected occurrence pointers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinweave.llm.ngram_join import marked
from twinweave.llm.pieces import give_back, mixed, run_names, runs_alike
from twinweave.runtime import drop_table, materialise_at, settings, small_batches

#: Occurrences a phrase needs.
LEAST = 10
#: Words of a phrase.
MOST_WORDS = 3
#: A phrase goes if a longer one that holds it has this share (%) of its occurrences.
COVERED = 50
#: Phrases told per language.
TOP = 2_000
#: Bytes of text whose words and contexts are counted together before they leave a task.
GROUP = 8 << 20
#: Pointers that one growth task takes; a word with more is hot, and phrases that begin with it are dealt out by their next word.
POINTERS = 400_000
#: Shares in which a language's phrases are ranked before they meet.
SHARES = 32
#: Hot words: a bound on what is broadcast.
SPLIT_BOUND = 500_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_CUTS, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_CUTS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SPACE[[0x20, 0x09]] = True


def words_of(texts: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, pieces, names) of all words of whole texts, A-Z folded; words of one piece share its number."""
    data = _FOLD[np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)]
    cuts = _CUTS[data]
    outside = cuts | _SPACE[data]
    starts = np.flatnonzero(outside[:-1] & ~outside[1:]) + 1
    ends = np.flatnonzero(~outside[:-1] & outside[1:]) + 1
    names = run_names(data, starts, ends, seed)
    return data, starts, ends, np.cumsum(cuts, dtype=np.int64)[starts], np.where(names == 0, np.uint64(1), names)  # 0 is no word


def _by_language(batches):
    """(lang, texts) of runs of about GROUP bytes; the last column is the text, the first one the language."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            text = text.as_py()
            if text:
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= GROUP:
                    yield from held.items()
                    held, size = {}, 0
    yield from held.items()


def _counted(seed: int):
    """lang, word, name, n of the distinct words of each run of texts."""

    def run(batches):
        for lang, texts in _by_language(batches):
            data, starts, ends, _, names = words_of(texts, seed)
            _, first, same, n = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
            if not runs_alike(data, starts, ends, first[same]):  # two words share a name: each goes by itself, and the vocabulary shows it
                first, n = np.arange(len(starts)), np.ones(len(starts), np.int64)
            raw = data.tobytes()
            for i in range(0, len(first), 100_000):
                some = first[i : i + 100_000]
                words = pa.array([raw[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), words, pa.array(names[some].view(np.int64)), pa.array(n[i : i + 100_000])], names=["lang", "word", "name", "n"])
        give_back()

    return run


def _salt(lang: str, names: np.ndarray) -> np.ndarray:
    """Names that also tell the language."""
    key = np.frombuffer(lang.encode(), np.uint8)
    return mixed(names + run_names(key, np.array([0]), np.array([len(key)]), 1))


def _projected(seed: int, most: int, marks, splits, buckets: int):
    """bucket, lang, pointers: the distinct pointers of a run of texts, each with the words right of it.

    A pointer stands for a place of a frequent word; as equal contexts grow alike,
    they are one pointer with a weight. A word that is not frequent ends a context,
    as a piece's end does; a context of one word grows nothing and is left out. The
    pointers of a run that go to one bucket are one row, column after column.
    """

    def run(batches):
        hot = splits.value
        for lang, texts in _by_language(batches):
            _, _, _, pieces, names = words_of(texts, seed)
            if marks is not None:
                at = _salt(lang, names) & np.uint64(8 * len(marks.value) - 1)
                names = np.where(marks.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1, names, np.uint64(0))
            right = [names]
            for k in range(1, most):
                onward = np.zeros(len(names), np.uint64)
                if len(names) > k:
                    onward[:-k] = np.where((pieces[:-k] == pieces[k:]) & (right[-1][:-k] != 0), names[k:], np.uint64(0))
                right.append(onward)
            use = right[1] != 0
            right = [r[use] for r in right]
            if not use.any():
                continue
            # How many words from the first on are hot: a word decides the bucket only if all before it are.
            run_of_hot, bucket = np.zeros(len(right[0]), np.uint64), _salt(lang, right[0])
            for k, r in enumerate(right[:-1]):
                held = _salt(lang, r)
                at = np.minimum(np.searchsorted(hot, held), max(0, len(hot) - 1))
                run_of_hot += (run_of_hot == k) & (r != 0) & (hot[at] == held) if len(hot) else np.uint64(0)
                bucket = np.where(run_of_hot > k, mixed(bucket + right[k + 1]), bucket)
            bucket = mixed(bucket) % np.uint64(buckets)
            order = np.lexsort([*right[::-1], bucket])
            bucket, right, run_of_hot = bucket[order], [r[order] for r in right], run_of_hot[order]
            fresh = np.concatenate([[True], np.logical_or.reduce([r[1:] != r[:-1] for r in right])])
            first = np.flatnonzero(fresh)
            weight = np.diff(np.append(first, len(order))).astype(np.uint64)
            columns = [*(r[first] for r in right), weight << np.uint64(8) | run_of_hot[first]]
            begin = np.flatnonzero(np.concatenate([[True], bucket[first][1:] != bucket[first][:-1]]))
            end = np.append(begin[1:], len(first))
            for i in range(0, len(begin), 4_096):
                rows = [np.concatenate([c[x:y] for c in columns]).tobytes() for x, y in zip(begin[i : i + 4_096].tolist(), end[i : i + 4_096].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[first][begin[i : i + 4_096]].astype(np.int64)), pa.array([lang] * len(rows), pa.string()), pa.array(rows, pa.binary())], names=["bucket", "lang", "pointers"])
        give_back()

    return run


def grow(right: list[np.ndarray], n: np.ndarray, hot: np.ndarray, least: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(phrases, counts) of 2 words and more grown from pointers, depth first.

    right[k] is each pointer's k-th word, right[0] the prefix; n weighs it. Pointers
    are sorted by their contexts, so a phrase's projection is a stretch of them, and
    its extensions are stretches of that, visited from left to right. A stretch with
    fewer than ``least`` occurrences is not extended, unless the phrase is made of hot
    words only (``hot`` counts them from the first on), so that some of its pointers
    lie in other tasks: then its count is told as it is.
    """
    order = np.lexsort(right[::-1])
    right, n, hot = [r[order] for r in right], n[order], hot[order]
    sums = np.concatenate([[0], np.cumsum(n)])
    found: list[tuple[int, int, int]] = []  # (a place of the phrase, words, count)
    most = len(right)
    stack = [(0, len(n), 0)]
    while stack:
        low, high, depth = stack.pop()
        word = right[depth][low:high]
        cuts = np.flatnonzero(word[1:] != word[:-1]) + 1
        begin = np.concatenate([[low], low + cuts])
        end = np.append(begin[1:], high)
        counts = sums[end] - sums[begin]
        keep = (right[depth][begin] != 0) & ((counts >= least) | (depth + 1 < most) & (hot[begin] > depth))
        begin, end, counts = begin[keep], end[keep], counts[keep]
        if depth:
            found.extend(zip(begin.tolist(), [depth + 1] * len(begin), counts.tolist(), strict=True))
        if depth + 1 < most:
            stack.extend((a, b, depth + 1) for a, b in zip(begin[::-1].tolist(), end[::-1].tolist(), strict=True))
    place, size, count = np.array(found, np.int64).reshape(-1, 3).T.copy()
    return [np.where(size > k, right[k][place], np.uint64(0)) for k in range(most)], count


def _growth(most: int, least: int):
    def run(rows: pa.Table) -> pa.Table:
        of: dict[str, list[np.ndarray]] = {}
        for lang, pointers in zip(rows.column("lang").to_pylist(), rows.column("pointers"), strict=True):
            of.setdefault(lang, []).append(np.frombuffer(pointers.as_py(), np.uint64).reshape(most + 1, -1))
        out = []
        for lang, some in of.items():
            columns = np.concatenate(some, axis=1)
            phrases, counts = grow(list(columns[:-1]), (columns[-1] >> np.uint64(8)).astype(np.int64), (columns[-1] & np.uint64(255)).astype(np.int64), least)
            out.append(pa.table([pa.array([lang] * len(counts), pa.string()), *(pa.array(p.view(np.int64)) for p in phrases), pa.array(counts)], names=["lang", *(f"w{k}" for k in range(1, most + 1)), "n"]))
        give_back()
        return pa.concat_tables(out)

    return run


def vocabulary(given: DataFrame, counter=_counted) -> tuple[DataFrame, str, int]:
    """(lang, word, name and n of every word; its path; the seed of the names).

    A name tells a word within its language: should two words share one, the names
    are made anew from another seed.
    """
    seed = 0
    while True:
        counted = given.mapInArrow(counter(seed), "lang string, word string, name long, n long").groupBy("lang", "word", "name").agg(F.sum("n").alias("n"))
        words, path = materialise_at(counted, "phrase-words")
        if words.groupBy("lang", "name").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
            return words, path, seed
        drop_table(given.sparkSession, path)
        seed += 1


def _hot_words(frequent: DataFrame) -> np.ndarray:
    """The salted names, sorted, of the words with more than POINTERS occurrences, at most SPLIT_BOUND of them."""
    bound = POINTERS
    while (hot := frequent.where(F.col("n") > bound)).count() > SPLIT_BOUND:
        bound *= 2
    return np.sort(np.array([r.token for r in _salted(hot).collect()], np.int64).view(np.uint64))  # at most SPLIT_BOUND rows


def _salted(words: DataFrame) -> DataFrame:
    """token: the names of words(lang, name, ...) that also tell the language."""

    def run(batches):
        for batch in batches:
            langs, names = batch.column(0).to_pylist(), np.asarray(batch.column(1)).view(np.uint64)
            token = np.zeros(len(names), np.uint64)
            for lang in set(langs):
                own = np.array([x == lang for x in langs])
                token[own] = _salt(lang, names[own])
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64))], names=["token"])

    return words.select("lang", "name").mapInArrow(run, "token long")


def _key(first: int, words: int) -> Column:
    """The names of words first, ..., first + words - 1 as one array."""
    return F.array(*(F.col(f"w{k}") for k in range(first, first + words)))


def exact_score(a: str, left: str, right: str) -> Column:
    """floor(10^6 a^2 / (left right)) of counts up to 10^16, in decimals of 38 digits."""
    d = lambda c: f"cast({c} as decimal(19,0))"
    return F.expr(f"cast((cast(1000000 * {d(a)} as decimal(38,0)) * {d(a)}) div ({d(left)} * {d(right)}) as long)")


def frequent_phrases(docs: DataFrame, least: int = LEAST, most: int = MOST_WORDS, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, list[str]]:
    """(phrases lang, w1, ..., size and n; words lang, word, name and n; paths): all phrases of 2 to ``most`` words with ``least`` occurrences.

    Counts are exact. A null text is empty, a null language ``und``. The caller drops the paths.
    """
    spark = docs.sparkSession
    small_batches(spark)
    given = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    words, words_path, seed = vocabulary(given)
    frequent = words.where(F.col("n") >= least)
    tokens, tokens_path = materialise_at(_salted(frequent), "phrase-tokens")
    marks = marked(tokens)
    drop_table(spark, tokens_path)
    splits = spark.sparkContext.broadcast(_hot_words(frequent))
    pointers = frequent.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, int(-(-pointers // POINTERS)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = [f"w{k}" for k in range(1, most + 1)]
    fields = ", ".join(f"{w} long" for w in names)
    contexts = given.mapInArrow(_projected(seed, most, marks, splits, buckets), "bucket long, lang string, pointers binary")
    grown = contexts.groupBy("bucket").applyInArrow(_growth(most, least), f"lang string, {fields}, n long")
    size = sum((F.col(w) != 0).cast("int") for w in names).alias("size")
    # Counts of phrases of hot words come from several tasks.
    found, path = materialise_at(grown.groupBy("lang", *names).agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", *names, size, "n"), "phrases")
    return found, words, [words_path, path]


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST_WORDS, covered: int = COVERED, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` collocations.

    Texts, A-Z folded, are split at ``. , ; : ! ?`` and line ends into pieces, those
    into words at blanks and tabs. n counts a language's words, a a phrase's
    occurrences. Cut after its first k words, l and r are the occurrences of both
    parts and the score is floor(10^6 a^2 / (l r)), in exact decimals; the least cut
    counts, of equal ones the first. A phrase goes if a longer frequent one that holds
    it has ``covered`` % of its occurrences. Order: score and a descending, phrase by
    UTF-8 bytes. A null text is empty, a null language ``und``; repeated rows count
    each; an empty table gives no rows; other columns are not read.

    1. Words are counted within tasks and then by Spark; each is known by a 64-bit
       name that is proven unique within its language.
    2. Every place of a frequent word is a pointer with the words right of it. Equal
       pointers of a run of texts meet in the task; then whole prefixes go to growth
       tasks of about POINTERS pointers. A hot prefix is dealt out by its next word,
       and if that is hot too by the one after, so no key is a task's load.
    3. A task grows its prefixes to the right, depth first.
    4. Counts of parts come by joins of frequent phrases only: a part of a frequent
       phrase is frequent.
    """
    spark = docs.sparkSession
    phrases, words, paths = frequent_phrases(docs, least, most, text_col, lang_col)
    names = [f"w{k}" for k in range(1, most + 1)]
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    single = words.where(F.col("n") >= least)
    parts = single.select("lang", F.array("name").alias("key"), "n")
    longer = []
    for size in range(2, most + 1):
        own = phrases.where(F.col("size") == size)
        if size < most:
            parts = parts.unionByName(own.select("lang", _key(1, size).alias("key"), "n"))
        if size > 2:  # every shorter phrase inside, with this one's occurrences
            inside = F.array(*(_key(i, k) for k in range(2, size) for i in range(1, size - k + 2)))
            longer.append(own.select("lang", F.explode(inside).alias("key"), "n"))
    parts, parts_path = materialise_at(parts, "phrase-parts")
    scored = None
    for size in range(2, most + 1):
        own = phrases.where(F.col("size") == size).withColumnRenamed("n", "a").withColumn("key", _key(1, size))
        for k in range(1, size):
            left, right = (parts.where(F.size("key") == s).select("lang", F.col("key").alias(f"{side}_key"), F.col("n").alias(f"{side}{k}")) for side, s in (("l", k), ("r", size - k)))
            own = own.withColumn("l_key", _key(1, k)).withColumn("r_key", _key(k + 1, size - k)).join(left, ["lang", "l_key"]).join(right, ["lang", "r_key"]).drop("l_key", "r_key")
        cuts = [F.struct(exact_score("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, size)]
        own = own.withColumn("cut", F.least(*cuts) if len(cuts) > 1 else cuts[0]).select("lang", "key", "a", "cut.l", "cut.r", "cut.score")
        scored = own if scored is None else scored.unionByName(own)
    if longer:
        cover = longer[0]
        for more in longer[1:]:
            cover = cover.unionByName(more)
        cover = cover.groupBy("lang", "key").agg(F.max("n").alias("cover"))
        scored = scored.join(cover, ["lang", "key"], "left").where(F.col("cover").isNull() | (100 * F.col("cover") < covered * F.col("a"))).drop("cover")
    # Only rows at or over the last score and count of a language's first ``top`` can be told.
    scored, scored_path = materialise_at(scored, "phrase-scores")
    rank = lambda *by, within=("lang",): F.row_number().over(Window.partitionBy(*within).orderBy(F.desc("score"), F.desc("a"), *by))
    # A language's rows are ranked in SHARES first, so that its final ranking reads no more than SHARES times ``top``.
    shared = lambda df, *by: df.withColumn("share", F.pmod(F.xxhash64("key"), F.lit(SHARES))).withColumn("k", rank(*by, within=("lang", "share"))).where(F.col("k") <= top).drop("share", "k")
    last = shared(scored.select("lang", "key", "score", "a")).withColumn("k", rank()).where(F.col("k") <= top).groupBy("lang").agg(F.min(F.struct("score", "a")).alias("last"))
    near = scored.join(last, "lang").where(F.struct("score", "a") >= F.col("last")).drop("last")
    word = single.select("lang", F.col("name").alias("one"), "word")
    spelt = near.select("*", F.posexplode("key").alias("pos", "one")).join(word, ["lang", "one"]).groupBy("lang", "key", "a", "l", "r", "score").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]), " ").alias("phrase"))
    told = shared(spelt, "phrase").withColumn("rank", rank("phrase")).where(F.col("rank") <= top).join(total, "lang")
    with settings(spark, spark__sql__optimizer__windowGroupLimitThreshold=str(top)):  # tasks pass on no more than ``top`` rows of a language
        found, _ = materialise_at(told.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"), "collocations")
    for path in (*paths, parts_path, scored_path):
        drop_table(spark, path)
    return found
