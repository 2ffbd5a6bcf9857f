"""Repeated line runs by a suffix array over line ids, built by prefix doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinweave.runtime import drop_table, materialise, materialise_at

WORD = r"[^\x20\x09-\x0D]+"
#: Words that a repeated run of lines has at least.
MIN_WORDS = 25

#: A document: two hashes of its id and text. A suffix: its document and the number of its first line.
_DOC = ["k", "k2"]
_PLACE = ["z", "o", "k", "k2", "p"]


_SPACES = " \t\n\x0b\x0c\r"


def _words(c: str) -> Column:
    """Words of a line without white space at its ends; where single spaces alone part them, their number tells."""
    odd = F.lit(False)
    for x in ("  ", *_SPACES[1:]):
        odd = odd | F.contains(F.col(c), F.lit(x))
    return F.when(odd | (F.col(c) == ""), F.regexp_count(c, F.lit(WORD))).otherwise(F.octet_length(c) - F.octet_length(F.replace(F.col(c), F.lit(" "))) + 1).cast("int")


def ranked(keys: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct ``keys`` with an order-preserving ``rank``.

    A range partitioning with a sort inside gives each task a stretch of the order,
    so the running id of partition and row is a global rank (with gaps).
    """
    ordered = keys.distinct().repartitionByRange(*columns).sortWithinPartitions(*columns)
    return materialise(ordered.withColumn("rank", F.monotonically_increasing_id()), "suffix-rank")


def _following(column: str, n: int, order) -> Column:
    """``column`` of the suffix n lines on, null if a line between occurs once only."""
    return F.when(F.lead("p", n).over(order) == F.col("p") + n, F.lead(column, n).over(order)) if n else F.col(column)


def suffix_ranks(first: DataFrame, levels: int) -> DataFrame:
    """first (with p, r0) and r1, r2, ...: ranks of 2, 4, ... lines from the ranks of their halves."""
    state, path = materialise_at(first, "suffix-0")
    order = Window.partitionBy(*_DOC).orderBy("p")
    for level in range(levels - 1):
        halves = state.withColumn("second", _following(f"r{level}", 1 << level, order))
        ranks = ranked(halves.where("second is not null").select(F.col(f"r{level}").alias("h1"), F.col("second").alias("h2")), ["h1", "h2"])
        named = ranks.select(F.col("h1").alias(f"r{level}"), F.col("h2").alias("second"), F.col("rank").alias(f"r{level + 1}"))
        following, following_path = materialise_at(halves.join(named, [f"r{level}", "second"], "left").drop("second"), f"suffix-{level + 1}")
        drop_table(first.sparkSession, path)
        state, path = following, following_path
    return state


def _intervals(state: DataFrame, min_words: int, levels: int) -> DataFrame:
    """The suffixes in intervals of the array whose common prefix has ``min_words`` words.

    ``m`` lines reach them; an interval of m lines is named by the ranks of its
    first and its last 2^j lines, 2^j <= m < 2^(j+1).
    """
    order, head, tail = Window.partitionBy(*_DOC).orderBy("p"), F.lit(None).cast("long"), F.lit(None).cast("long")
    for j in range(levels):
        head = F.when((F.col("m") >= 1 << j) & (F.col("m") < 2 << j), F.col(f"r{j}")).otherwise(head)
        for m in range(1 << j, min(2 << j, min_words + 1)):
            tail = F.when(F.col("m") == m, _following(f"r{j}", m - (1 << j), order)).otherwise(tail)
    named = state.withColumn("head", head).withColumn("tail", tail).where(F.col("in_run") >= min_words)
    named = materialise(named.where("head is not null and tail is not null").select(*_PLACE, "m", "head", "tail"), "suffix-runs")
    open_ = materialise(named.groupBy("m", "head", "tail").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "suffix-intervals")
    return named.join(open_, ["m", "head", "tail"], "left_semi").select(*_PLACE)


def earlier_prefixes(starts: DataFrame, state: DataFrame, levels: int) -> DataFrame:
    """starts with ``len``: lines of its longest common prefix with any earlier suffix, below 2^levels.

    The suffixes that share len lines are an interval of the array. From the
    longest step down, each suffix tries 2^j more lines: those that share them form
    an interval inside, and all but its least member go on there. That member stands
    for the interval at shorter steps, so every suffix meets an earlier one if any
    shares the lines.
    """
    spark = starts.sparkSession
    rows, path = materialise_at(starts.select(*_PLACE, F.lit(0).alias("len"), F.lit(-1).cast("long").alias("name"), *[F.col(c).alias(f"t_{c}") for c in _PLACE]), "suffix-lcp")
    for j in range(levels - 1, -1, -1):
        least = rows.where("len > 0").select("len", "name", *[f"t_{c}" for c in _PLACE]).distinct()
        least = least.select(*[F.col(f"t_{c}").alias(c) for c in _PLACE], "len", "name", *[f"t_{c}" for c in _PLACE], F.lit(False).alias("own"))
        members = rows.withColumn("own", F.lit(True)).unionByName(least).withColumn("q", F.col("p") + F.col("len"))
        further = state.select(*_DOC, F.col("p").alias("q"), F.col(f"r{j}").alias("r"))
        members, members_path = materialise_at(members.join(further, [*_DOC, "q"], "left"), "suffix-members")
        inside = members.where("r is not null").groupBy("name", "r").agg(F.min(F.struct(*_PLACE)).alias("f"), F.count("*").alias("n")).where("n > 1")
        inside, inside_path = materialise_at(inside.select("name", "r", "f", F.monotonically_increasing_id().alias("id")), "suffix-inside")
        met = members.where("own").join(inside, ["name", "r"], "left")
        goes = F.col("f").isNotNull() & (F.struct(*_PLACE) != F.col("f"))
        met = met.withColumn("goes", F.coalesce(goes, F.lit(False)))
        following, following_path = materialise_at(
            met.select(
                *_PLACE, (F.col("len") + F.when(F.col("goes"), 1 << j).otherwise(0)).alias("len"), F.when(F.col("goes"), F.col("id") * levels + j).otherwise(F.col("name")).alias("name"),
                *[F.when(F.col("goes"), F.col(f"f.{c}")).otherwise(F.col(f"t_{c}")).alias(f"t_{c}") for c in _PLACE],
            ), "suffix-lcp",
        )
        for p in (path, members_path, inside_path):
            drop_table(spark, p)
        rows, path = following, following_path
    return rows.select(*_PLACE, "len").where("len > 0")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row with later copies of repeated line runs deleted.

    Returns doc_id, text, lines_removed and the columns in ``keep``. Lines are
    parted by line feeds and compared without white space at their ends; blank
    lines are stepped over and always stay. A run of lines that holds at least
    ``min_words`` words and occurs more than once stays where its doc_id (null
    last), then its first line, is least; all lines inside its other copies go.
    Runs don't cross documents, copies in one document may overlap. Rows alike in
    id and text are one document and stay alike; rows without id come in order of a
    hash. A null text stays null with 0 removed; an empty table gives no rows.

    Only lines that occur more than once take part. The suffix array over their
    ids is built by prefix doubling: ranks of 1, 2, 4, ... lines, each from the
    ranks of two halves. Intervals of the array whose common prefix reaches
    ``min_words`` words hold all suffixes that open a repeated run. For each of
    them, the longest common prefix with an earlier suffix is its maximal repeated
    run, and that later copy goes. It is sought up to as many lines as can be needed
    for ``min_words`` words: every line of a longer run lies in such a prefix of a
    suffix further on, or of the run's first one, so the whole run goes.

    Ranks and intervals are aggregated before they are joined, so a very common line
    is one key on one side; documents are never gathered beyond their own lines.
    Lines and documents are known by two 64-bit hashes.
    """
    text, doc_id = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    base = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, text).alias("k"), F.xxhash64(F.lit(1), doc_id, text).alias("k2"), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)])
    exploded = base.select(*_DOC, "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "s")).select(*_DOC, "doc_id", "line", F.btrim("s", F.lit(_SPACES)).alias("s"))
    lines = exploded.select(*_DOC, "doc_id", "line", F.when(F.col("s") != "", F.xxhash64("s")).alias("id"), F.xxhash64(F.lit(1), "s").alias("id2"), _words("s").alias("words"))
    lines = materialise(lines.repartition(*_DOC).dropDuplicates([*_DOC, "line"]), "line-ids")

    levels = min_words.bit_length()  # 2^levels - 1 lines hold min_words words
    filled = lines.where("id is not null")
    repeated = filled.groupBy("id", "id2").agg(F.count("*").alias("n")).where("n > 1").select("id", "id2")
    in_doc = Window.partitionBy(*_DOC).orderBy("line")
    numbered = filled.withColumn("p", F.row_number().over(in_doc)).withColumn("before", F.coalesce(F.sum("words").over(in_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    reach = Window.partitionBy(*_DOC).orderBy("before").rangeBetween(Window.currentRow, min_words - 1)
    runs = numbered.withColumn("m", F.count("*").over(reach).cast("int")).withColumn("in_run", F.sum("words").over(reach).cast("int"))
    first = runs.join(ranked(repeated, ["id", "id2"]), ["id", "id2"]).select(
        F.col("doc_id").isNull().alias("z"), F.coalesce("doc_id", F.lit(0)).alias("o"), *_DOC, "p", "line", "before", "words", "m", "in_run", F.col("rank").alias("r0")
    )
    state = suffix_ranks(first, levels)
    starts = materialise(_intervals(state, min_words, levels), "suffix-starts")
    state = state.join(starts.select(*_DOC).distinct(), _DOC, "left_semi")
    state = materialise(state.select(*_DOC, "p", "line", "before", "words", *[f"r{j}" for j in range(levels)]), "suffix-open")
    copies = earlier_prefixes(starts, state, levels).select(*_DOC, "p", (F.col("p") + F.col("len") - 1).alias("last"))
    # A copy goes if it has the words: from the words before its first line to those through its last.
    ends = state.select(*_DOC, F.col("p").alias("last"), (F.col("before") + F.col("words")).alias("upto"))
    copies = copies.join(state.select(*_DOC, "p", "before"), [*_DOC, "p"]).join(ends, [*_DOC, "last"]).where(F.col("upto") - F.col("before") >= min_words)
    gone = copies.select(*_DOC, F.explode(F.sequence("p", "last")).alias("p")).distinct()
    gone = materialise(gone.join(state.select(*_DOC, "p", "line"), [*_DOC, "p"]).select(*_DOC, "line"), "line-gone")
    touched = lines.join(gone.select(*_DOC).distinct(), _DOC, "left_semi").join(gone.withColumn("gone", F.lit(True)), [*_DOC, "line"], "left")
    flags = touched.groupBy(*_DOC).agg(F.transform(F.sort_array(F.collect_list(F.struct("line", F.coalesce("gone", F.lit(False)).alias("g")))), lambda x: x["g"]).alias("flags"))
    split = F.split("text", "\n", -1)
    rebuilt = F.array_join(F.filter(split, lambda x, i: ~F.get(F.col("flags"), i)), "\n")
    return base.join(flags, _DOC, "left").select(
        "doc_id", F.when(F.col("flags").isNull(), F.col("text")).otherwise(rebuilt).alias("text"),
        F.when(F.col("flags").isNull(), 0).otherwise(F.size(F.filter("flags", lambda g: g))).cast("long").alias("lines_removed"),
        *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)],
    )
