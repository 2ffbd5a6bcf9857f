"""Sentence boundaries learnt without labels: abbreviations, sentence starters and collocations by log-likelihood ratios (after Kiss and Strunk, 2006)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.runtime import drop_table, materialise_at

# The published thresholds of the three ratios, and the chance of a period after an abbreviation.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
AFTER_ABBREVIATION = 0.99

SPACE = r"\x20\x09-\x0D"
#: A place where a sentence may end: its mark, closing quotes and brackets, white space.
MARK = rf"""([.!?]["')\]}}]*)([{SPACE}]+)"""
QUOTES = r"""^["'(\[{]+|["')\]}]+\z"""
CUT = "\u0001"


def core(token: Column) -> Column:
    """A token without quotes and brackets around it."""
    return F.regexp_replace(token, QUOTES, "")


def has_period(c: Column) -> Column:
    return c.rlike(r"[^.]\.\z")


def kind(c: Column) -> Column:
    """A token's type: in lower case, without its period."""
    return F.lower(F.when(has_period(c), F.regexp_replace(c, r"\.\z", "")).otherwise(c))


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, k, piece, last and next of every stretch up to a place where a sentence may end.

    Stretches keep their white space; last is the core of their last token, next that
    of the token after them (null at the end of a text).
    """
    return stretches(cut(docs, id_col, text_col)).select("row", "doc_id", "k", "piece", "last", "next")


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id and p, the stretches of every text."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.split(F.regexp_replace(text_col, MARK, f"$1$2{CUT}"), CUT).alias("p"))


def stretches(found: DataFrame) -> DataFrame:
    """The pieces of cut()."""
    first = lambda x: core(F.regexp_extract(x, rf"^[{SPACE}]*([^{SPACE}]+)", 1))
    last = core(F.regexp_extract(F.col("piece"), rf"([^{SPACE}]+)[{SPACE}]*\z", 1))
    after = F.when(F.col("k") < F.size("p") - 1, first(F.col("p")[F.col("k") + 1]))
    return found.select("*", F.posexplode("p").alias("k", "piece")).select("row", "doc_id", "k", "piece", last.alias("last"), F.nullif(after, F.lit("")).alias("next"))


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """type, ended (occurrences with a period) and free (without) of every token of all texts."""
    token = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(rf"([^{SPACE}]+)"), F.lit(1))).alias("t"))
    # Equal tokens are one first: patterns are for distinct ones.
    once = token.groupBy("t").agg(F.count("*").alias("n")).select(core(F.col("t")).alias("c"), "n").where("c <> ''")
    many = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0).cast("long")))
    return once.groupBy(kind(F.col("c")).alias("type")).agg(many(has_period(F.col("c"))).alias("ended"), many(~has_period(F.col("c"))).alias("free"))


def abbreviation_score(ended: Column, free: Column, type_: Column, total: Column, periods: Column) -> Column:
    """How much a type behaves like an abbreviation: the ratio of "a period nearly always" to "a period by chance", less for long types and those seen without one."""
    p = periods / total
    ratio = 2 * (ended * F.log(AFTER_ABBREVIATION / p) + free * F.log((1 - AFTER_ABBREVIATION) / (1 - p)))
    letters = F.length(F.replace(type_, F.lit("."), F.lit("")))
    return ratio * F.exp(-letters) * (1 + F.length(type_) - letters) * F.pow(letters, -free)


def _part(k: Column, n: Column, p: Column) -> Column:
    return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n - k > 0, (n - k) * F.log(1 - p)).otherwise(0.0)


def association(both: Column, first: Column, second: Column, total: Column) -> Column:
    """The log-likelihood ratio of two events that meet ``both`` times; 0 where they meet no more often than by chance."""
    k1, n1, k2, n2 = both.cast("double"), first.cast("double"), (second - both).cast("double"), (total - first).cast("double")
    ratio = 2 * (_part(k1, n1, k1 / n1) + _part(k2, n2, k2 / n2) - _part(k1, n1, second / total) - _part(k2, n2, second / total))
    return F.when((n2 > 0) & (k1 / n1 > k2 / n2), ratio).otherwise(0.0)


@dataclass
class Boundaries:
    """What was learnt: tables type, (type, score), (type, score), (first, second, score); and of the texts it was learnt from, their stretches and junctions."""

    counts: DataFrame
    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame
    paths: list[str]
    docs: DataFrame | None = None
    texts: DataFrame | None = None
    junctions: DataFrame | None = None

    def drop(self) -> None:
        for path in self.paths:
            drop_table(self.counts.sparkSession, path)


def _junctions(found: DataFrame) -> DataFrame:
    """Pieces with what their ends are: mark, w1 (type), w2, up and down (case of the next token)."""
    c = F.col("last")
    mark = F.when(c.rlike(r"[!?]\z"), "!").when(c.rlike(r"\.\.\z"), "..").when(has_period(c), ".").otherwise("")
    return found.select("*", mark.alias("mark"), kind(c).alias("w1"), kind(F.col("next")).alias("w2"), F.col("next").rlike(r"^\p{Lu}").alias("up"), F.col("next").rlike(r"^\p{Ll}").alias("down"))


def _between(texts: DataFrame) -> DataFrame:
    """row, k, mark, w1, w2, up and down where a stretch of cut() is followed by a token."""
    return _junctions(stretches(texts)).where("next is not null").select("row", "k", "mark", "w1", "w2", "up", "down")


NUMBER, INITIAL = r"^[0-9]+\z", r"^\p{L}\z"


def learn(docs: DataFrame, text_col: str = "text") -> Boundaries:
    """Abbreviations, sentence starters and collocations of all texts.

    * A type of letters (and periods) is an abbreviation if its score is at least
      ABBREVIATION.
    * A type is a sentence starter if it follows sure ends (``!``, ``?``, a period after
      what is no abbreviation, number or initial) with a ratio of at least STARTER.
    * Two types are a collocation if the second, no starter, follows the first, an
      abbreviation, number or initial with a period, with a ratio of at least COLLOCATION.

    Null texts hold nothing; without tokens nothing is learnt. Everything is counted
    over all texts by grouped sums; no text passes through one place.
    """
    spark, paths = docs.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        out, path = materialise_at(df, name)
        paths.append(path)
        return out

    counts = kept(token_counts(docs, text_col), "boundary-counts")
    total, periods = counts.agg(F.coalesce(F.sum(F.col("ended") + F.col("free")), F.lit(0)), F.coalesce(F.sum("ended"), F.lit(0))).first()
    total_, periods_ = F.lit(float(total)), F.lit(float(periods))
    score = abbreviation_score(F.col("ended"), F.col("free"), F.col("type"), total_, periods_)
    offered = counts.where((F.col("ended") > 0) & F.col("type").rlike(r"^\p{L}[\p{L}.]*\z")) if 0 < periods < total else counts.limit(0)
    abbreviations = kept(offered.select("type", score.alias("score")).where(F.col("score") >= ABBREVIATION), "abbreviations")
    texts = kept(cut(docs, docs.columns[0], text_col), "boundary-texts")
    junctions = kept(_between(texts), "boundary-junctions")
    ends = junctions.select("mark", "w1", "w2")
    ends = ends.join(abbreviations.select(F.col("type").alias("w1"), F.lit(True).alias("short")), "w1", "left")
    unsure = F.col("short").isNotNull() | F.col("w1").rlike(NUMBER) | F.col("w1").rlike(INITIAL)
    sure = ends.where((F.col("mark") == "!") | ((F.col("mark") == ".") & ~unsure))
    many = sure.count()
    uses = counts.select(F.col("type").alias("w2"), (F.col("ended") + F.col("free")).alias("uses"))
    starts = sure.groupBy("w2").agg(F.count("*").alias("both")).join(uses, "w2")
    starters = kept(starts.select(F.col("w2").alias("type"), association(F.col("both"), F.lit(float(max(1, many))), F.col("uses"), total_).alias("score")).where(F.col("score") >= STARTER), "starters")
    pairs = ends.where((F.col("mark") == ".") & unsure).groupBy("w1", "w2").agg(F.count("*").alias("both"))
    firsts = pairs.groupBy("w1").agg(F.sum("both").alias("first"))
    met = pairs.join(firsts, "w1").join(uses, "w2").join(starters.select(F.col("type").alias("w2")), "w2", "left_anti")
    collocations = kept(met.select("w1", "w2", association(F.col("both"), F.col("first"), F.col("uses"), total_).alias("score")).where(F.col("score") >= COLLOCATION), "boundary-pairs")
    return Boundaries(counts, abbreviations, starters, collocations, paths, docs if text_col == "text" else None, texts, junctions)


def learnt_sentences(docs: DataFrame, learnt: Boundaries, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pos (from 0) and sentence of every text, cut where ``learnt`` says.

    ``!`` and ``?`` end a sentence, as does a period after an ordinary word. After an
    abbreviation or initial it does if a capitalised sentence starter follows; after a
    number, unless the next word is in lower case; after more than one period, if a
    capital follows. A collocation is never cut. Sentences keep their inner white
    space and are stripped; blank ones, null and empty texts give none; repeated rows
    are cut each. U+0001 counts as the end of a stretch. Texts that ``learnt`` comes from
    (the same docs) are not read again; the result reads its tables, so drop() comes after.
    """
    if learnt.docs is docs and (id_col, text_col) == (docs.columns[0], "text"):
        texts, offered = learnt.texts, learnt.junctions
    else:
        texts, _ = materialise_at(cut(docs, id_col, text_col), "stretches")
        offered = _between(texts)
    # Only junctions that what was learnt decides meet it, without their text; what is kept of them is where no sentence ends.
    offered = offered.where(F.col("mark").isin(".", ".."))
    known = offered.join(learnt.abbreviations.select(F.col("type").alias("w1"), F.lit(True).alias("short")), "w1", "left").join(learnt.starters.select(F.col("type").alias("w2"), F.lit(True).alias("opens")), "w2", "left").join(learnt.collocations.select("w1", "w2", F.lit(True).alias("tied")), ["w1", "w2"], "left")
    short = F.col("short").isNotNull() | F.col("w1").rlike(INITIAL)
    ends = (
        F.when(F.col("mark") == "..", F.col("up")).when(F.col("tied").isNotNull(), False)
        .when(short, F.col("opens").isNotNull() & F.col("up")).when(F.col("w1").rlike(NUMBER), ~F.col("down")).otherwise(True)
    )
    inner = known.where(~ends).groupBy("row").agg(F.collect_list("k").alias("inner"))
    every = F.sequence(F.lit(0), F.size("p") - 1)
    whole = texts.where("p is not null").join(inner, "row", "left").select("doc_id", "p", F.when(F.col("inner").isNull(), every).otherwise(F.array_except(every, "inner")).alias("ends"))
    starts = F.concat(F.array(F.lit(0)), F.transform("ends", lambda e: e + 1))  # one more than there are ends
    spans = F.filter(F.arrays_zip(starts.alias("start"), F.col("ends").alias("end")), lambda z: z["end"].isNotNull())
    sentence = F.transform(spans, lambda z: F.regexp_replace(F.array_join(F.slice("p", z["start"] + 1, z["end"] - z["start"] + 1), ""), rf"^[{SPACE}]+|[{SPACE}]+\z", ""))
    return whole.select("doc_id", F.posexplode(F.filter(sentence, lambda s: s != "")).alias("pos", "sentence"))
