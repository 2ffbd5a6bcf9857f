"""Training-corpus pipeline: stages from raw documents to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.llm import mixing
from twinweave.llm.language_id import UNKNOWN, identify, train
from twinweave.llm.line_dedup import line_dedup
from twinweave.llm.mixing import WORD
from twinweave.llm.ngram_join import jaccard_components
from twinweave.llm.packing import pack
from twinweave.llm.queries import tokenizer_path
from twinweave.runtime import materialise, table

#: Documents whose language is less sure than this are rejected.
SURE = 0.5
#: No SQL: a network and a tokenizer take part. tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None

_OTHERS = ("lang", "source")


def _columns(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return df.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


#: A row: two hashes of all columns, which only rows alike in every column share.
_KEY = ["key", "key2"]


def _keyed(docs: DataFrame) -> DataFrame:
    """With the columns of _KEY; rows alike in everything are interchangeable."""
    given = [*(F.col(c) for c in ("doc_id", "text", *_OTHERS)), *(F.col(c).isNull() for c in ("doc_id", "text", *_OTHERS))]
    return docs.withColumn("key", F.xxhash64(*given)).withColumn("key2", F.xxhash64(F.lit(1), *given))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; ``und`` and unsure ones go.

    Null texts and texts without a letter are ``und``. Rows are judged one by one, so
    repeated rows and ids, and rows without id, are treated alike; with too few
    languages to learn from, as in an empty table, nothing is known.
    """
    found = identify(docs, train(docs), keep=("text", *_OTHERS))
    return _columns(found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= SURE)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those that nothing is left of go.

    Of copies the run in the least doc_id stays (null last). Rows alike in id and text
    are one document and stay alike; null and empty texts stay as they are.
    """
    return _columns(line_dedup(docs, keep=_OTHERS).where((F.col("lines_removed") == 0) | F.col("text").rlike(WORD)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the least doc_id (null last).

    Rows without words are no copies and all stay. Rows that share an id but not
    their text are told apart by all their columns; of rows alike in every column
    that hold words one stays. Ties in doc_id go by a hash of the row.
    """
    keyed = _keyed(docs)
    groups = jaccard_components(keyed, id_col="key").select(F.col("doc_id").alias("key"), "component_id")
    first = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "key")
    stay = groups.join(keyed.select("key", "doc_id").distinct(), "key").groupBy("component_id").agg(F.min(first)["key"].alias("key")).select("key")
    wordy = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    return _columns(keyed.where(wordy).join(stay, "key", "left_semi").dropDuplicates(_KEY)).unionByName(_columns(docs.where(~wordy)))


def mix(docs: DataFrame, row_cols: tuple[str, ...] = ()) -> DataFrame:
    """The mix in whole documents."""
    return mixing.mix(docs, whole=True, row_cols=row_cols)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, always whole.

    Rows alike in every column are interchangeable; rows that share an id only, or
    have none, are taken each for itself. Documents without words, which no mix
    takes, go.
    """
    keyed = _keyed(docs)
    copies = F.expr("cast(taken div size as int)")
    taken = mix(keyed, tuple(_KEY)).where("taken > 0").groupBy(*_KEY).agg(F.sum(copies).cast("int").alias("copies"))
    rows = keyed.select(*_KEY, "doc_id", "text", *_OTHERS).dropDuplicates(_KEY).join(taken, _KEY)
    return _columns(rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids; a null text is empty, repeated rows are packed each."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; every stage but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
