"""Session, shared-folder and materialisation helpers."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (tests on one machine) is a temporary folder made and remembered.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.twinweave.sharedDir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="twinweave-")
        spark.conf.set("spark.twinweave.sharedDir", at)
    return at.rstrip("/")


_owned: set[str] = set()


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's tables; it goes when the driver's program ends, or with release()."""
    at = f"{shared_dir(spark)}/twinweave/{spark.sparkContext.applicationId}"
    if at not in _owned:
        _owned.add(at)
        atexit.register(_forget, spark, at)
    return at


def _forget(spark: SparkSession, at: str) -> None:
    if spark.sparkContext._jsc is not None:  # a stopped session can't reach the store any more
        with contextlib.suppress(Exception):
            drop_table(spark, at)


def release(spark: SparkSession) -> None:
    """Deletes all tables of this application in the shared folder: for callers whose results are written."""
    drop_table(spark, run_folder(spark))


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back.

    The table cuts the lineage and outlives lost executors; a retried task
    writes the same rows again and Spark's committer keeps one attempt.
    """
    return materialise_at(df, name, codec)[0]


def materialise_at(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """As materialise, with the path, for a caller that drops the table later."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes a table that no later plan reads."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as double underscores) for the plans that run inside; restored after."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """Bounds Arrow batches by bytes for the rest of the session, unless the session has set its own bound.

    Spark's default of 64 MB is held several times over by a task and its Python
    worker; rows of whole texts reach it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "64MB").lower() in ("64mb", "64m", "67108864", "67108864b"):
        spark.conf.set(name, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
