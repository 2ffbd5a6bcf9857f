"""Article files: a header, a line of dashes, a body."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.functions.text import fold_lines, sanitize_filename, strip

SEPARATOR = "---\n"
#: Files that are written side by side (by a task, or by the driver), and how many of them a writer gets at once.
WRITERS, FILES = 16, 250
#: Characters of articles that a reading task passes on at once.
READ = 4_000_000


def split_article(content: Column, key_prefix: str) -> tuple[Column, Column]:
    """(key, body): the key line of the header, and what follows the first separator.

    Without a separator the whole text serves as both.
    """
    at = F.instr(content, SEPARATOR)
    header = F.when(at > 0, content.substr(F.lit(1), at - 1)).otherwise(content)
    body = F.when(at > 0, content.substr(at + len(SEPARATOR), F.length(content))).otherwise(content)
    key = strip(F.regexp_extract(header, f"(?m)^{key_prefix}(.*)$", 1))
    return F.nullif(key, F.lit("")), strip(body)


def _reachable(spark: SparkSession, folder: str) -> str | None:
    """The folder's URI if it is a folder whose files Python can read and write in the tasks, else None."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(at) or not store.getFileStatus(at).isDirectory():
        return None
    uri = store.makeQualified(at).toUri().toString()
    uri = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
    try:
        pafs.FileSystem.from_uri(uri)
    except (pa.ArrowException, OSError):  # a store that only Spark reaches
        return None
    return uri.rstrip("/")


def _names(uri: str) -> Iterator[str]:
    """The names of the .txt files in a folder, hidden ones left out."""
    store, at = pafs.FileSystem.from_uri(uri)
    if isinstance(store, pafs.LocalFileSystem):
        with os.scandir(at) as found:
            names = (x.name for x in found if x.is_file())
            yield from (n for n in names if n.endswith(".txt") and n[0] not in "._")
    else:
        names = (x.base_name for x in store.get_file_info(pafs.FileSelector(at)) if x.is_file)
        yield from (n for n in names if n.endswith(".txt") and n[0] not in "._")


def _read_files(spark: SparkSession, uri: str) -> DataFrame:
    """path, value of the .txt files of a folder: one task lists them, and all read them, so the driver sees no name."""

    def listed(batches):
        for batch in batches:
            if batch.num_rows:
                names = _names(uri)
                while some := list(islice(names, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["name"])

    def read(batches):
        store, at = pafs.FileSystem.from_uri(uri)
        out = lambda held: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.string(), pa.binary()), strict=True)], names=["path", "value"])

        def content(name: str) -> tuple[str, bytes]:
            with store.open_input_stream(f"{at}/{name}") as f:
                return f"{uri}/{quote(name)}", f.read()

        with ThreadPoolExecutor(WRITERS) as pool:
            for batch in batches:
                names, held, size = iter(batch.column(0).to_pylist()), [], 0
                while some := list(islice(names, FILES)):
                    for row in pool.map(content, some):
                        held.append(row)
                        size += len(row[1])
                        if size >= READ:
                            yield out(held)
                            held, size = [], 0
                if held:
                    yield out(held)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    names = spark.range(1, numPartitions=1).mapInArrow(listed, "name string").repartition(tasks)
    return names.mapInArrow(read, "path string, value binary").select("path", F.col("value").cast("string").alias("value"))


def scan_articles(spark: SparkSession, folder: str, key_prefix: str = "Title: ") -> DataFrame:
    """path, key, body of the article files in a folder; files without key are left out."""
    uri = _reachable(spark, folder)
    files = _read_files(spark, uri) if uri else spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).withColumn("path", F.input_file_name())
    key, body = split_article(F.col("value"), key_prefix)
    return files.select("path", key.alias("key"), body.alias("body")).where("key is not null")


def article_text(docs: DataFrame, source: str, key_name: str = "Title") -> DataFrame:
    """name, content of docs(n, key, title, url, body) in the article format."""
    head = F.concat_ws("\n", F.lit(f"Source: {source}"), F.concat(F.lit(f"{key_name}: "), "key"), F.concat(F.lit("URL: "), F.coalesce("url", F.lit(""))), F.lit("Query: fetch mode"), F.lit("---"))
    return docs.select(F.concat(F.lpad(F.col("n").cast("string"), 2, "0"), F.lit("_"), sanitize_filename(F.col("key")), F.lit(".txt")).alias("name"), F.concat_ws("\n", head, "body").alias("content"))


def write_articles(docs: DataFrame, folder: str) -> None:
    """Parquet by corpus: the distributed form of the article folder."""
    docs.write.mode("overwrite").partitionBy("corpus").parquet(folder)


def next_index(names: DataFrame, name_col: str = "name") -> DataFrame:
    """One row, next_index: the greatest number before the first underscore, plus one; 1 for none."""
    return names.agg((F.coalesce(F.max(F.split(name_col, "_")[0].try_cast("int")), F.lit(0)) + 1).alias("next_index"))


def missing_documents(pinned: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Pinned keys that the cache lacks."""
    return pinned.join(cached.select(key), key, "left_anti")


def cached_in_order(pinned: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Cached documents in pinned order: pinned(key, pos) joined with cached."""
    return pinned.join(cached, key)


def fetch(pinned: DataFrame, cached: DataFrame, loader: Callable[[str], dict | None], key: str = "key") -> DataFrame:
    """pos, key, title, url, body of pinned(pos, key) in any order: what the cache has, else what the loader gives.

    ``loader`` gets a missing key, in the tasks, and returns title, url and body (or
    None: left out). Bodies lose their line feeds, titles the white space around.
    The caller orders by pos and adds what was loaded to the cache.
    """

    def run(frames):
        import pandas as pd

        for f in frames:
            found = [(p, k, loader(k)) for p, k in zip(f["pos"], f["key"], strict=True)]
            yield pd.DataFrame([(p, k, x["title"], x["url"], x["body"]) for p, k, x in found if x], columns=["pos", "key", "title", "url", "body"])

    ddl = "pos long, key string, title string, url string, body string"
    wanted = pinned.select(F.col("pos").cast("long").alias("pos"), F.col(key).alias("key"))
    loaded = missing_documents(wanted, cached.withColumnRenamed(key, "key"), "key").mapInPandas(run, ddl)
    clean = loaded.select("pos", "key", strip(F.col("title")).alias("title"), "url", fold_lines(F.col("body")).alias("body"))
    return cached_in_order(wanted, cached.select(F.col(key).alias("key"), "title", "url", "body"), "key").select("pos", "key", "title", "url", "body").unionByName(clean)


def search_or_cached(found: DataFrame, cached: DataFrame, most: int) -> DataFrame:
    """What a search found; if that is nothing, the first ``most`` of the cache(pos, ...)."""
    return cached.orderBy("pos").limit(most) if found.isEmpty() else found


def write_article_files(docs: DataFrame, folder: str, source: str, key_name: str = "Title") -> int:
    """Writes article_text(docs) as one file per article; their number.

    Tasks write the files, WRITERS side by side; a retried task writes the same ones
    again. Of articles with one name the last one stays. Into a store that only Spark
    reaches, the driver writes them.
    """
    spark = docs.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    uri = _reachable(spark, folder)
    if uri is None:
        return _write_from_driver(article_text(docs, source, key_name), folder)

    def run(batches):
        store, to = pafs.FileSystem.from_uri(uri)

        def write(file: tuple[str, str]) -> None:
            with store.open_output_stream(f"{to}/{file[0]}") as f:
                f.write(file[1].encode())

        with ThreadPoolExecutor(WRITERS) as pool:
            for batch in batches:
                names, contents, n = (c.to_pylist() for c in batch.columns)
                for _ in pool.map(write, zip(names, contents, strict=True)):
                    pass
                yield pa.RecordBatch.from_arrays([pa.array([sum(n)], pa.int64())], names=["n"])

    placed = article_text(docs, source, key_name).withColumn("_at", F.monotonically_increasing_id())
    last = placed.groupBy("name").agg(F.max_by("content", "_at").alias("content"), F.count("*").alias("n"))
    return last.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _write_from_driver(files: DataFrame, folder: str) -> int:
    """As write_article_files of files(name, content): rows come to the driver one partition at a time."""
    spark = files.sparkSession
    jvm = spark._jvm
    at, tools = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.FileUtil
    store = at(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def write(files: list[tuple[str, str]]) -> int:
        for name, content in files:
            tools.write(store, at(folder, name), bytearray(content.encode()))
        return len(files)

    rows, n = files.toLocalIterator(prefetchPartitions=True), 0
    with ThreadPoolExecutor(WRITERS) as pool:
        while some := list(islice(rows, WRITERS * FILES)):
            last = {r.name: r.content for r in some}  # a name is written by one thread at a time
            files = list(last.items())
            pool_of = [files[k::WRITERS] for k in range(WRITERS)]
            n += len(some) - len(files) + sum(pool.map(write, pool_of))
    return n


def fetch_plan(pinned: DataFrame, cached: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """What a network connector would have to load; loading itself needs a network and is left to the caller."""
    wanted = pinned if limit is None else pinned.orderBy("pos").limit(limit)
    return missing_documents(wanted, cached, key)
