"""Prepared tables that are known by what they were made of, and go when that changes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.config import EMBEDDING_MODES, Settings
from twinweave.runtime import drop_table, exists

#: The settings that each prepared table depends on; others may change without making it stale.
DEPENDS = {
    "embeddings": ("embedding_dim", "hidden_dim", "epochs", "learning_rate", "weight_decay", "dropout", "mmd_weight", "moment_weight", "anchor_weight", "mmd_sample"),
    "similarity": (), "variables": ("similarity_threshold",), "structure": ("similarity_threshold", "max_structural_pairs"),
    "objective": ("similarity_threshold", "max_structural_pairs", "node_weight", "structure_weight", "left_penalty", "right_penalty"),
}


def digest(df: DataFrame) -> str:
    """A digest of a table's columns and rows, whatever their order; repeated rows count."""
    columns = sorted(df.columns)
    row = [F.to_json(F.struct(*columns)), *(F.col(c).isNull() for c in columns)]
    found = df.select(F.xxhash64(*row).alias("x"), F.xxhash64(F.lit(1), *row).alias("y")).agg(F.count("*"), F.sum(F.col("x").cast("decimal(38,0)")), F.sum(F.col("y").cast("decimal(38,0)")), F.bit_xor("x"), F.bit_xor("y")).first()
    types = [df.schema[c].dataType.simpleString() for c in columns]
    return hashlib.sha256(json.dumps([columns, types, [str(x) for x in found]]).encode()).hexdigest()


def fingerprint(name: str, inputs: Mapping[str, DataFrame | str], settings: Settings, mode: str | None = None) -> str:
    """What a prepared table is known by: its name, mode, the settings it depends on and its inputs (tables, or fingerprints of others)."""
    if mode is not None and mode not in EMBEDDING_MODES:
        raise ValueError(f"{mode!r} is no mode")
    every = asdict(settings)
    used = {k: every[k] for k in DEPENDS.get(name, tuple(every))}
    made_of = {k: v if isinstance(v, str) else digest(v) for k, v in inputs.items()}
    return hashlib.sha256(json.dumps([name, mode, used, made_of], sort_keys=True).encode()).hexdigest()


class Prepared:
    """Tables in one folder of the shared store, at ``folder/name/fingerprint``.

    A table is there if Spark's committer has marked it as whole; a run that was cut
    short leaves none. Whoever asks with another mode, other settings that the table
    depends on, or changed inputs gets a new one, and the old ones of that name go.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str, key: str) -> str:
        return f"{self.folder}/{name}/{key}"

    def known(self, name: str, key: str) -> bool:
        return exists(self.spark, f"{self.path(name, key)}/_SUCCESS")

    def table(self, name: str, build: Callable[[], DataFrame], inputs: Mapping[str, DataFrame | str], settings: Settings = Settings(), mode: str | None = None) -> tuple[DataFrame, str]:
        """(the table, its fingerprint), built only if none with this fingerprint is there."""
        key = fingerprint(name, inputs, settings, mode)
        if not self.known(name, key):
            build().write.mode("overwrite").parquet(self.path(name, key))
            self.drop_stale(name, key)
        return self.spark.read.parquet(self.path(name, key)), key

    def versions(self, name: str) -> list[str]:
        """The fingerprints that lie there under a name."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        store = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in store.listStatus(at)) if store.exists(at) else []

    def drop_stale(self, name: str, key: str | None = None) -> list[str]:
        """Deletes all tables of a name but that of ``key``; the fingerprints that went."""
        gone = [v for v in self.versions(name) if v != key]
        for v in gone:
            drop_table(self.spark, self.path(name, v))
        return gone

    def changed(self, settings: Settings, mode: str, last: Settings, last_mode: str) -> list[str]:
        """Drops what a change of mode or settings makes stale, before anything is asked for; the names that went.

        Whatever depends on a stale table is stale as well.
        """
        before, after = asdict(last), asdict(settings)
        differ = {k for k in after if after[k] != before[k]}
        order = list(DEPENDS)
        first = 0 if mode != last_mode else next((i for i, n in enumerate(order) if differ & set(DEPENDS[n])), len(order))
        gone = order[first:]
        for name in gone:
            self.drop_stale(name)
        return gone
