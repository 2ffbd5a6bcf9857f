"""Dense numbers and running sums in a global order, without a single-task window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinweave.runtime import materialise, materialise_at


def _starts(table: DataFrame, part: Column, amount: Column) -> DataFrame:
    """_part and _first, the amounts of the stretches before it: a row per partition of the table."""
    totals = table.groupBy(part.alias("_part")).agg(amount.alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_first")))


def numbered(df: DataFrame, order: list, name: str = "idx", partition: str | None = None) -> DataFrame:
    """df with ``name``: 0, 1, ... in the order of the columns ``order``.

    Rows are range-partitioned and sorted; a running id within each stretch plus
    the sizes of the stretches before it is the number. With ``partition``, each
    of its values is numbered by itself: rows are ordered by it first, and the first
    number of each value is taken away.
    """
    order = [partition, *order] if partition else order
    stretch = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    found = stretch.withColumn("_part", part).join(_starts(stretch, part, F.count("*")), "_part").withColumn(name, F.col("_first") + F.col("_id") - F.shiftleft("_part", 33)).drop("_id", "_part", "_first")
    if partition:
        firsts = found.groupBy(F.col(partition).alias("_value")).agg(F.min(name).alias("_least"))
        found = found.join(firsts, F.col(partition).eqNullSafe(F.col("_value"))).withColumn(name, F.col(name) - F.col("_least")).drop("_value", "_least")
    return found


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds _part and _inside; the last column is the weight."""
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        weights = np.asarray(batch.column(batch.num_columns - 1))
        sums = total + np.cumsum(weights)
        total = int(sums[-1]) if len(sums) else total
        more = [pa.array(np.full(len(weights), part, np.int32)), pa.array(sums - weights)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "_part", "_inside"])


def summed_before(df: DataFrame, order: list[str], weight: Column, name: str) -> tuple[DataFrame, str]:
    """df with ``name``, the weights of all rows before in the order of ``order``; and the path of its table.

    As numbered, with a running sum within each stretch.
    """
    given = df.withColumn("_weight", weight.cast("long")).repartitionByRange(*order).sortWithinPartitions(*order)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields)
    table, path = materialise_at(given.mapInArrow(_running, f"{ddl}, _part int, _inside long"), "summed")
    found = table.join(_starts(table, F.col("_part"), F.sum("_weight")), "_part")
    return found.withColumn(name, F.col("_first") + F.col("_inside")).drop("_part", "_inside", "_weight", "_first"), path
