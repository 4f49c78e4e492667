"""Rows dealt to partitions by the running sum of a weight: even partitions from one pass, without a sort."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def deal_by_weight(df: DataFrame, weight: str, part_weight: int) -> tuple[DataFrame, int]:
    """``df`` (written) without ``weight`` and with ``part``, the partition each row goes to, and the number of partitions.

    Partitions weigh about ``part_weight``, and are as many as the session runs at a time if there are rows enough. A row
    goes where its middle falls on the line of all weights, so no partition holds more than its share and one row's weight."""
    spark = df.sparkSession

    def running(batches):
        from pyspark import TaskContext
        task, total = TaskContext.get().partitionId(), 0
        for b in batches:
            w = b.column(b.schema.get_field_index(weight)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(w) + total
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, task, np.int32)), pa.array(ends - w)],
                                             [*b.schema.names, "_task", "_before"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    rows = materialize(df.mapInArrow(running, f"{fields}, _task int, _before long"), "dealt")
    # one row per task
    sums = sorted(rows.groupBy("_task").agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n")).collect())
    starts, total, n_rows = [], 0, 0
    for task, w, n in sums:
        starts.append((task, total))
        total, n_rows = total + w, n_rows + n
    n_parts = max(1, min(n_rows, max(spark.sparkContext.defaultParallelism, -(-total // part_weight))))
    middle = F.col("_start") + F.col("_before") + F.floor(F.col(weight) / 2)
    part = F.least(F.floor(middle / F.lit(max(1, total) / n_parts)), F.lit(n_parts - 1)).cast("int")
    placed = rows.join(F.broadcast(spark.createDataFrame(starts, "_task int, _start long")), "_task")
    return placed.withColumn("part", part).drop("_task", "_before", "_start", weight), n_parts
