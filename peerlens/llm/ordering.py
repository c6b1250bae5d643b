"""Dense names and places of rows in key order, without a group or a window that has to fit into one task.

Rows are range-partitioned by their keys and an order within a key, so a key that very many rows share is spread over as many
partitions as it needs.  Each task counts its own keys and places as they stream by; what the partitions before it hold is
added from one short row for each partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

_MADE = "_pid int, _grp long, _pos long, _lead long"


def _numbered(keys: list[int], lead: int):
    """Of sorted rows: partition, number of the key in it, place within the key, `lead` of the key's first row."""

    def run(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        group, place, first, before = -1, 0, 0, None
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            new = np.zeros(n, bool)
            for i in keys:
                col = batch.column(i)
                new[1:] |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            here = [batch.column(i)[0] for i in keys]
            new[0] = before is None or any(not a.equals(b) for a, b in zip(here, before))
            before = [batch.column(i)[n - 1] for i in keys]
            begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            goes_on = begin < 0
            leads = batch.column(lead).to_numpy(zero_copy_only=False)
            grp = group + np.cumsum(new)
            pos = np.where(goes_on, place + np.arange(n), np.arange(n) - begin)
            led = np.where(goes_on, first, leads[np.maximum(begin, 0)])
            group, place, first = int(grp[-1]), int(pos[-1]) + 1, int(led[-1])
            made = [pa.array(np.full(n, pid, np.int32)), pa.array(grp), pa.array(pos), pa.array(led.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "_pid", "_grp", "_pos", "_lead"])

    return run


def ranked(rows: DataFrame, keys: list[str], order: list[str], lead: str, name: str) -> DataFrame:
    """The rows with `name`, the dense rank of their keys from 0; `pos`, their place among the rows of their keys from 0; and
    `lead`, the value of that long column in the first of these.  No key may be null.

    The table behind it is written (`common.materialize`).  Of each partition one row of counts and two keys come to the driver.
    """
    spark = rows.sparkSession
    parts = common.n_parts(spark)
    ordered = rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string(_MADE).fields])
    at = {c: i for i, c in enumerate(rows.columns)}
    t = common.materialize(ordered.mapInArrow(_numbered([at[k] for k in keys], at[lead]), schema), name)
    key = F.struct(*keys)
    last = F.max(F.struct("_grp", "_pos", "_lead")).alias("last")
    stats = t.groupBy("_pid").agg(last, F.min_by(key, "_grp").alias("first_key"), F.max_by(key, "_grp").alias("last_key")).collect()
    offsets, names, carried, led, before = [], 0, 0, None, None
    for r in sorted(stats, key=lambda r: r["_pid"]):
        goes_on = before == r["first_key"]
        off = names - 1 if goes_on else names
        carry, first = (carried, led) if goes_on else (0, None)
        offsets.append((r["_pid"], off, carry, first))
        alone = r["last"]["_grp"] == 0
        names, before = off + r["last"]["_grp"] + 1, r["last_key"]
        carried = r["last"]["_pos"] + 1 + (carry if alone else 0)
        led = first if alone and first is not None else r["last"]["_lead"]
    o = spark.createDataFrame(offsets, "_pid int, _off long, _carry long, _first long")
    top = F.col("_grp") == 0
    return t.join(F.broadcast(o), "_pid").select(
        *rows.columns,
        (F.col("_off") + F.col("_grp")).alias("name"),
        (F.col("_pos") + F.when(top, F.col("_carry")).otherwise(0)).alias("pos"),
        F.coalesce(F.when(top, F.col("_first")), F.col("_lead")).alias("lead"),
    )
