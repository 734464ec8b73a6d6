"""Running values and row numbers along an order, without a task that holds a whole key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from voxlake.streaming.jobs import shared_folder

#: Ordinals of a block of a running value.
BLOCK = 4096


def kept(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: what follows starts there, and lost executors cost no rerun."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, key: str, ordinal: str, values: dict[str, Column], before: bool = True, block: int = BLOCK) -> DataFrame:
    """df with running aggregates (columns named by values, e.g. F.sum("n")) along `ordinal` within `key`.

    A two-level scan: blocks of ordinals are aggregated, each block gets what lies before it, and rows add what lies
    before them in their block. A key with a third of all rows is as many groups as it has blocks; only the blocks'
    totals of a key meet in one task. before: rows before this one, else with it. Ordinals are whole numbers, one a
    row of its key; a value over no rows is null. Each value must be an aggregate that also merges its own results (sum, max, min).
    """
    rows = df.withColumn("_block", F.floor(F.col(ordinal) / block))
    local = Window.partitionBy(key, "_block").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    totals = rows.groupBy(key, "_block").agg(*(v.alias(f"_all_{c}") for c, v in values.items()))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    merge = {c: _merging(v) for c, v in values.items()}
    carry = totals.select(F.col(key).alias("_key"), F.col("_block").alias("_carried"), *(merge[c][0](f"_all_{c}").over(earlier).alias(f"_all_{c}") for c in values))
    found = rows.withColumns({f"_own_{c}": v.over(local) for c, v in values.items()})
    found = found.join(carry, found[key].eqNullSafe(carry["_key"]) & (found["_block"] == carry["_carried"]), "left")
    return found.select(*df.columns, *(merge[c][1](F.col(f"_all_{c}"), F.col(f"_own_{c}")).alias(c) for c in values))


def _merging(value: Column):
    """The aggregate and the function of two values that merge results of `value`."""
    name = str(value).split("'")[1].split("(")[0].lower()
    if name == "sum":
        return F.sum, lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return {"max": (F.max, F.greatest), "min": (F.min, F.least)}[name]


def covering(points: DataFrame, spans: DataFrame, key: str, at: str, name: str) -> DataFrame:
    """points with the column `name`: the id of the span (key, lo, hi, id) of the point's key with lo <= at < hi; null where there is none.

    A sweep instead of a range join: the starts of spans and the points lie on one line per key, and the last start so far, a running
    maximum, is the only span that can hold a point, as the spans of a key do not overlap. A key with a third of all points is swept in blocks.
    Points without a key or place, which no span holds, take no part in the sweep, where they would all be one block.
    """
    placed = F.col(key).isNotNull() & F.col(at).isNotNull()
    none = points.filter(~placed)
    points = points.filter(placed)
    span = F.struct(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), F.col("id").alias("id"))
    starts = spans.select(F.col(key).alias("_of"), (F.col("lo").cast("long") * 2).alias("_at"), span.alias("_span"))
    line = points.select(F.col(key).alias("_of"), (F.col(at).cast("long") * 2 + 1).alias("_at"), F.struct(*points.columns).alias("_point"))
    swept = running(line.unionByName(starts, allowMissingColumns=True), "_of", "_at", {"_last": F.max("_span")}).filter("_point is not null")
    found = swept.select("_point.*", F.when(F.col(f"_point.{at}") < F.col("_last.hi"), F.col("_last.id")).alias(name))
    return found.unionByName(none.withColumn(name, F.lit(None).cast(found.schema[name].dataType)))


def numbered(df: DataFrame, key: str, order: list[Column | str], name: str = "number") -> DataFrame:
    """df, kept as a table in the shared folder, with the row number (from 1) within key along order; also pos, a place in the order of all rows.

    Rows are range-partitioned by key and order, so a key with a third of all rows lies in many partitions. A task counts
    what it reads; only the first key of a partition can have begun earlier, so what is carried is at most a row a partition.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in [key, *order]]
    asc = [c.asc_nulls_first() if isinstance(k, str) else k for c, k in zip(cols, [key, *order])]
    ranged = df.repartitionByRange(*asc).sortWithinPartitions(*asc).withColumn("pos", F.monotonically_increasing_id())
    schema = StructType([*ranged.schema.fields, StructField("_seq", LongType())])
    at = ranged.columns.index(key)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0  # the key of the last row, as a one-row array, and its rows so far
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(at).dictionary_encode()
            codes = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            same = last is not None and batch.column(at)[0].as_py() == last[0]
            seq = np.arange(len(codes)) - np.repeat(first, np.diff(np.append(first, len(codes))))
            if same:
                seq[: first[1] if len(first) > 1 else len(seq)] += n
            last, n = (batch.column(at)[batch.num_rows - 1].as_py(),), int(seq[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seq, pa.int64())], names=schema.names)

    rows = kept(ranged.mapInArrow(count, schema), "numbered").withColumn("_part", F.shiftright("pos", 33))
    parts = rows.groupBy("_part").agg(F.min_by(F.struct(key), "pos").alias("first"), F.max_by(F.struct(key), "pos").alias("last"), (F.max_by("_seq", "pos") + 1).alias("n"))
    parts = parts.withColumn("so_far", F.sum("n").over(Window.partitionBy("last").orderBy("_part")))
    in_turn = Window.orderBy("_part")  # one row a partition
    parts = parts.withColumns({"before": F.lag("last").over(in_turn), "carry": F.lag("so_far").over(in_turn)}).filter("first <=> before")
    parts = parts.select(F.col("_part").alias("_p"), F.col(f"first.{key}").alias("_k"), "carry")
    found = rows.join(F.broadcast(parts), (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    return found.select(*df.columns, "pos", (F.col("_seq") + 1 + F.coalesce("carry", F.lit(0))).alias(name))
