"""Sums over all rows before a row, in a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``rows`` with a column for each of ``sums``: its sum (a long) over all rows before, in ascending ``order`` (nulls first).

    Rows are dealt by range of ``order``, so that sums run within a range; what earlier ranges hold is one row for each of them. Rows
    that tie share a range, so an order without long ties must be given.
    """
    keys, values = [f"__o{i}" for i in range(len(order))], [f"__v{i}" for i in range(len(sums))]
    keyed = rows.select("*", *[o.alias(k) for o, k in zip(order, keys, strict=True)], *[v.cast("long").alias(k) for v, k in zip(sums.values(), values, strict=True)])
    placed = written(keyed.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), name)
    totals = placed.groupBy("__part").agg(*[F.sum(v).alias(v) for v in values])
    parts_before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    offsets = totals.select("__part", *[F.coalesce(F.sum(v).over(parts_before), F.lit(0)).alias(f"{v}_before") for v in values])
    before = Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    own = [F.col(f"`{c}`") for c in rows.columns]
    here = placed.select("__part", *own, *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(v) for v in values])
    return here.join(F.broadcast(offsets), "__part").select(*own, *[(F.col(v) + F.col(f"{v}_before")).alias(new) for v, new in zip(values, sums, strict=True)])
