"""Sinks: bounded JSON responses, counters, histograms and gauges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ADAPTER_BYTES, STUDIO_BYTES, BODY_BYTES = 10 << 20, 10 << 20, 5 << 20


def responses(results: DataFrame, most: int = ADAPTER_BYTES) -> DataFrame:
    """``body`` (JSON of each result) or, beyond ``most`` bytes, a ``problem`` with the measured size."""
    body = F.to_json(F.struct(*[F.col(c) for c in results.columns]))
    size = F.octet_length(body)
    problem = F.when(size > most, F.struct(F.lit("response_bytes").alias("reason"), size.cast("long").alias("measured"), F.lit(most).cast("long").alias("maximum")))
    return results.select("request_id", F.when(size <= most, body).alias("body"), problem.alias("problem"))


def admitted(bodies: DataFrame, most: int = BODY_BYTES) -> tuple[DataFrame, DataFrame]:
    """Bodies within the byte bound, and those beyond it with their size."""
    size = F.octet_length("body")
    return bodies.where(size <= most), bodies.where(size > most).select("request_id", size.cast("long").alias("measured"), F.lit(most).cast("long").alias("maximum"))


def counters(results: DataFrame) -> DataFrame:
    """(metric, label, value): requests by decision, detections by entity, rows by action, rejected requests by reason."""
    one = lambda metric, label, value: F.struct(F.lit(metric).alias("metric"), label.alias("label"), value.cast("long").alias("value"))
    rows = F.transform("report_rows", lambda r: one("entities", r.entity_type, r.detected_count))
    acts = F.transform("applied_actions", lambda a: one("actions", a, F.lit(1)))
    decision = F.array(one("requests", F.coalesce("decision", F.lit("error")), F.lit(1)))
    errors = F.when(F.col("error").isNotNull(), F.array(one("errors", F.col("error.reason"), F.lit(1))))
    kind = "array<struct<metric:string,label:string,value:bigint>>"
    each = results.select(F.explode(F.concat(rows.cast(kind), acts.cast(kind), decision.cast(kind), F.coalesce(errors.cast(kind), F.array().cast(kind)))).alias("x"))
    return each.groupBy("x.metric", "x.label").agg(F.sum("x.value").alias("value"))


#: Upper bounds of durations in seconds.
DURATIONS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 600.0)


def histogram(values: DataFrame, column: str, bounds: tuple[float, ...] = DURATIONS, by: tuple[str, ...] = ()) -> DataFrame:
    """(labels of ``by``, le, count, total): how many values are at most each bound, the last of them infinity, and their sum; nulls and NaN are left out.

    Every row adds to one bucket before the shuffle, and buckets are added up by bound afterwards; a label without a value has no row.
    """
    edges = sorted(bounds)
    c = F.col(column).cast("double")
    place = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        place = F.when(c <= edges[i], i).otherwise(place)
    own = values.where(c.isNotNull() & ~F.isnan(c)).groupBy(*by, place.alias("bucket")).agg(F.count("*").alias("n"), F.sum(c).alias("s"))
    one = lambda i: F.struct(F.lit(edges[i] if i < len(edges) else float("inf")).alias("le"), F.coalesce(F.sum(F.when(F.col("bucket") <= i, F.col("n"))), F.lit(0)).alias("count"))
    each = own.groupBy(*by).agg(F.array(*[one(i) for i in range(len(edges) + 1)]).alias("x"), F.sum("s").alias("total"), F.sum("n").alias("all")).where(F.col("all") > 0)
    return each.select(*by, F.explode("x").alias("x"), "total").select(*by, "x.le", "x.count", "total")


def observed(df: DataFrame, name: str, **gauges: Column) -> tuple[DataFrame, Observation]:
    """``df`` with aggregates that are measured while it is written, so that gauges cost no job of their own; read ``.get`` after the action."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(n) for n, c in gauges.items()]), seen


def percentile(values: DataFrame, column: str, quantile: float, most: int = 100_000) -> DataFrame:
    """Nearest-rank percentile, exact: the value whose rank is the quantile's share of the rows, rounded up; no row if there is no value.

    Approximate quantiles narrow the range round after round, counts below it are exact, and only when it holds ``most`` distinct
    values or fewer are these ordered. Jobs run when this is called.
    """
    c, spark = F.col(column), values.sparkSession
    rows, low, high = values.where(c.isNotNull()).select(c), None, None
    n = rows.count()
    rank = max(1, math.ceil(quantile * n))
    below = 0
    while n:
        inside = rows if low is None else rows.where(c.between(low, high))
        counts = inside.groupBy(column).agg(F.count("*").alias("n"))
        if counts.limit(most + 1).count() <= most:
            ordered = counts.orderBy(column).withColumn("to", F.sum("n").over(Window.orderBy(column)) + below)
            return ordered.where(F.col("to") >= rank).orderBy(column).limit(1).select(c.alias("value"))
        size = inside.count()
        share = (rank - below) / size
        a, b = inside.select(F.percentile_approx(column, [max(0.0, share - 0.001), min(1.0, share + 0.001)], 10_000)).first()[0]
        under, upto = (rows.where(x).count() for x in (c < F.lit(a), c <= F.lit(b)))
        if under < rank <= upto and (a, b) != (low, high):
            low, high, below = a, b, under
        else:  # the range cannot be narrowed further
            most = size
    return spark.createDataFrame([], T.StructType([T.StructField("value", rows.schema[column].dataType)]))
