"""Registered queries over what an operator watches: model answers kept over batches, histograms, and resolution over rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolve_rows
from ..operators.window_cache import WindowCache
from ..sources import sinks
from . import queries as q
from .queries import register, table


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; one of this machine only under a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set")
    return f"{shared or tempfile.mkdtemp(prefix='spark-')}/palimpsest-windows/{uuid.uuid4().hex}"


@register("""WITH a AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents), b AS (SELECT DISTINCT CASE WHEN doc_id % 5 = 0 THEN coalesce(text, '') || ' edited' ELSE coalesce(text, '') END AS t FROM documents)
SELECT 'hit' AS event, count(*) AS n FROM b WHERE t IN (SELECT t FROM a) UNION ALL SELECT 'miss', count(*) FROM b WHERE t NOT IN (SELECT t FROM a)
UNION ALL SELECT 'expiry', 0 UNION ALL SELECT 'eviction', 0""")
def window_cache_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of all texts, some edited in between: only edited ones are asked for again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("window_text"))
    cache = WindowCache(_folder(spark), 3600, 1 << 50)
    model = lambda texts: [[("PRIVATE", 0, len(t), 0.9, "transformer")] if t.startswith("T") else [] for t in texts]
    cache.run(docs, model, 1000)
    edited = F.when(F.col("doc_id") % 5 == 0, F.concat(F.coalesce("window_text", F.lit("")), F.lit(" edited"))).otherwise(F.col("window_text"))
    return cache.run(docs.withColumn("window_text", edited), model, 1010)[1]


@register("""WITH b AS (SELECT unnest([1.0, 5.0, 10.0, 50.0, 100.0, 500.0, 'infinity'::DOUBLE]) AS le), t AS (SELECT DISTINCT event_type FROM events WHERE value IS NOT NULL)
SELECT t.event_type, b.le, (SELECT count(*) FROM events e WHERE e.event_type IS NOT DISTINCT FROM t.event_type AND e.value <= b.le) AS count FROM t, b""")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative bucket counts of event values by type."""
    return sinks.histogram(table(spark, sf_dir, "events"), "value", (1.0, 5.0, 10.0, 50.0, 100.0, 500.0), ("event_type",)).drop("total")


def _line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.line_rows(spark, sf_dir).select("k", "s.*")


@register(q.SQL["logical_detections"])
def logical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical detections of spans that are rows."""
    return resolve_rows.logical(_line_rows(spark, sf_dir), ["k"], block=16)


@register(q.SQL["effective_regions"])
def region_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of spans that are rows."""
    found = resolve_rows.regions(resolve_rows.logical(_line_rows(spark, sf_dir), ["k"], block=16), ["k"], q._LINES, block=16)
    return found.select("k", "entity_type", "start", "end", "score", "source", "action", "overlap")


@register("""WITH s AS (SELECT l_returnflag AS e, l_orderkey * 9 + l_linenumber AS a, l_orderkey * 9 + l_linenumber + 1 + l_suppkey % 12 AS b FROM lineitem),
o AS (SELECT *, CASE WHEN a >= coalesce(max(b) OVER (PARTITION BY e ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS opens FROM s),
g AS (SELECT *, sum(opens) OVER (PARTITION BY e ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS gid FROM o)
SELECT e AS entity_type, min(a) AS start, max(b) AS "end", max(b - a) AS owner_width FROM g GROUP BY e, gid""")
def one_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as spans of one text: a segment that holds the whole table."""
    a = F.col("l_orderkey") * 9 + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("entity_type"), a.alias("start"), (a + 1 + F.col("l_suppkey") % 12).alias("end"), F.lit(0.5).alias("score"), F.lit("rules").alias("source"))
    return resolve_rows.logical(rows.withColumn("k", F.lit(1)), ["k"]).select("entity_type", "start", "end", "owner_width")
