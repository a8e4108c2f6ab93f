"""Model answers kept over batches: a published table of windows with recency, expiry and a bound in bytes.

A window is known by its keyed digest. A batch looks its distinct windows up, asks the model about those that are not there, and
publishes the table that the next batch reads: what it touched is the most recent, what was made longer ago than the time to live is gone,
and of the rest the most recent entries stay whose bytes together are within the bound. Runs that are lost leave the table before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.digests import hmac_sha256
from ..functions.spans import SPAN
from . import bundle
from .windows import SPAN_ARROW, SPAN_FIELDS

ENTRY = f"window_hash string, spans array<{SPAN}>, created long, used long, bytes long"
Infer = Callable[[list[str]], list[list[tuple[str, int, int, float, str]]]]


def accounted(spans: Column) -> Column:
    """Bytes that an entry counts for: a kilobyte for itself, and for each span its numbers and names."""
    names = lambda s: F.octet_length(F.coalesce(s.entity_type, F.lit(""))) + F.octet_length(F.coalesce(s.source, F.lit("")))
    return F.aggregate(spans, F.lit(1024).cast("long"), lambda n, s: n + 64 + names(s))


def bounded(entries: DataFrame, most: int) -> DataFrame:
    """The most recent of ``entries`` whose bytes, summed from the most recent on, are within ``most``; what is larger alone never counts.

    Sums of groups (batch, first digits of the digest) are added up first, and then the entries inside each group, so no entry meets all others.
    """
    fits = entries.where(F.col("bytes") <= most).withColumn("part", F.substring("window_hash", 1, 4))
    sums = fits.groupBy("used", "part").agg(F.sum("bytes").alias("own"))
    of_batch = sums.groupBy("used").agg(F.sum("own").alias("n")).withColumn("later", F.sum("n").over(Window.orderBy(F.desc("used"))) - F.col("n"))
    before = F.sum("own").over(Window.partitionBy("used").orderBy("part")) - F.col("own")
    starts = sums.join(of_batch, "used").select("used", "part", (F.col("later") + before).alias("before")).where(F.col("before") < most)
    upto = F.sum("bytes").over(Window.partitionBy("used", "part").orderBy("window_hash")) + F.col("before")
    return fits.join(starts, ["used", "part"]).withColumn("upto", upto).where(F.col("upto") <= most).select("window_hash", "spans", "created", "used", "bytes")


@dataclass(frozen=True)
class WindowCache:
    """A cache in ``folder`` (shared by driver and executors); a batch is one call of ``run``, with a ``now`` of its own that grows."""

    folder: str
    ttl_seconds: int
    most_bytes: int
    key: bytes = b"window-cache"
    namespace: str = ""

    def entries(self, spark: SparkSession) -> DataFrame:
        """The entries that the last batch published; none before the first."""
        return bundle.published(spark, f"{self.folder}/pointer", ENTRY)

    def run(self, windows: DataFrame, infer: Infer, now: int, text: str = "window_text") -> tuple[DataFrame, DataFrame]:
        """``windows`` with ``window_hash`` and ``spans``, and (event, n) of hits, misses, expiries and evictions. A null text is an empty one.

        Answers are written before they are used, so no window is asked for twice; the batch's table is published by then.
        """
        spark = windows.sparkSession
        shown = F.coalesce(F.col(text), F.lit(""))
        keyed = windows.withColumn("window_hash", hmac_sha256(self.key, F.concat_ws("\x1f", F.lit(self.namespace), shown)))
        asked = keyed.groupBy("window_hash").agg(F.first(shown).alias("t"))
        all_ = self.entries(spark)
        live = all_.where(F.col("created") + self.ttl_seconds > now)

        def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [[dict(zip(SPAN_FIELDS, h, strict=True)) for h in hits] for hits in infer(b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, SPAN_ARROW)], names=["window_hash", "spans"])

        fresh = asked.join(live, "window_hash", "left_anti").select("window_hash", "t").mapInArrow(call, f"window_hash string, spans array<{SPAN}>")
        fresh = fresh.select("window_hash", "spans", F.lit(now).cast("long").alias("created"), accounted(F.col("spans")).alias("bytes"), F.lit(True).alias("fresh"))
        held = live.join(asked, "window_hash", "left_semi").select("window_hash", "spans", "created", "bytes", F.lit(False).alias("fresh"))
        path = f"{self.folder}/touched-{now}"
        fresh.unionByName(held).withColumn("used", F.lit(now).cast("long")).write.mode("overwrite").parquet(path)
        touched = spark.read.parquet(path)
        candidates = touched.drop("fresh").unionByName(live.join(touched, "window_hash", "left_anti"))
        bundle.publish(bounded(candidates, self.most_bytes), self.folder, f"entries-{now}", f"{self.folder}/pointer", mode="overwrite")
        kept = self.entries(spark)
        told = touched.agg(F.count_if("fresh").alias("miss"), F.count_if(~F.col("fresh")).alias("hit"))
        told = told.crossJoin(all_.agg(F.count_if(F.col("created") + self.ttl_seconds <= now).alias("expiry"))).crossJoin(candidates.join(kept, "window_hash", "left_anti").agg(F.count("*").alias("eviction")))
        events = told.select(F.inline(F.array(*[F.struct(F.lit(e).alias("event"), F.col(e).alias("n")) for e in ("hit", "miss", "expiry", "eviction")])))
        return keyed.join(touched.select("window_hash", "spans"), "window_hash"), events
