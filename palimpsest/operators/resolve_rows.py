"""Overlap resolution over rows, one span each: for segments whose spans are too many for one row.

Islands are found block by block of start positions. What reaches into a block from those before it is one number for each block of a segment,
so a segment of any length is worked on by as many tasks as it has blocks. Spans that begin at one place are first made one, so a block holds no
more rows than it has positions, for each entity.
Spans end after they begin; keys may be null, and null keys are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..policy import Policy
from .resolve import effective_action, strictness_of

#: Start positions of a block.
BLOCK = 65_536


def islands(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end", block: int = BLOCK) -> DataFrame:
    """``spans`` with ``island``, the start of the connected run of spans of one key that each belongs to; a span that begins where all before it have ended opens a new one.

    Inside its block a span that begins where all before it there have ended may open one; it does if what reaches into the block ends there too. So
    the last that may is also the last that does, if any does, and two numbers of a block are all that later blocks need.
    """
    own = spans.withColumn("__k", F.struct(*[F.col(k) for k in keys])).withColumn("__block", F.floor(F.col(start) / block))
    in_block = Window.partitionBy("__k", "__block").orderBy(start)
    of_key = Window.partitionBy("__k").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(end).over(in_block.rangeBetween(Window.unboundedPreceding, -1))
    may = own.withColumn("__seen", seen).withColumn("__may", F.when(F.col("__seen").isNull() | (F.col(start) >= F.col("__seen")), F.col(start)))
    may = may.withColumn("__latest", F.max("__may").over(in_block.rangeBetween(Window.unboundedPreceding, Window.currentRow))).drop("__seen", "__may")
    opens = lambda at: F.col("__before").isNull() | (F.col(at) >= F.col("__before"))
    of_block = may.groupBy("__k", "__block").agg(F.max(end).alias("__top"), F.max("__latest").alias("__last")).withColumn("__before", F.max("__top").over(of_key))
    of_block = of_block.withColumn("__carry", F.max(F.when(opens("__last"), F.col("__last"))).over(of_key)).select("__k", "__block", "__before", "__carry")
    return may.join(of_block, ["__k", "__block"]).select(*spans.columns, F.when(opens("__latest"), F.col("__latest")).otherwise(F.col("__carry")).alias("island"))


def logical(spans: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Logical detections of rows (``keys``, entity_type, start, end, score, source): connected spans of one entity, with the score, source and width of the widest, then best scored, of them."""
    of_entity = [*keys, "entity_type"]
    owner = F.min(F.struct((F.col("start") - F.col("end")).alias("w"), (-F.col("score")).alias("d"), F.col("source").alias("s")))
    # spans that begin at one place are of one island
    at = spans.groupBy(*of_entity, "start").agg(F.max("end").alias("end"), owner.alias("o"))
    each = islands(at, of_entity, block=block).groupBy(*of_entity, "island").agg(F.max("end").alias("end"), F.min("o").alias("o"))
    return each.select(*keys, "entity_type", F.col("island").alias("start"), "end", (-F.col("o.d")).alias("score"), F.col("o.s").alias("source"), (-F.col("o.w")).alias("owner_width"))


def regions(detections: DataFrame, keys: list[str], policy: Policy, mcp: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Regions of the rows of ``logical``: connected detections of any entity, under the entity, score, source and action of the strictest, widest, best scored one."""
    mcp = F.lit(False) if mcp is None else mcp
    action = effective_action(policy, F.col("entity_type"), mcp)
    rank = F.struct(
        (-strictness_of(F.col("action"))).alias("r"), (-F.col("owner_width")).alias("w"), (-F.col("score")).alias("d"), F.col("entity_type").alias("e"), F.col("source").alias("s"), F.col("start").alias("a"), F.col("end").alias("z"),
        F.col("action").alias("action"),
    )
    each = islands(detections.withColumn("action", action), keys, block=block).groupBy(*keys, "island").agg(
        F.max("end").alias("end"), F.min(rank).alias("o"), F.array_sort(F.collect_set("entity_type")).alias("members"), F.count("*").cast("int").alias("size")
    )
    return each.select(
        *keys, F.col("o.e").alias("entity_type"), F.col("island").alias("start"), "end", (-F.col("o.d")).alias("score"), F.col("o.s").alias("source"), F.col("o.action").alias("action"), "members",
        (F.size("members") > 1).alias("overlap"), "size",
    )
