"""Model answers over batches, racing publishers, histograms and gauges, resolution over rows."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from palimpsest import policy as P
from palimpsest.operators import bundle, resolve, resolve_rows
from palimpsest.operators.window_cache import WindowCache, accounted, bounded
from palimpsest.sources import sinks


def _events(df):
    return {r.event: r.n for r in df.collect()}


def test_cache_asks_for_touched_windows_only(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def model(texts):
        asked.add(len(texts))
        return [[("PERSON_NAME", 0, len(t), 0.9, "transformer")] if t else [] for t in texts]

    cache = WindowCache(str(tmp_path / "c"), 100, 1 << 30, namespace="m1")
    rows = lambda texts: spark.createDataFrame(list(enumerate(texts)), "id long, window_text string")
    got, events = cache.run(rows(["aa", "bb", "bb", None, ""]), model, 10)
    assert _events(events) == {"hit": 0, "miss": 3, "expiry": 0, "eviction": 0} and asked.value == 3
    assert {r.id: len(r.spans) for r in got.collect()} == {0: 1, 1: 1, 2: 1, 3: 0, 4: 0}
    got, events = cache.run(rows(["aa", "b2"]), model, 60)  # one window edited
    assert _events(events) == {"hit": 1, "miss": 1, "expiry": 0, "eviction": 0} and asked.value == 4
    assert {r.id: r.spans[0].end for r in got.collect()} == {0: 2, 1: 2}
    _, events = cache.run(rows(["aa"]), model, 115)  # age counts from creation, whatever was used since
    assert _events(events) == {"hit": 0, "miss": 1, "expiry": 3, "eviction": 0} and asked.value == 5
    _, events = cache.run(rows([]), model, 116)
    assert _events(events) == {"hit": 0, "miss": 0, "expiry": 0, "eviction": 0}
    other = WindowCache(str(tmp_path / "c"), 100, 1 << 30, namespace="m2")
    assert _events(other.run(rows(["aa"]), model, 117)[1])["miss"] == 1  # answers of another model are not its own


def test_cache_drops_the_least_recent_beyond_its_bytes(spark, tmp_path):
    model = lambda texts: [[] for _ in texts]
    cache = WindowCache(str(tmp_path / "c"), 1000, 3 * 1024)
    rows = lambda texts: spark.createDataFrame([(t,) for t in texts], "window_text string")
    cache.run(rows(["a", "b"]), model, 1)
    cache.run(rows(["c"]), model, 2)
    _, events = cache.run(rows(["a", "d"]), model, 3)  # a is used again, so b is the oldest
    assert _events(events) == {"hit": 1, "miss": 1, "expiry": 0, "eviction": 1}
    assert _events(cache.run(rows(["a", "c", "d"]), model, 4)[1])["hit"] == 3
    entries = [(f"{i * 7919 % 65536:04x}{i:04d}", [], 0, i % 3, 100 + i) for i in range(300)] + [("ffff", [], 0, 9, 10**9)]
    df = spark.createDataFrame(entries, "window_hash string, spans array<struct<entity_type:string,start:int,end:int,score:double,source:string>>, created long, used long, bytes long")
    total, want = 0, set()
    for e in sorted(entries[:-1], key=lambda e: (-e[3], e[0])):
        total += e[4]
        if total <= 20_000:
            want.add(e[0])
    assert {r.window_hash for r in bounded(df, 20_000).collect()} == want
    assert spark.range(1).select(accounted(F.expr("array(named_struct('entity_type', 'ABC', 'start', 0, 'end', 1, 'score', 0.5D, 'source', 'x'))"))).first()[0] == 1024 + 64 + 4


def test_racing_publishers_take_different_versions(spark, tmp_path, monkeypatch):
    pointer = str(tmp_path / "pointer")
    bundle.publish(spark.range(1), str(tmp_path), "first", pointer)
    stale = spark.createDataFrame([(1, "first", str(tmp_path / "first"))], bundle.POINTER)
    with monkeypatch.context() as m:
        m.setattr(bundle, "_pointers", lambda *_: stale)  # all saw version 1 when they began
        with ThreadPoolExecutor(4) as pool:
            list(pool.map(lambda i: bundle.publish(spark.range(i + 2), str(tmp_path), f"next{i}", pointer), range(4)))
    rows = spark.read.schema(bundle.POINTER).json(pointer).orderBy("version").collect()
    assert [r.version for r in rows] == [1, 2, 3, 4, 5] and len({r.name for r in rows}) == 5
    last = rows[-1]
    assert bundle.published(spark, pointer).count() == int(last.name.removeprefix("next")) + 2
    assert bundle.published(spark, str(tmp_path / "none"), "a int").count() == 0


def test_histogram_and_gauges(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 1.0), ("a", 1.5), ("a", 99.0), ("b", None), (None, 2.0), ("a", float("nan"))], "k string, v double")
    got = {(r.k, r.le): (r["count"], r.total) for r in sinks.histogram(df, "v", (2.0, 1.0), ("k",)).collect()}
    inf = float("inf")
    assert got == {("a", 1.0): (2, 102.0), ("a", 2.0): (3, 102.0), ("a", inf): (4, 102.0), (None, 1.0): (0, 2.0), (None, 2.0): (1, 2.0), (None, inf): (1, 2.0)}
    assert sinks.histogram(df.limit(0), "v").count() == 0
    watched, seen = sinks.observed(df, "gauges", rows=F.count("*"), most=F.max(F.when(~F.isnan("v"), F.col("v"))))
    watched.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 7, "most": 99.0}


def test_resolution_over_rows_equals_that_in_a_row(spark):
    r = random.Random(5)
    data = [(r.choice([None, "x", "y"]), r.choice("ABC"), a, a + r.randint(1, 9), r.randint(1, 9) / 10, r.choice("pq")) for a in (r.randrange(300) for _ in range(400))]
    rows = spark.createDataFrame([*data, *data[:50]], "k string, entity_type string, start int, end int, score double, source string")
    policy = P.Policy(default_action="mask", entity_policies=(P.EntityPolicy("A", "block"), P.EntityPolicy("B", "replace")))
    inside = rows.groupBy("k").agg(F.collect_list(F.struct("entity_type", "start", "end", "score", "source")).alias("s")).withColumn("l", resolve.logical(F.col("s")))
    whole = sorted(map(str, inside.select("k", F.inline("l")).collect()))
    for block in (1, 7, 1 << 16):
        found = resolve_rows.logical(rows, ["k"], block)
        assert sorted(map(str, found.select("k", "entity_type", "start", "end", "score", "source", "owner_width").collect())) == whole
    want = inside.select("k", F.inline(resolve.regions(F.col("l"), policy, F.lit(False))))
    got = resolve_rows.regions(found, ["k"], policy, block=7)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert resolve_rows.regions(resolve_rows.logical(rows.limit(0), ["k"]), ["k"], policy).count() == 0


def test_a_segment_of_a_million_spans(spark):
    rows = spark.range(1_000_000).select(F.lit("s").alias("k"), F.lit("A").alias("entity_type"), (F.col("id") * 5).cast("int").alias("start"), (F.col("id") * 5 + 3 + F.when(F.col("id") % 10 < 9, 3).otherwise(0)).cast("int").alias("end"), F.lit(0.5).alias("score"), F.lit("r").alias("source"))
    got = resolve_rows.logical(rows, ["k"])
    assert got.agg(F.count("*"), F.min(F.col("end") - F.col("start")), F.max(F.col("end") - F.col("start")), F.sum("start")).first()[:] == (100_000, 48, 48, sum(range(0, 5_000_000, 50)))


def test_rows_are_dealt_once(spark):
    # rows meet only the numbers of their block
    rows = spark.range(8).select(F.col("id").alias("k"), F.lit("A").alias("entity_type"), F.lit(1).alias("start"), F.lit(3).alias("end"), F.lit(0.5).alias("score"), F.lit("r").alias("source"))
    plan = resolve_rows.logical(rows, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_line_rows_are_not_gathered(spark, tmp_path):
    from palimpsest.plans import operation_queries

    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string"
    spark.createDataFrame([(None, 3, 4, 1, 5.0, "A"), (None, 3, 4, 1, 5.0, "A"), (1, 3, 4, 1, 5.0, None)], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = operation_queries.logical_rows(spark, str(tmp_path))
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, ((r.k, r.start, r.end, r.source) for r in got.collect()))) == ["(1, 3, 8, None)", "(None, 3, 8, 'A')"]
