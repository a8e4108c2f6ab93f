"""The stateful stream gives what the batch windows give."""

import random

from palimpsest.operators import session
from palimpsest.streaming import taint

SCHEMA = "session_key string, seq long, request_kind string, decision string, route_class string"


def stream(spark, build, folder, schema, name):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", taint.PROVIDER)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = build(source).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return spark.table(name).collect()


def test_taint_stream_equals_batch(spark, tmp_path):
    r = random.Random(1)
    rows = [(f"s{s}", i, "chat", d := r.choice(["pass", "pass", "reroute", "block"]), r.choice("ab") if d == "reroute" else None) for i in range(6) for s in range(8)]
    df = spark.createDataFrame(rows, SCHEMA)
    for i in (0, 3):
        df.where(f"seq >= {i} AND seq < {i + 3}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {(x.session_key, x.seq): (x.final_decision, x.final_route, x.from_cache) for x in stream(spark, taint.sticky_stream, str(tmp_path / "in"), SCHEMA, "taint_out")}
    want = {(x.session_key, x.seq): (x.final_decision, x.final_route, x.from_cache) for x in session.sticky(df, order="seq").collect()}
    assert got == want


def test_receipts_stream(spark, tmp_path):
    schema = "scope string, seq long, op string, digests array<string>"
    rows = [("a", 1, "put", ["x", "y"]), ("a", 2, "check", ["x"]), ("a", 3, "check", ["x", "z"]), ("b", 4, "check", ["x"])]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = {x.seq: x.verified for x in stream(spark, taint.receipts_stream, str(tmp_path / "in"), schema, "receipts_out")}
    assert got == {2: True, 3: False, 4: False}
