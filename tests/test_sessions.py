"""Whole session decisions: the stream, the batch and a plain fold agree; expiry slides; unsound states are refused."""

import random
import time

from palimpsest.operators import session
from palimpsest.streaming import sessions, taint

ENTITIES = ["EMAIL_ADDRESS", "IBAN", "BSN"]


def requests(seed, n_sessions=25, n=7):
    r = random.Random(seed)
    out = []
    for s in range(n_sessions):
        kind = r.choice(["chat", "chat", "document"])
        for i in range(r.randrange(1, n)):
            decision = r.choice(["pass", "apply_actions", "reroute", "reroute", "block"] if i else ["pass", "reroute", "reroute"])
            found = sorted(r.sample(ENTITIES, r.randrange(1, 4)))
            action = {"block": "block", "reroute": "reroute"}.get(decision, "mask")
            rows = [(e, action if k == 0 else "mask", r.randrange(1, 4), 0 if decision == "block" else r.randrange(2)) for k, e in enumerate(found)]
            out.append((f"s{s}", i, kind if r.random() < 0.9 else "other", decision, r.choice("ab") if decision == "reroute" else None, r.randrange(4), [(e, d + r.randrange(3)) for e, _, d, _ in rows], rows))
    return out


def folded(rows):
    held, answers = {}, {}
    for key, seq, kind, decision, route, overlaps, counts, report in sorted(rows):
        held[key], a = sessions.follow(held.get(key), kind, decision, route, overlaps, dict(counts), {e: (x, d, t) for e, x, d, t in report})
        answers[key, seq] = (a.decision, a.route, a.from_cache, a.error, a.overlaps, sorted(a.counts.items()), sorted((e, *x) for e, x in a.rows.items()))
    return {k: h for k, h in held.items() if h}, answers


def streamed(spark, folder, out, checkpoint, ttl_ms=None):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", taint.PROVIDER)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    source = spark.readStream.schema(sessions.INPUT).option("maxFilesPerTrigger", 1).parquet(folder)
    query = sessions.session_stream(source, ttl_ms).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    return {(x.session_key, x.seq): (x.final_decision, x.final_route, x.from_cache, x.session_error, x.overlap_count, [tuple(c) for c in x.entity_counts], [tuple(c) for c in x.report_rows]) for x in spark.read.parquet(out).collect()}


def test_stream_equals_a_plain_fold_over_several_batches(spark, tmp_path):
    rows = requests(1)
    df = spark.createDataFrame(rows, sessions.INPUT)
    for a, b in ((0, 2), (2, 4), (4, 9)):
        df.where(f"seq >= {a} AND seq < {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = streamed(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert got == folded(rows)[1] and {x[0] for x in got.values()} >= {"block", "reroute", None}


def test_batch_equals_a_plain_fold(spark):
    rows = requests(2, 150)
    got = {x.session_key: (x.kind, x.decision, x.route, x.overlaps, {c.entity_type: c["count"] for c in x.entity_counts}, {r.entity_type: (r.action, r.detected_count, r.transformed_count) for r in x.report_rows}) for x in session.held(spark.createDataFrame(rows, sessions.INPUT)).collect()}
    want = {k: (h.kind, h.decision, h.route, h.overlaps, h.counts, h.rows) for k, h in folded(rows)[0].items()}
    assert got == want and {w[1] for w in want.values()} == {"block", "reroute"}
    assert session.held(spark.createDataFrame([], sessions.INPUT)).count() == 0


def test_expiry_slides_and_ends(spark, tmp_path):
    one = lambda seq, decision, route=None: ("s", seq, "chat", decision, route, 0, [("IBAN", 1)], [("IBAN", "reroute" if route else "mask", 1, 0)])
    paths = [str(tmp_path / x) for x in ("in", "out", "state")]

    def sent(row):
        spark.createDataFrame([row], sessions.INPUT).coalesce(1).write.mode("append").parquet(paths[0])
        return streamed(spark, *paths, ttl_ms=60_000 if row[1] < 3 else 1)[row[0], row[1]][:2]

    assert sent(one(1, "reroute", "a")) == ("reroute", "a")
    assert sent(one(2, "pass")) == ("reroute", "a")
    time.sleep(0.1)
    assert sent(one(3, "pass"))[0] in ("reroute", "pass")  # what is written from here on lives for a millisecond
    time.sleep(0.1)
    assert sent(one(4, "pass")) == ("pass", None)


def test_unsound_states_are_refused():
    good = sessions.Held("chat", "reroute", "a", 0, {"IBAN": 2}, {"IBAN": ("reroute", 1, 0)})
    bad = {
        "decision": sessions.Held("chat", "pass", None, 0), "no_route": sessions.Held("chat", "reroute", None, 0, {"X": 1}, {"X": ("reroute", 1, 0)}), "route_of_block": sessions.Held("chat", "block", "a", 0), "face": sessions.Held("chat", "block", None, 0, {"FACE": 1}),
        "mcp": sessions.Held("mcp", "reroute", "a", 0, {"X": 1}, {"X": ("reroute", 1, 0)}), "rows_exceed_counts": sessions.Held("chat", "block", None, 0, {"X": 1}, {"X": ("block", 2, 0)}), "block_transforms": sessions.Held("chat", "block", None, 0, {"X": 1}, {"X": ("block", 1, 1)}),
        "block_without_row": sessions.Held("chat", "block", None, 0, {"X": 1}, {"X": ("mask", 1, 0)}), "reroute_rows": sessions.Held("chat", "reroute", "a", 0, {"X": 1}, {"X": ("mask", 1, 0)}),
    }
    assert sessions.unsound(good) is None and set(bad) == set(sessions.UNSOUND)
    assert {name: sessions.unsound(h) for name, h in bad.items()} == {name: name for name in bad}
    many = {f"E{i}": 1 for i in range(40)}
    held, answer = sessions.follow(sessions.Held("chat", "reroute", "a", 0, {f"X{i}": 1 for i in range(40)}, {"X1": ("reroute", 1, 0)}), "chat", "pass", None, 0, many, {})
    assert answer.error == "entity_bound" and len(held.counts) == 40
