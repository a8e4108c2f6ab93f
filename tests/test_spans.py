"""Spans, checks, resolution and sessions against plain Python."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from palimpsest import catalog, policy as P
from palimpsest.functions import checks, digests, spans
from palimpsest.operators import bundle, detect, resolve, session, windows
from palimpsest.sources import provider_json
from palimpsest.streaming import taint


def one(spark, column, text="x"):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("r")).first().r


@pytest.mark.parametrize("text", ["mail 😀 a@b.com, ü c.d@e.org", "", "a@b.com", "no"])
def test_offsets_equal_python(spark, text):
    pattern = dict(catalog.DETERMINISTIC)["EMAIL_ADDRESS"]
    got = [(m.value, m.start, m.end) for m in one(spark, spans.found(F.col("t"), pattern), text)]
    assert got == [(m.group(), m.start(), m.end()) for m in re.finditer(pattern, text)]


@pytest.mark.parametrize(("check", "good", "bad"), [
    ("luhn", "4111 1111 1111 1111", "4111 1111 1111 1112"), ("mod97", "DE89370400440532013000", "DE88370400440532013000"),
    ("eleven", "123456782", "123456783"), ("eleven", "123456782", "000000000"), ("octets", "192.0.2.1", "999.999.999.999"), ("UK_NHS", "943 476 5919", "943 476 5918"),
])
def test_checks(spark, check, good, bad):
    assert one(spark, checks.CHECKS[check](F.col("t")), good) and not one(spark, checks.CHECKS[check](F.col("t")), bad)


def merged(rows):
    """Two-level resolution in plain Python."""
    logical = []
    for e in sorted({r[0] for r in rows}):
        group = []
        for r in sorted({r for r in rows if r[0] == e}, key=lambda r: (r[1], r[2], -r[3], r[4])):
            if group and r[1] >= max(x[2] for x in group):
                logical.append(group)
                group = []
            group.append(r)
        logical.append(group)
    out = []
    for g in logical:
        o = min(g, key=lambda r: (r[1] - r[2], -r[3], r[0], r[4], r[1], r[2]))
        out.append((o[0], min(x[1] for x in g), max(x[2] for x in g), o[3], o[4], o[2] - o[1]))
    out.sort(key=lambda d: (d[1], d[2], d[0]))
    regions, group = [], []
    strict = {"A": 2, "B": 6, "C": 7}
    for d in [*sorted(out, key=lambda d: (d[1], d[2], d[0], d[4])), None]:
        if group and (d is None or d[1] >= max(x[2] for x in group)):
            w = min(group, key=lambda x: (-strict[x[0]], -x[5], -x[3], x[0], x[4], x[1], x[2]))
            regions.append((w[0], min(x[1] for x in group), max(x[2] for x in group), w[3], w[4], len({x[0] for x in group}) > 1))
            group = []
        if d:
            group.append(d)
    return out, regions


def test_resolution_equals_plain_merge(spark):
    r = random.Random(4)
    rows = []
    for i in range(300):
        some = []
        for _ in range(r.randrange(9)):
            a = r.randrange(20)
            some.append((r.choice("ABC"), a, a + r.randint(1, 6), r.choice([0.5, 0.9]), r.choice("xy")))
        rows.append((i, some))
    df = spark.createDataFrame(rows, f"k int, spans array<{spans.SPAN}>")
    pol = P.Policy(entity_policies=(P.EntityPolicy("A", "mask"), P.EntityPolicy("B", "replace"), P.EntityPolicy("C", "redact")))
    got = df.withColumn("l", resolve.logical(F.col("spans"))).withColumn("r", resolve.regions(F.col("l"), pol, F.lit(False))).collect()
    for g in got:
        logical, regions = merged(rows[g.k][1])
        assert [tuple(x) for x in g.l] == logical
        assert [(x.entity_type, x.start, x.end, x.score, x.source, x.overlap) for x in g.r] == regions


def test_invalid_spans_fail(spark):
    for bad in ((0, 99, 0.5), (2, 2, 0.5), (0, 1, float("nan")), (0, 1, 1.01), (-1, 1, 0.5)):
        column = spans.validated(F.array(spans.span("A", F.lit(bad[0]), F.lit(bad[1]), float(bad[2]), "x")), F.col("t"))
        with pytest.raises(Exception, match="invalid span"):
            one(spark, column, "abc")


@pytest.mark.parametrize("value", ["12345/12345", "12/345/67890", "123/456/78901", "123/4567/8901", "12 345 67890", "1012034567890"])
def test_tax_numbers(spark, value):
    detector = detect.deterministic(("STEUERNUMMER",))
    assert len(one(spark, detector(F.col("t")), f"Nr {value}.")) >= 1
    assert not one(spark, detector(F.col("t")), f"Nrx{value}1x")


def test_scored_rules_with_context_and_custom(spark):
    pol = P.Policy(analyzer_languages=("en", "de"), custom_recognizers=(P.CustomRecognizer("ref", "REF", r"REF-\d{4}", 0.65, ("de",)),))
    detector = detect.scored_rules(pol)
    got = {(s.entity_type, s.start, s.end): s.score for s in one(spark, detector(F.col("t")), "😀 REF-1234 phone: +31 6 12345678")}
    assert got["REF", 2, 10] == 0.65 and got["PHONE_NUMBER", 18, 32] == 0.75
    got = {s.entity_type for s in one(spark, detector(F.col("t")), "id number: L01X00T47 password=example-only")}
    assert got == {"NATIONAL_ID_NUMBER", "PASSWORD_OR_SECRET"}
    assert not one(spark, detector(F.col("t")), "L01X00T47 id number")


def test_context_of_many_values_costs_their_number(spark):
    text = " ".join(f"phone +31 6 {10_000_000 + i}" for i in range(1500))
    detector = detect.scored_rules(P.Policy(analyzer_languages=("en",), analyzer_entities=("PHONE_NUMBER",)))
    began = time.perf_counter()
    got = one(spark, detector(F.col("t")), text)
    assert len(got) == 1500 and {s.score for s in got} == {0.75} and time.perf_counter() - began < 30


def test_hmac(spark):
    import hashlib
    import hmac

    for key in (b"k", b"x" * 100):
        assert one(spark, digests.hmac_sha256(key, F.col("t")), "ü😀") == hmac.new(key, "ü😀".encode(), hashlib.sha256).hexdigest()


def test_policy_validation_and_override():
    base = P.default()
    assert P.from_dict(P.to_dict(base)) == base
    new = P.overridden(base, {"default_operator": {"masking_char": "#"}, "model_source_policies": {"m": [{"entity_type": "MCP_TOOL_X", "action": "pass"}]}})
    assert new.default_operator.masking_char == "#" and new.default_operator.chars_to_mask == 100 and "m" in new.model_source_policies
    for bad in ({"default_action": "x"}, {"nonsense": 1}, {"entity_policies": [{"entity_type": "FACE", "action": "mask"}]}, {"entity_policies": [{"entity_type": "IBAN", "action": "mask", "route_class": "a"}]}, {"score_threshold": 2}, {"analyzer_entities": ["NOPE"]}):
        with pytest.raises(P.PolicyError):
            P.overridden(base, bad)


def test_provider_json_leaves_and_way_back():
    chat = {"messages": [{"role": "user", "content": [{"type": "text", "text": "hello"}]}, {"role": "assistant", "tool_calls": [{"function": {"name": "f", "arguments": '{"q": "a@example.com"}'}}]}, {"role": "tool", "content": "tool result"}],
            "tools": [{"type": "function", "function": {"name": "f", "description": "Find", "parameters": {"type": "object", "properties": {"q": {"type": "string", "description": "PII", "enum": ["no"]}}}}}]}
    assert [t for _, t in provider_json.leaves(chat, "chat")] == ["hello", "a@example.com", "tool result", "Find", "PII"]
    mcp = {"jsonrpc": "2.0", "params": {"arguments": {"k@x.y": "v", "n": [{"value": "w", "on": True}, 12, None]}, "_meta": {"t": "m"}}}
    found = provider_json.leaves(mcp, "mcp")
    assert found == [(("params", "arguments", "k@x.y"), "v"), (("params", "arguments", "n", 0, "value"), "w")]
    new = provider_json.replaced(mcp, "mcp", {found[0][0]: "*"})
    assert new["params"]["arguments"]["k@x.y"] == "*" and new["params"]["_meta"] == {"t": "m"}
    with pytest.raises(ValueError, match="no such leaf"):
        provider_json.replaced(mcp, "mcp", {("a",): "b"})
    deep: list = []
    for _ in range(40):
        deep = [deep]
    with pytest.raises(ValueError, match="depth"):
        provider_json.guard(deep)
    responses = {"instructions": "system", "input": [{"type": "function_call_output", "output": {"a": ["s", {"v": "t"}]}}]}
    assert [t for _, t in provider_json.leaves(responses, "responses")] == ["system", "s", "t"]


def test_sticky_sessions_equal_the_fold(spark):
    r = random.Random(9)
    rows = []
    for s in range(30):
        for i in range(8):
            d = r.choice(["pass", "pass", "reroute", "block"] if r.random() < 0.3 else ["pass", "reroute"])
            rows.append((f"s{s}", i, d, r.choice(["a", "b"]) if d == "reroute" else None))
    got = {(x.session_key, x.turn): (x.final_decision, x.final_route, x.from_cache) for x in session.sticky(spark.createDataFrame(rows, "session_key string, turn int, decision string, route_class string")).collect()}
    state = {}
    for key, i, d, route in rows:
        state[key], decision, final, cached = taint.step(state.get(key), d, route)
        assert got[key, i] == (decision, final, cached)


def test_windows_and_bio(spark):
    df = spark.createDataFrame([("x" * 25,), ("",)], "text string")
    got = windows.text_windows(df, 10, 3).where("text <> ''").orderBy("owned_start").collect()
    assert [(g.window_start, len(g.window_text), g.owned_start, g.owned_end) for g in got] == [(0, 13, 0, 10), (7, 16, 10, 20), (17, 8, 20, 25)]
    tokens = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).alias("label"), F.lit(d).alias("score")) for a, b, c, d in [(0, 2, "B-PER", 0.5), (3, 5, "I-PER", 0.9), (6, 7, "O", 1.0), (8, 9, "I-PER", 0.7)]])
    assert [tuple(s) for s in one(spark, windows.bio_spans(tokens, {"PER": "PERSON_NAME"}, "transformer"))] == [("PERSON_NAME", 0, 5, 0.9, "transformer"), ("PERSON_NAME", 8, 9, 0.7, "transformer")]

    # against one pass with a state, on random labels, empty tokens and overlaps included
    r = random.Random(5)
    many = []
    for k in range(60):
        at, row = 0, []
        for _ in range(r.randrange(12)):
            size = r.randrange(3)
            row.append((at, at + size, r.choice(["O", "B-PER", "I-PER", "B-X", "I-X", "I-LOC"]), r.randrange(10) / 10))
            at += size - r.choice([0, 0, -1, 1])
        many.append((k, row))
    labels = {"PER": "P", "LOC": "P"}

    def brute(row):
        out, before = [], "O"
        for a, b, label, score in row:
            if label == "O" or a == b:
                before = "O"
                continue
            if label[0] == "I" and before[2:] == label[2:] and label[2:] in labels and out[-1][2] <= a:
                out[-1] = (*out[-1][:2], b, max(out[-1][3], score))
            else:
                out.append((labels.get(label[2:]), a, b, score))
            before = label
        return out

    table = spark.createDataFrame(many, "k int, t array<struct<start:int,end:int,label:string,score:double>>")
    got = {x.k: [tuple(s)[:4] for s in x.s] for x in table.select("k", windows.bio_spans(F.col("t"), labels, "m").alias("s")).collect()}
    assert got == {k: brute(row) for k, row in many}
    long = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda i: F.struct((i * 2).alias("start"), (i * 2 + 2).alias("end"), F.when(i % 3 == 0, "B-PER").otherwise("I-PER").alias("label"), F.lit(0.5).alias("score"))).alias("t"))
    began = time.perf_counter()
    assert long.select(F.size(windows.bio_spans(F.col("t"), labels, "m"))).first()[0] == 33_334 and time.perf_counter() - began < 20

    class TooLarge(Exception):
        pass

    def call(text):
        if len(text) > 300:
            raise TooLarge
        return [("A", m.start(), m.end(), 0.9, "m") for m in re.finditer("needle", text)]

    text = "." * 500 + "needle" + "." * 700
    assert windows.adaptive([text], call, TooLarge, 1024, 100)[0] == [("A", 500, 506, 0.9, "m")]
    with pytest.raises(RuntimeError):
        windows.adaptive([text], call, TooLarge, 1024, 100, max_calls=2)


def test_bundle(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.bin").write_bytes(b"one")
    (tmp_path / "m" / "b.bin").write_bytes(b"two")
    files = bundle.files(spark, str(tmp_path / "m"))
    lines = files.where("path = 'a.bin'").selectExpr("concat(sha256, '  ', path) AS value").union(spark.createDataFrame([("0" * 64 + "  c.bin",)], "value string"))
    assert {(r.path, r.problem) for r in bundle.differences(files, bundle.manifest(lines)).collect()} == {("b.bin", "unexpected"), ("c.bin", "missing")}
    with pytest.raises(Exception, match="unsafe"):
        bundle.manifest(spark.createDataFrame([("0" * 64 + "  ../c.bin",)], "value string")).collect()
    bundle.publish(files, str(tmp_path / "out"), "v1", str(tmp_path / "pointer"))
    assert bundle.published(spark, str(tmp_path / "pointer")).count() == 2


def test_consumed_boundaries(spark, tmp_path):
    import duckdb

    from palimpsest.plans import queries

    texts = ["946913 +1 (438) 555-5817 that", "912946913 +1 (438) 555-5817", "123456789,987654321 x", "á+1 (438) 555-5817", "a²+1 (438) 555-5817", "1234567890\n", "x1234567890", "123456789,98 7654321098", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = [tuple(r) for r in queries.detect_phone(spark, str(tmp_path)).select("doc_id", "value").collect()]
    assert sorted(got) == sorted(con.execute(queries.SQL["detect_phone"]).fetchall())
    assert (1, "1 (438) 555-5817") in got


def test_detections_are_resolved_once(spark):
    from palimpsest.plans import queries

    seen = F.transform(F.split("t", ","), lambda x: F.struct(F.lit("E0").alias("entity_type"), F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit(0.5).alias("score"), x.alias("source"), F.lit(2).alias("owner_width")))
    plan = spark.createDataFrame([("a",)], "t string").select(resolve.regions(seen, queries._LINES, F.lit(False)).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_offsets_between_separators(spark):
    for text in ["", " ", "a", " a  bc ", "\U0001f600 x\ny  z" * 3, " ".join("w" * (i % 5) for i in range(9000))]:
        got = [(m.start, m.end) for m in one(spark, spans.between(F.col("t"), " "), text)]
        assert got == [m.span() for m in re.finditer("[^ ]+", text)]
    assert one(spark, spans.between(F.col("t"), " "), None) is None
    values = list(range(5000))
    assert one(spark, spans.running(F.sequence(F.lit(0), F.lit(4999)), F.lit(0), "int", lambda x, y: x + y)) == [sum(values[:i]) for i in values]


def test_windows_are_cut_once(spark, tmp_path):
    from palimpsest.plans import queries

    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.token_windows(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_words_wait_for_hits(spark, monkeypatch):
    fails = F.raise_error(F.lit("words were looked for")).cast("array<struct<word:string,start:int>>")
    monkeypatch.setattr(detect.context, "words", lambda text: fails)
    rules = detect.scored_rules(P.Policy(analyzer_entities=("PHONE_NUMBER",)))
    assert one(spark, rules(F.col("t")), "nothing to support") == []
