"""Registered queries over requests, sessions, plug-ins and provider JSON; all read whole tables and have SQL to compare with."""

from __future__ import annotations

import dataclasses
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog, policy as P
from ..functions import context, digests, spans
from ..operators import decide, detect, session, transform, windows
from ..sources import provider_json, requests as sources
from . import queries as q
from .engine import Engine
from .queries import KEYS, PLAIN, dealt, register, table

#: A pattern that Java, RE2 and Python read the same way.
WORD = "[A-Z][a-z]{6,}"
_PRIVATE = dataclasses.replace(P.default(), entity_policies=(P.EntityPolicy("PRIVATE", "mask", patterns=(WORD,)),))


def nothing(text: Column) -> Column:
    """A detector that finds nothing."""
    return spans.no_spans()


def _one(id_: Column, text: Column) -> Column:
    return F.array(F.struct(id_.alias("id"), text.alias("text")))


def _hits(source: str, key: str, text: str) -> str:
    return " UNION ALL ".join(f"SELECT {key}, entity_type, value, start, \"end\" FROM {q.span_sql(source, key, text, q.PATTERN[e], e)}" for e in PLAIN)


def _values(rows: list[tuple]) -> str:
    lit = lambda x: q._quoted(x) if isinstance(x, str) else "NULL" if x is None else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


# ---- sources
@register("SELECT CAST(conv_id AS VARCHAR) AS request_id FROM conversations GROUP BY conv_id HAVING bool_or(length(coalesce(text, '')) % 11 = 0)")
def malformed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with a segment id outside the allowed alphabet."""
    bad = F.length(F.coalesce("text", F.lit(""))) % 11 == 0
    one = F.struct(F.when(bad, F.lit("no good")).otherwise(F.col("turn").cast("string")).alias("id"), F.col("text").alias("text"))
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("request_id")).agg(F.collect_list(one).alias("segments"))
    return sources.malformed(sources.requests(rows)).select("request_id")


def _bodies(df: DataFrame, id_: Column, body: Column) -> DataFrame:
    return df.select(id_.cast("string").alias("request_id"), F.to_json(body).alias("body"))


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


_TURN = "CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR)"


@register(f"SELECT {_TURN} AS request_id, 'responses' AS request_kind, 's0' AS segment_id, 'be kind' AS text FROM conversations UNION ALL SELECT {_TURN}, 'responses', 's1', coalesce(text, '') FROM conversations")
def extract_responses_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-visible strings of responses bodies: instructions and content parts."""
    part = F.array(F.struct(F.lit("input_text").alias("type"), _text().alias("text")))
    body = F.struct(F.lit("be kind").alias("instructions"), F.array(F.struct(F.col("role"), part.alias("content"))).alias("input"))
    found = provider_json.extracted(_bodies(table(spark, sf_dir, "conversations"), F.concat_ws("-", "conv_id", "turn"), body))
    return found.select("request_id", "request_kind", F.explode("segments").alias("s")).select("request_id", "request_kind", F.col("s.id").alias("segment_id"), "s.text")


@register(f"SELECT {_TURN} AS request_id, 'mcp' AS request_kind, coalesce(text, '') AS text FROM conversations")
def extract_tool_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-visible strings of tool calls: arguments, whatever their depth; names and numbers stay out."""
    arguments = F.struct(F.array(F.struct(_text().alias("value"), F.col("turn").alias("n"))).alias("items"))
    body = F.struct(F.lit("2.0").alias("jsonrpc"), F.struct(F.lit("f").alias("name"), arguments.alias("arguments")).alias("params"))
    found = provider_json.extracted(_bodies(table(spark, sf_dir, "conversations"), F.concat_ws("-", "conv_id", "turn"), body))
    return found.select("request_id", "request_kind", F.explode("segments").alias("s")).select("request_id", "request_kind", "s.text")


@register(f"SELECT {_TURN} AS request_id, coalesce(text, '') AS text FROM conversations")
def string_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool arguments that are JSON inside a string: the strings in it are leaves."""
    call = F.struct(F.struct(F.lit("f").alias("name"), F.to_json(F.struct(_text().alias("q"))).alias("arguments")).alias("function"))
    body = F.struct(F.array(F.struct(F.lit("assistant").alias("role"), F.array(call).alias("tool_calls"))).alias("messages"))
    found = provider_json.extracted(_bodies(table(spark, sf_dir, "conversations"), F.concat_ws("-", "conv_id", "turn"), body))
    return found.select("request_id", F.explode("segments").alias("s")).select("request_id", "s.text")


@register("SELECT CAST(c_custkey AS VARCHAR) AS request_id, c_custkey % 40 >= 32 AS too_deep FROM customer")
def structural_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies nested deeper than the bound are errors, not exceptions."""
    depth = (F.col("c_custkey") % 40).cast("int")
    body = F.concat(F.lit('{"messages": [{"role": "user", "content": "a"}], "x": '), F.repeat(F.lit("["), depth), F.lit("1"), F.repeat(F.lit("]"), depth), F.lit("}"))
    found = provider_json.extracted(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), body.alias("body")))
    return found.select("request_id", F.coalesce(F.col("problem").startswith("depth"), F.lit(False)).alias("too_deep"))


_PART = "CASE o_orderpriority WHEN '1-URGENT' THEN 'image_url' WHEN '2-HIGH' THEN 'input_audio' WHEN '3-MEDIUM' THEN 'text' WHEN '5-LOW' THEN 'refusal' ELSE 'other' END"


@register(f"SELECT CAST(o_orderkey AS VARCHAR) AS request_id, ({_PART}) IN ('image_url', 'input_audio') AS attachments_present FROM orders")
def attachment_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content parts of designated types are attachments, unknown ones are not."""
    body = F.struct(F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.expr(_PART).alias("type"))).alias("content"))).alias("messages"))
    return provider_json.extracted(_bodies(table(spark, sf_dir, "orders"), F.col("o_orderkey"), body)).select("request_id", "attachments_present")


@register("SELECT CAST(o_orderkey AS VARCHAR) AS request_id, o_orderstatus = 'F' AS speaks FROM orders")
def speaking_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a body holds a string value anywhere."""
    body = F.when(F.col("o_orderstatus") == "F", '{"a": [1, {"b": "x"}]}').otherwise('{"a": [1, {"b": null}]}')
    return provider_json.speaking(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), body.alias("body")))


@register("SELECT CAST(c_custkey AS VARCHAR) AS request_id, least(128, c_custkey % 200 + 1) AS last_part, c_custkey % 200 + 1 > 128 AS truncated FROM customer")
def bounded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of tool arguments with long names: parts are cut at 128 characters."""
    n = (F.col("c_custkey") % 200 + 1).cast("int")
    body = F.concat(F.lit('{"jsonrpc": "2.0", "params": {"arguments": {"'), F.repeat(F.lit("k"), n), F.lit('": "v"}}}'))
    got = Engine(P.default(), nothing, KEYS).analyze_json(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("request_id"), body.alias("body")))
    path = F.get(F.col("paths"), F.lit(0))
    return got.select("request_id", F.length(F.element_at(path.path, -1)).cast("long").alias("last_part"), path.truncated.alias("truncated"))


@register(f"SELECT CAST(conv_id AS VARCHAR) AS request_id, CASE WHEN bool_or(regexp_matches(text, '{WORD}')) THEN 'apply_actions' ELSE 'pass' END AS decision, string_agg(regexp_replace(coalesce(text, ''), '{WORD}', '<PRIVATE>', 'g'), '|' ORDER BY turn) AS texts FROM conversations GROUP BY conv_id")
def rebuild_chat_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat bodies analysed, written back, and read again: what each message says."""
    pol = dataclasses.replace(P.default(), entity_policies=(P.EntityPolicy("PRIVATE", "replace", patterns=(WORD,)),))
    got = Engine(pol, nothing, KEYS).analyze_json(q._chat_bodies(spark, sf_dir))
    messages = F.from_json("body", "struct<messages:array<struct<role:string,content:string>>>").getField("messages")
    return got.select("request_id", "decision", F.array_join(F.transform(messages, lambda m: m.content), "|").alias("texts"))


# ---- preflight and errors
_NO_TEXT = "SELECT CAST(o_orderkey AS VARCHAR) AS request_id, CASE WHEN o_orderstatus = 'P' AND o_orderpriority <> '5-LOW' THEN NULL ELSE 'pass' END AS decision, CASE WHEN o_orderstatus = 'P' AND o_orderpriority <> '5-LOW' THEN 'no_text' END AS reason FROM orders"


@register(_NO_TEXT)
def no_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests without a segment are errors, tool calls without one pass."""
    segments = F.when(F.col("o_orderstatus") == "P", F.array().cast(sources.SEGMENTS)).otherwise(_one(F.lit("a"), F.lit("hello")).cast(sources.SEGMENTS))
    kind = F.when(F.col("o_orderpriority") == "5-LOW", "mcp").otherwise("chat")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), kind.alias("request_kind"), segments.alias("segments"))
    return Engine(P.default(), nothing, KEYS).analyze(rows, columns=("request_id", "decision", "error")).select("request_id", "decision", F.col("error.reason").alias("reason"))


@register("SELECT CAST(c_custkey AS VARCHAR) AS request_id, CASE WHEN c_custkey % 80 <= 64 THEN 'pass' END AS decision, c_custkey % 80 <= 64 AS remote_allowed, c_custkey % 80 <= 64 AS has_text, CASE WHEN c_custkey % 80 > 64 THEN c_custkey % 80 END AS too_many FROM customer")
def entity_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More than 64 entities: an error without decision, text or leave to go out."""
    n = (F.col("c_custkey") % 80).cast("int")
    names = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("MCP_TOOL_"), i.cast("string")))
    pol = dataclasses.replace(P.default(), entity_policies=(P.EntityPolicy("MCP_TOOL_DEFAULT", "pass"),))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), names.alias("mcp_sources"), _one(F.lit("a"), F.lit("hello")).alias("segments"))
    got = Engine(pol, nothing, KEYS).analyze(rows, columns=("request_id", "decision", "remote_allowed", "segments", "error"))
    return got.select("request_id", "decision", "remote_allowed", F.col("segments").isNotNull().alias("has_text"), F.col("error.measured").alias("too_many"))


@register("SELECT doc_id, CASE WHEN length(coalesce(text, '')) % 7 > 0 THEN 'apply_actions' END AS decision, CASE WHEN length(coalesce(text, '')) % 7 = 0 THEN 'invalid_span' END AS reason FROM documents")
def invalid_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence outside the text is an error of its request."""
    detector = lambda text: F.array(spans.span("PRIVATE", F.lit(0), F.length(text) % 7, 1.0, "deterministic"))
    got = Engine(_PRIVATE, detector, KEYS).analyze_documents(table(spark, sf_dir, "documents").withColumn("text", F.lower("text")), columns=("request_id", "decision", "error"))
    return got.select(F.col("request_id").cast("long").alias("doc_id"), "decision", F.col("error.reason").alias("reason"))


@register("SELECT CAST(c_custkey AS VARCHAR) AS request_id, CASE WHEN c_custkey % 3 > 0 THEN 'apply_actions' END AS decision, CASE WHEN c_custkey % 3 = 0 THEN 'placeholder' END AS reason FROM customer")
def placeholder_clash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request that already holds the placeholder of its own value is an error."""
    id_, mail = F.col("c_custkey").cast("string"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.com"))
    mark = digests.placeholder(KEYS.hash_key, "REV", digests.nonce(KEYS.nonce_seed, id_), F.lit("EMAIL_ADDRESS"), mail)
    text = F.concat(mail, F.lit(" and "), F.when(F.col("c_custkey") % 3 == 0, mark).otherwise("more"))
    pol = P.Policy(default_action="pass", entity_policies=(P.EntityPolicy("EMAIL_ADDRESS", "reversible_replace"),))
    got = Engine(pol, detect.deterministic(("EMAIL_ADDRESS",)), KEYS).analyze(table(spark, sf_dir, "customer").select(id_.alias("request_id"), F.lit("request").alias("scope"), _one(F.lit("a"), text).alias("segments")), columns=("request_id", "decision", "error"))
    return got.select("request_id", "decision", F.col("error.reason").alias("reason"))


# ---- detection and plug-ins
@register("SELECT doc_id, start, \"end\", CAST(0.95 AS DOUBLE) AS score, 'policy_regex' AS source FROM " + q.span_sql("documents", "doc_id", "text", WORD, "PRIVATE"))
def policy_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns that a policy gives to an entity."""
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(detect.policy_patterns(_PRIVATE)(F.col("text"))).alias("s"))
    return each.select("doc_id", "s.start", "s.end", "s.score", detect.taxonomy(F.col("s.source")).alias("source"))


@register("SELECT doc_id, source, count(*) AS n FROM (SELECT doc_id, 'deterministic' AS source FROM " + q.span_sql("documents", "doc_id", "text", q.PATTERN["EMAIL_ADDRESS"], "E") + " UNION ALL SELECT doc_id, 'policy-regex' FROM " + q.span_sql("documents", "doc_id", "text", WORD, "P") + ") GROUP BY doc_id, source")
def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of two layers, told apart by their source."""
    both = detect.layered(detect.deterministic(("EMAIL_ADDRESS",)), detect.policy_patterns(_PRIVATE))
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(both(F.col("text"))).alias("s"))
    return each.groupBy("doc_id", F.col("s.source").alias("source")).agg(F.count("*").alias("n"))


@register("SELECT doc_id, CAST(length(text) % 10 AS DOUBLE) / 10 AS score FROM documents WHERE length(text) % 10 >= 5")
def model_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's spans, only those that reach the threshold."""
    model = detect.SpanModel("by length", lambda texts: [[("PRIVATE", 0, 1, len(t) % 10 / 10, "transformer")] if t else [] for t in texts])
    found = detect.with_model(table(spark, sf_dir, "documents").select("doc_id", "text"), model, threshold=0.45, entities=("PRIVATE",))
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.score")


class _TooLarge(Exception):
    pass


def _marks(window: str) -> list[tuple[str, int, int, float]]:
    if len(window) > 512:
        raise _TooLarge
    return [(label, m.start(), m.end(), 0.9) for m in re.finditer("[@|]", window) for label in (("per",) if m.group() == "@" else ("misc",))]


@register("SELECT doc_id, len(string_split(text, '@')) - 1 AS n FROM documents WHERE contains(text, '@')")
def remote_recognizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model behind a call: windows, halving of those it finds too large, labels mapped and ignored."""
    model = detect.remote("marks", _marks, {"per": "PERSON_NAME"}, ("misc",), _TooLarge, 1024, 128, 1_000_000)
    found = detect.with_model(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return found.select("doc_id", F.size("spans").cast("long").alias("n")).where("n > 0")


def _mapped(labels: dict[str, str], ignored: tuple[str, ...]) -> tuple[list[str], str]:
    every = [*labels, *(x for x in ignored if x not in labels)]
    rows = [(i, labels.get(x)) for i, x in enumerate(every)]
    return every, f"SELECT e AS entity_type, count(*) AS n FROM orders JOIN {_values(rows)} AS t(i, e) ON o_orderkey % {len(every)} = i WHERE e IS NOT NULL GROUP BY e"


def _labelled(name: str, labels: dict[str, str], ignored: tuple[str, ...] = ()) -> None:
    every, sql = _mapped(labels, ignored)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        label = F.get(F.array(*[F.lit(x) for x in every]), (F.col("o_orderkey") % len(every)).cast("int"))
        one = detect.normalized_labels(F.array(spans.span(label, F.lit(0), F.lit(1), 1.0, "transformer")), labels, ignored)
        each = table(spark, sf_dir, "orders").select(F.explode(one).alias("s"))
        return each.groupBy("s.entity_type").agg(F.count("*").alias("n"))

    query.__name__ = name
    register(sql)(query)


_labelled("labels_spacy", catalog.SPACY_LABELS, catalog.SPACY_IGNORED)
_labelled("labels_gliner", catalog.GLINER_LABELS)
_labelled("labels_german", catalog.GERMAN_LABELS)


@register("SELECT CASE l_returnflag WHEN 'A' THEN 'transformer' WHEN 'N' THEN 'spacy' ELSE 'deterministic' END AS source, count(*) AS n FROM lineitem GROUP BY 1")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public sources of recognizers by their names."""
    name = F.when(F.col("l_returnflag") == "A", "GLiNERRecognizer").when(F.col("l_returnflag") == "N", "SpacyRecognizer").otherwise("IbanRecognizer")
    return table(spark, sf_dir, "lineitem").groupBy(detect.provenance(name).alias("source")).agg(F.count("*").alias("n"))


@register("SELECT doc_id, start, \"end\" FROM " + q.span_sql("documents", "doc_id", "text", "[A-Z][a-z]{9,}", "REF"))
def recognizer_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two custom recognizers only that of an analysed language runs."""
    own = (P.CustomRecognizer("en", "REF", "[A-Z][a-z]{9,}", 0.8, ("en", "nl")), P.CustomRecognizer("de", "OTHER", "[a-z]{3,}", 0.8, ("de",)))
    pol = P.Policy(analyzer_entities=("REF", "OTHER"), custom_recognizers=own)
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(detect.scored_rules(pol)(F.col("text"))).alias("s"))
    return each.select("doc_id", "s.start", "s.end")


@register("WITH " + q._SPANS_SQL + " SELECT k, e AS entity_type, a AS start, b AS \"end\", src AS source, max(sc) AS score FROM s GROUP BY k, e, a, b, src")
def best_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best score of each (entity, start, end, source)."""
    df = q._line_spans(spark, sf_dir).withColumn("s", F.explode(spans.best(F.col("spans"), by_source=True)))
    return df.select("k", "s.entity_type", "s.start", "s.end", "s.source", "s.score")


_LEADS = (("telefon ", True), ("Rufnummern sind ", True), ("mobiel: ", True), ("gsm ", False), ("HANDY der ", True), ("nummer is ", True), ("call me one two three four five ", False))


@register("SELECT c_custkey, CAST(0.75 AS DOUBLE) AS score FROM customer WHERE c_custkey % 7 NOT IN (3, 6)")
def context_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone numbers that context words of three languages lift: inflections, stop words, and only five words back."""
    lead = F.get(F.array(*[F.lit(x) for x, _ in _LEADS]), (F.col("c_custkey") % len(_LEADS)).cast("int"))
    text = F.concat(lead, F.lit("+31 6 "), F.lpad(F.col("c_custkey").cast("string"), 8, "1"))
    pol = P.Policy(analyzer_languages=("en", "de", "nl"), analyzer_entities=("PHONE_NUMBER",))
    each = dealt(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", F.explode(detect.scored_rules(pol)(text)).alias("s"))
    return each.select("c_custkey", F.round("s.score", 6).alias("score"))


_STOP = ", ".join(q._quoted(w) for w in catalog.STOP_WORDS["en"])


@register(rf"""SELECT conv_id, turn, list_filter([replace(lower(w), 'ß', 'ss') FOR w IN regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}]+')], lambda w: NOT list_contains([{_STOP}], w))[-5:] AS words FROM conversations""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five content words of every turn."""
    near = spans.let(context.words(_text()), lambda index: context.window(index, F.length(_text()) + 1, "en"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", near.alias("words"))


# ---- results
@register(f"""WITH w AS (SELECT conv_id, unnest(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS v FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS request_id, CAST(count(*) AS INTEGER) AS detected_count, CAST(count(*) AS INTEGER) AS transformed_count, CAST(count(DISTINCT v) AS INTEGER) AS unique_transformed_count FROM w GROUP BY conv_id""")
def merged_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of one entity over all segments of a request, distinct values counted once."""
    one = F.struct(F.col("turn").cast("string").alias("id"), F.col("text").alias("text"))
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("request_id")).agg(F.array_sort(F.collect_list(one)).alias("segments"))
    got = Engine(_PRIVATE, nothing, KEYS).analyze(rows, columns=("request_id", "report_rows")).select("request_id", F.explode("report_rows").alias("r"))
    return got.select("request_id", "r.detected_count", "r.transformed_count", "r.unique_transformed_count")


@register(q._DECIDED_SQL + """ SELECT h.doc_id, entity_type, 'block' AS action, CAST(count(*) AS INTEGER) AS detected_count, 0 AS transformed_count FROM h JOIN r ON h.doc_id = r.doc_id WHERE decision = 'block' GROUP BY h.doc_id, entity_type""")
def blocked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows of blocked documents: every row says block, nothing was transformed."""
    df = q._analysed(spark, sf_dir, "request_id", "decision", "report_rows").where("decision = 'block'").select(F.col("request_id").cast("long").alias("doc_id"), F.explode("report_rows").alias("r"))
    return df.select("doc_id", "r.entity_type", "r.action", "r.detected_count", "r.transformed_count")


@register(q._DECIDED_SQL + " SELECT doc_id, string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS entities FROM h GROUP BY doc_id")
def ordered_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of every document with one, in order."""
    df = q._analysed(spark, sf_dir, "request_id", "entities").select(F.col("request_id").cast("long").alias("doc_id"), F.array_join("entities", ",").alias("entities"))
    return df.where("entities <> ''")


@register("SELECT doc_id, start, \"end\", entity_type, CASE entity_type WHEN 'EMAIL_ADDRESS' THEN 'mask' ELSE 'reroute' END AS configured_action, CASE entity_type WHEN 'EMAIL_ADDRESS' THEN 'mask' ELSE 'reroute' END AS resolved_action FROM (" + _hits("documents", "doc_id", "text") + ")")
def detections_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical detections with the action configured and the one that won their region."""
    df = q._ENGINE.analyze(sources.documents(table(spark, sf_dir, "documents")), diagnostics=True, columns=("request_id",))
    each = df.select(F.col("request_id").cast("long").alias("doc_id"), F.explode("logical_detections").alias("d"))
    return each.select("doc_id", "d.start", "d.end", "d.entity_type", "d.configured_action", "d.resolved_action")


@register("SELECT n_nationkey, least(2048, n_nationkey * 5 + 1990) AS shown, n_nationkey * 5 + 1990 > 2048 AS truncated FROM nation")
def diagnostics_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 2048 detections are explained, and it is told when there were more."""
    text = F.repeat(F.lit("a@b.com "), (F.col("n_nationkey") * 5 + 1990).cast("int"))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("request_id"), F.lit("request").alias("scope"), _one(F.lit("a"), text).alias("segments"))
    got = Engine(q._DOCS, detect.deterministic(("EMAIL_ADDRESS",)), KEYS).analyze(rows, diagnostics=True, columns=("request_id",))
    return got.select(F.col("request_id").cast("long").alias("n_nationkey"), F.size("logical_detections").cast("long").alias("shown"), F.col("diagnostics_truncated").alias("truncated"))


@register("""SELECT request_id, body, CASE WHEN size > 42 THEN size END AS too_large FROM (SELECT request_id, CASE WHEN size <= 42 THEN body END AS body, size FROM (SELECT CAST(doc_id AS VARCHAR) AS request_id, body, CAST(octet_length(encode(body)) AS BIGINT) AS size FROM (""" + q._DECIDED_SQL + """ SELECT doc_id, '{"request_id":"' || CAST(doc_id AS VARCHAR) || '","decision":"' || decision || '"}' AS body FROM r)))""")
def bounded_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of every result, or its size where it is beyond the bound."""
    from ..sources import sinks

    got = sinks.responses(q._analysed(spark, sf_dir, "request_id", "decision"), 42)
    return got.select("request_id", "body", F.col("problem.measured").alias("too_large"))


_PLAIN_TEXT = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@register("WITH p AS (SELECT CAST(page_id AS VARCHAR) AS request_id, " + _PLAIN_TEXT + " AS t FROM pages), h AS (" + _hits("p", "request_id", "t") + """), a AS (SELECT request_id, count(DISTINCT entity_type) AS n, bool_or(entity_type = 'IP_ADDRESS') AS ip, bool_or(entity_type = 'CREDIT_CARD_NUMBER') AS card FROM h GROUP BY request_id)
SELECT p.request_id, CASE WHEN ip AND card THEN 'block' WHEN ip OR card THEN 'reroute' WHEN n > 0 THEN 'apply_actions' ELSE 'pass' END AS decision, CAST(coalesce(n, 0) AS INTEGER) AS entities FROM p LEFT JOIN a ON p.request_id = a.request_id""")
def page_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as documents: decisions and how many entities."""
    got = q._ENGINE.analyze(sources.pages(table(spark, sf_dir, "pages")), columns=("request_id", "decision", "entities"))
    return got.select("request_id", "decision", F.size("entities").alias("entities"))


@register(q._DECIDED_SQL + " SELECT doc_id, CASE WHEN n_ip + n_card > 0 THEN 'block' ELSE decision END AS decision FROM r")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions under an overridden policy: what was rerouted is blocked."""
    update = {"entity_policies": [{"entity_type": "EMAIL_ADDRESS", "action": "mask"}], "default_action": "block"}
    got = q._ENGINE.preview(sources.documents(table(spark, sf_dir, "documents")), update)
    return got.select(F.col("request_id").cast("long").alias("doc_id"), "decision")


@register(q._DECIDED_SQL + " SELECT doc_id, CASE WHEN n_mail > 0 THEN 'apply_actions' ELSE 'pass' END AS decision FROM r")
def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a candidate policy would decide."""
    results, _, _ = q._ENGINE.evaluate(sources.documents(table(spark, sf_dir, "documents")), {"entity_policies": [{"entity_type": "EMAIL_ADDRESS", "action": "redact"}]})
    return results.select(F.col("request_id").cast("long").alias("doc_id"), "decision")


@register(q._splice_sql("'{' || upper(m$) || '}'"))
def custom_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An action of the caller's own in place of masking."""
    pol = P.Policy(default_action="pass", entity_policies=(P.EntityPolicy("EMAIL_ADDRESS", "mask"),))
    engine = Engine(pol, detect.deterministic(("EMAIL_ADDRESS",)), KEYS, operators={"mask": lambda value, entity: F.concat(F.lit("{"), F.upper(value), F.lit("}"))})
    got = engine.analyze_documents(table(spark, sf_dir, "documents"), columns=("request_id", "decision", "segments")).where("decision = 'apply_actions'")
    return got.select(F.col("request_id").cast("long").alias("doc_id"), F.get(F.col("segments"), F.lit(0)).getField("text").alias("text"))


@register("SELECT doc_id, value, true AS hidden FROM " + q.span_sql("documents", "doc_id", "text", q.PATTERN["EMAIL_ADDRESS"], "EMAIL_ADDRESS"))
def cipher_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every e-mail address encrypted and decrypted again; the cipher text does not show it."""
    hits = q._found(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), "EMAIL_ADDRESS")
    hidden = hits.withColumn("c", transform.cipher(KEYS, F.col("entity_type"), F.col("value")))
    return hidden.select("doc_id", transform.deciphered(KEYS, F.col("entity_type"), F.col("c")).alias("value"), (~F.contains("c", "value") & (F.col("c") != F.base64(F.col("value").cast("binary")))).alias("hidden"))


@register("SELECT DISTINCT conv_id, " + q._hmac_sql("'palimpsest:v1:conversation:v1:' || sha256(CAST(conv_id AS VARCHAR))") + "[1:16] AS namespace FROM conversations")
def namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stable namespace of each conversation's placeholders."""
    key = F.sha2(F.col("conv_id").cast("string"), 256)
    return table(spark, sf_dir, "conversations").select("conv_id", digests.namespace(KEYS.hash_key, key, "v1").alias("namespace")).distinct()


# ---- sessions
_STATE = """s AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'block' WHEN 3 THEN 'pass' ELSE 'reroute' END AS decision, CASE WHEN c_custkey % 5 > 0 THEN 'r' END AS route, c_custkey % 7 = 0 AS remote, CASE WHEN c_custkey % 11 = 0 THEN 'mcp' ELSE 'chat' END AS kind,
  CASE c_custkey % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'reroute' ELSE 'mask' END AS act, c_custkey % 6 AS n, c_custkey % 13 = 0 AS changed FROM customer)"""


@register("WITH " + _STATE + """ SELECT k, CASE WHEN decision = 'block' AND changed THEN 'block_transforms' WHEN decision = 'block' AND act <> 'block' THEN 'block_without_row' WHEN decision = 'pass' THEN 'decision'
WHEN kind = 'mcp' AND (decision <> 'block' OR route IS NOT NULL OR act = 'reroute') THEN 'mcp' WHEN decision = 'reroute' AND route IS NULL THEN 'no_route' WHEN remote THEN 'remote_allowed' WHEN decision = 'reroute' AND act <> 'reroute' THEN 'reroute_rows'
WHEN decision = 'block' AND route IS NOT NULL THEN 'route_of_block' WHEN n > 4 THEN 'rows_exceed_counts' END AS reason FROM s""")
def state_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a stored session decision cannot be trusted."""
    state = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), F.expr("CASE c_custkey % 4 WHEN 0 THEN 'block' WHEN 3 THEN 'pass' ELSE 'reroute' END").alias("decision"), F.expr("CASE WHEN c_custkey % 5 > 0 THEN 'r' END").alias("route_class"),
        F.expr("c_custkey % 7 = 0").alias("remote_allowed"), F.expr("CASE WHEN c_custkey % 11 = 0 THEN 'mcp' ELSE 'chat' END").alias("request_kind"), F.expr("array('IBAN')").alias("entities"),
        F.expr("array(named_struct('entity_type', 'IBAN', 'count', 4))").alias("entity_counts"), F.expr("cast(array() as array<string>)").alias("request_notices"), F.expr("cast(array() as array<string>)").alias("response_notices"),
        F.expr("array(named_struct('entity_type', 'IBAN', 'action', CASE c_custkey % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'reroute' ELSE 'mask' END, 'detected_count', c_custkey % 6, 'transformed_count', CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END))").alias("report_rows"),
    )
    d = F.struct(*[F.col(c) for c in state.columns])
    return state.select("k", session.unsound(d).alias("reason"))


_KINDS = q._TURNS_SQL.replace("FROM conversations WHERE text IS NOT NULL", ", CASE WHEN length(text) % 13 < 2 THEN 'mcp' ELSE 'chat' END AS kind FROM conversations WHERE text IS NOT NULL")


@register("WITH " + _KINDS + """, z AS (SELECT *, first_value(CASE WHEN decision IN ('block', 'reroute') THEN kind END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kept FROM t),
y AS (SELECT *, coalesce(kind <> kept, false) AS bad FROM z), p AS (SELECT *, first_value(CASE WHEN NOT bad THEN route END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM y),
s AS (SELECT *, NOT bad AND (decision = 'block' OR coalesce(route <> held, false)) AS stop FROM p),
c AS (SELECT *, coalesce(max(CASE WHEN stop THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS cached FROM s)
SELECT conv_id, turn, CASE WHEN bad THEN NULL WHEN cached OR stop THEN 'block' WHEN coalesce(held, route) IS NOT NULL THEN 'reroute' ELSE decision END AS final_decision, CASE WHEN bad THEN 'request_kind' END AS session_error FROM c""")
def sticky_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session with a decision takes requests of one kind; others are errors and leave it as it was."""
    kind = F.when(F.length("text") % 13 < 2, "mcp").otherwise("chat")
    turns = q._turns(spark, sf_dir).join(table(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("request_kind")), ["conv_id", "turn"])
    return session.sticky(turns, key="conv_id").select("conv_id", "turn", "final_decision", "session_error")


_OWN = f"regexp_matches(coalesce(text, ''), '{WORD}')"


@register(f"""WITH t AS (SELECT {_TURN} AS request_id, conv_id % 4 AS c, {_OWN} AS own FROM conversations)
SELECT request_id, CASE WHEN c = 0 OR (c = 1 AND own) THEN 'block' WHEN c = 1 OR own THEN 'reroute' ELSE 'pass' END AS decision, CASE WHEN c = 0 OR (c = 1 AND own) THEN NULL WHEN c = 1 THEN 'held' WHEN own THEN 'own' ELSE 'general' END AS route_class,
c <> 0 AS scan_performed, c = 0 OR (c = 1 AND NOT own) AS from_cache FROM t""")
def cached_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of sessions that have a decision: a blocked session is not scanned, a route holds, another one is a conflict."""
    rows = sources.conversations(table(spark, sf_dir, "conversations"))
    pol = dataclasses.replace(P.default(), entity_policies=(P.EntityPolicy("PRIVATE", "reroute", route_class="own", patterns=(WORD,)),))
    state = F.when(F.col("conv_id") % 4 == 0, "block").when(F.col("conv_id") % 4 == 1, "reroute").otherwise("pass")
    held = table(spark, sf_dir, "conversations").select(F.sha2(F.col("conv_id").cast("string"), 256).alias("session_key"), state.alias("decision"), F.when(state == "reroute", "held").alias("route_class")).distinct()
    return Engine(pol, nothing, KEYS).analyze_sessions(rows, held, ("request_id", "decision", "route_class", "scan_performed", "from_cache"))


@register(f"""WITH t AS (SELECT {_TURN} AS request_id, conv_id, turn, {_OWN} AS own FROM conversations), s AS (SELECT *, bool_or(own) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS any_ FROM t)
SELECT request_id, turn, CASE WHEN own THEN 'reroute' ELSE 'pass' END AS decision, CASE WHEN any_ THEN 'reroute' ELSE 'pass' END AS final_decision, CASE WHEN any_ THEN 'local' ELSE 'general' END AS final_route, false AS from_cache FROM s""")
def conversation_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns analysed and made sticky by conversation."""
    rows = sources.conversations(table(spark, sf_dir, "conversations"))
    pol = dataclasses.replace(P.default(), entity_policies=(P.EntityPolicy("PRIVATE", "reroute", patterns=(WORD,)),))
    got = Engine(pol, nothing, KEYS).analyze(rows, columns=("request_id", "decision", "route_class"))
    keyed = got.join(rows.select("request_id", "session_key", "turn"), "request_id")
    return session.sticky(keyed).select("request_id", "turn", "decision", "final_decision", "final_route", "from_cache")


def _overlay_rows(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    action = F.when(F.col("o_orderpriority") == "1-URGENT", "reroute").otherwise("mask")
    row = F.struct(F.col("o_orderstatus").alias("entity_type"), action.alias("action"), F.lit(1).alias("detected_count"))
    return table(spark, sf_dir, "orders").where("o_orderkey % 2 = " + ("0" if column == "cached" else "1")).groupBy("o_custkey", "o_orderstatus").agg(F.max(row).alias("r")).groupBy("o_custkey").agg(F.array_sort(F.collect_list("r")).alias(column))


@register("""WITH g AS (SELECT o_custkey, o_orderkey % 2 AS side, o_orderstatus AS e, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 'reroute' ELSE 'mask' END) AS act FROM orders GROUP BY ALL),
b AS (SELECT o_custkey FROM g GROUP BY o_custkey HAVING count(DISTINCT side) = 2), f AS (SELECT * FROM g WHERE side = 1 AND act = 'reroute'),
o AS (SELECT o_custkey, e, act FROM f UNION ALL SELECT o_custkey, e, act FROM g WHERE side = 0 AND NOT EXISTS (SELECT 1 FROM f WHERE f.o_custkey = g.o_custkey AND f.e = g.e))
SELECT o.o_custkey, string_agg(e || ':' || act, ',' ORDER BY e) AS rows FROM o JOIN b ON o.o_custkey = b.o_custkey GROUP BY o.o_custkey""")
def report_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows that a session keeps: its own, overlaid with the request's reroute rows."""
    both = _overlay_rows(spark, sf_dir, "cached").join(_overlay_rows(spark, sf_dir, "now"), "o_custkey")
    rows = session.overlaid_rows(F.col("cached"), F.col("now"))
    return both.select("o_custkey", F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r.entity_type, r.action)), ",").alias("rows"))


@register("""SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS entities FROM orders GROUP BY o_custkey""")
def merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of a request and of its session as one set."""
    side = lambda k: F.coalesce(F.collect_set(F.when(F.col("o_orderkey") % 2 == k, F.col("o_orderstatus"))), F.array().cast("array<string>"))
    both = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(side(1).alias("now"), side(0).alias("cached"))
    return both.select("o_custkey", F.array_join(session.merged_entities(F.col("now"), F.col("cached")), ",").alias("entities"))


@register("SELECT o_custkey, bool_or(n > 1) AS conflict FROM (SELECT o_custkey, o_orderkey % 10 AS p, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey")
def reversal_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one placeholder stands for two values in merged reversal maps."""
    pair = F.struct((F.col("o_orderkey") % 10).cast("string").alias("placeholder"), F.col("o_orderstatus").alias("original"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(pair).alias("pairs")).select("o_custkey", transform.conflicting(F.col("pairs")).alias("conflict"))


# ---- windows
def _words(text: str, special: bool) -> list[tuple[int, int]]:
    found = [m.span() for m in re.finditer("[^ ]+", text)]
    return [(0, 0), *found, (0, 0)] if special else found


@register("""WITH n AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ ]+')) AS n FROM documents) SELECT doc_id, CASE WHEN n <= 100 THEN 1 ELSE CAST(ceil((n - 100) / 80.0) AS BIGINT) + 1 END AS n_windows FROM n""")
def rechecked_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token windows whose size is checked by tokenising each again."""
    cut = windows.model_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), _words, 100, 20, 102)
    return cut.groupBy("doc_id").agg(F.count("*").alias("n_windows"))


@register("""WITH n AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN n > 6 THEN 'model_call_budget' END AS error, CASE WHEN n <= 6 THEN CAST(len(string_split(coalesce(text, ''), 'a')) - 1 AS INTEGER) END AS n_spans FROM n""")
def call_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of a conversation share six calls of a model; a conversation that needs more has an error, the others their spans."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    model = lambda t: [("PRIVATE", m.start(), m.end(), 0.9, "transformer") for m in re.finditer("a", t)]
    got = windows.budgeted(turns, model, 6, "conv_id", ("turn",), "text")
    return got.select("conv_id", "turn", "error", F.size("spans").alias("n_spans"))


@register("SELECT DISTINCT doc_id, " + q._hmac_sql("'ns' || chr(31) || text", b"window-cache") + " AS window_hash FROM documents WHERE text IS NOT NULL")
def window_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed digests that windows are remembered by."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").alias("window_text"))
    return windows.memoised(docs, lambda texts: [[] for _ in texts], "ns").select("doc_id", "window_hash").distinct()


@register("""WITH d AS (SELECT conv_id, turn, n, CASE WHEN n % 4 = 0 THEN 'reroute' WHEN n % 11 = 1 THEN 'block' ELSE 'pass' END AS decision, CASE WHEN n % 4 = 0 THEN CASE WHEN n % 3 = 0 THEN 'b' ELSE 'a' END END AS route FROM (SELECT conv_id, turn, coalesce(length(text), 0) AS n FROM conversations)),
f AS (SELECT *, min(CASE WHEN decision <> 'pass' THEN turn END) OVER (PARTITION BY conv_id) AS t0, first_value(route IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS r0 FROM d),
s AS (SELECT *, min(CASE WHEN decision = 'block' OR route <> r0 THEN turn END) OVER (PARTITION BY conv_id) AS stop FROM f),
a AS (SELECT *, bool_or(turn = stop AND decision = 'block') OVER (PARTITION BY conv_id) AS alone FROM s WHERE turn >= t0 AND (stop IS NULL OR turn <= stop)),
k AS (SELECT *, turn = t0 OR alone OR turn = stop AS whole FROM a WHERE NOT coalesce(alone, false) OR turn = stop)
SELECT conv_id, CASE WHEN any_value(stop) IS NULL THEN 'reroute' ELSE 'block' END AS decision, CASE WHEN any_value(stop) IS NULL THEN any_value(r0) END AS route, CAST(max(n % 6) AS BIGINT) AS overlaps,
  CAST(max(n % 3 + 1) AS BIGINT) AS bsn, CAST(max(n % 5 + 1) AS BIGINT) AS iban, CAST(arg_max(n % 5 + 1, turn) FILTER (whole OR decision = 'reroute') AS BIGINT) AS iban_detected,
  CASE WHEN any_value(stop) IS NULL THEN 'reroute' ELSE 'block' END AS iban_action, CASE WHEN any_value(stop) IS NULL OR bool_or(alone) THEN 'mask' ELSE 'block' END AS bsn_action,
  CASE WHEN any_value(stop) IS NULL THEN CAST(arg_max(n % 2, turn) FILTER (whole) AS BIGINT) ELSE 0 END AS bsn_transformed FROM k GROUP BY conv_id""")
def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every conversation holds after its last turn: decision, route, counts and report rows."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))
    turns = turns.withColumn("decision", F.expr("CASE WHEN n % 4 = 0 THEN 'reroute' WHEN n % 11 = 1 THEN 'block' ELSE 'pass' END")).withColumn("route_class", F.expr("CASE WHEN n % 4 = 0 THEN CASE WHEN n % 3 = 0 THEN 'b' ELSE 'a' END END"))
    action = "CASE decision WHEN 'pass' THEN 'mask' ELSE decision END"
    row = "named_struct('entity_type', '{}', 'action', {}, 'detected_count', {}, 'transformed_count', n % 2)"
    turns = turns.withColumn("entity_counts", F.expr("array(named_struct('entity_type', 'BSN', 'count', n % 3 + 1), named_struct('entity_type', 'IBAN', 'count', n % 5 + 1))"))
    turns = turns.withColumn("report_rows", F.expr(f"array({row.format('BSN', repr('mask'), '1L')}, {row.format('IBAN', action, 'n % 5 + 1')})"))
    held = session.held(turns.withColumn("request_kind", F.lit("chat")).withColumn("overlap_count", F.col("n") % 6), "conv_id", "turn")
    count, kept = (lambda i: F.get("entity_counts", F.lit(i)).getField("count")), (lambda i: F.get("report_rows", F.lit(i)))
    return held.select(
        "conv_id", "decision", "route", "overlaps", count(0).alias("bsn"), count(1).alias("iban"), kept(1).getField("detected_count").alias("iban_detected"), kept(1).getField("action").alias("iban_action"),
        kept(0).getField("action").alias("bsn_action"), kept(0).getField("transformed_count").alias("bsn_transformed"),
    )
