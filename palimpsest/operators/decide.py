"""Request decisions, computed inside the request's row.

Input is one row per request (see ``sources.requests``) with its segments in an array, so a whole analysis is one
narrow stage: detection, resolution, decision and rewriting need no shuffle. Requests that a
preflight check settles are never scanned for entities. Only the result columns that are asked for are computed.

Whatever cannot be decided is an error value of its request, which then carries no decision and no text: nothing
is let through, and no request ends a job over many.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefilter import lowered, possible
from ..functions.spans import invalid, let, no_spans
from ..policy import Policy
from . import detect, resolve, transform

ROW = "struct<entity_type:string,action:string,detected_count:int,transformed_count:int,unique_transformed_count:int>"
MAX_SEGMENTS, MAX_CHARACTERS, MAX_ENTITIES, MAX_DIAGNOSTICS = 2000, 4_000_000, 64, 2048
# Texts of notices.
PASSED = "Sensitive data was detected and passed through by policy."
NOTHING = "No sensitive data was detected by the configured policy."
ATTACHED = "Attachments are blocked by the configured policy."
FACES = "Faces were detected; images must be withheld."


def _strings() -> Column:
    return F.array().cast("array<string>")


def _rows() -> Column:
    return F.array().cast(f"array<{ROW}>")


def _set(array: Column) -> Column:
    return F.array_sort(F.array_distinct(array))


def limits(df: DataFrame, most_segments: int = MAX_SEGMENTS, most_characters: int = MAX_CHARACTERS) -> DataFrame:
    """``error``: the bound that a request breaks, as struct(reason, measured, maximum), or null.

    A breach is a value, not an exception, so one bad request does not end a job over many.
    """
    n = F.size("segments")
    size = F.aggregate("segments", F.lit(0).cast("long"), lambda acc, s: acc + F.length(s.text))
    wanted = (F.col("text_pii_enabled") | F.col("face_status").isNotNull()) & ((n > 0) | ~F.col("attachments_present"))
    mcp_empty = (F.col("request_kind") == "mcp") & (n == 0) & ~F.col("attachments_present")
    error = (
        F.when(mcp_empty, None).when(wanted & (n == 0), _breach("no_text", n, 0)).when(n > most_segments, _breach("segments", n, most_segments))
        .when(size > most_characters, _breach("text_characters", size, most_characters))
    )
    return df.withColumn("error", error).withColumn("mcp_empty", mcp_empty)


def safety_rule(policy: Policy, segments: Column) -> Column:
    """The first safety rule, in the policy's order, that some segment matches: struct(name, message), or null."""

    def first(texts: Column) -> Column:
        out = F.lit(None).cast("struct<name:string,message:string>")
        for name, pattern, message in reversed(policy.safety_rules):
            hit = F.exists(texts, lambda s: possible(s.text, pattern, s.low) & s.text.rlike(f"(?U){pattern}"))  # noqa: B023
            out = F.when(hit, F.struct(F.lit(name).alias("name"), F.lit(message).alias("message"))).otherwise(out)
        return out

    return let(F.transform(segments, lambda s: F.struct(s.text.alias("text"), lowered(s.text).alias("low"))), first)


def source_rows(policy: Policy, sources: Column, model: Column) -> Column:
    """Action and route of each tool source: the model's rule, the model's default, the global rule, the global default, or block."""
    entry = "struct<action:string,route:string>"

    def table(rules) -> Column | None:
        pairs = [x for e in rules if e.entity_type.startswith("MCP_TOOL_") for x in (F.lit(e.entity_type), F.struct(F.lit(e.action).alias("action"), F.lit(e.route_class).alias("route")).cast(entry))]
        return F.create_map(*pairs) if pairs else None

    general = table(policy.entity_policies)
    models = {m: t for m, rules in policy.model_source_policies.items() if (t := table(rules)) is not None}

    def one(source: Column) -> Column:
        look = lambda t, key: F.element_at(t, key)
        found = F.lit(None).cast(entry)
        for name, t in models.items():
            found = F.when(model == name, F.coalesce(look(t, source), look(t, F.lit("MCP_TOOL_DEFAULT")))).otherwise(found)
        if general is not None:
            found = F.coalesce(found, look(general, source), look(general, F.lit("MCP_TOOL_DEFAULT")))
        action = F.coalesce(found.action, F.lit("block"))
        return F.struct(source.alias("entity_type"), action.alias("action"), F.when(action == "reroute", F.coalesce(found.route, F.lit(policy.default_target))).alias("route"))

    return F.transform(sources, one)


PLAN = f"struct<id:string,text:string,bad:boolean,logical:array<{resolve.LOGICAL}>,regions:array<{resolve.REGION}>>"


def planned(df: DataFrame, policy: Policy, detector: detect.Detector) -> DataFrame:
    """``plans``: for each segment its logical detections and regions (empty where no text is scanned), and whether its evidence is ``bad``."""
    mcp = F.col("request_kind") == "mcp"

    def of(s: Column) -> Column:
        bad = invalid(s.found, s.text)
        good = F.when(bad, no_spans()).otherwise(s.found)
        return let(resolve.logical(good), lambda d: F.struct(s.id.alias("id"), s.text.alias("text"), bad.alias("bad"), d.alias("logical"), resolve.regions(d, policy, mcp).alias("regions")))

    # two columns, as the analyzer bounds how deep the lambdas of one may go
    found = F.transform("segments", lambda s: F.struct(s.id.alias("id"), s.text.alias("text"), detector(s.text).alias("found")))
    df = df.withColumn("__found", F.when(F.col("scan"), found))
    scanned = F.transform("__found", of)
    return df.withColumn("plans", F.coalesce(scanned.cast(f"array<{PLAN}>"), F.array().cast(f"array<{PLAN}>"))).drop("__found")


def _changes(policy: Policy, regions: Column) -> Column:
    """Whether a region's text is changed."""
    return regions.action.isin(*transform.CHANGES) | ((regions.action == "reroute") & F.lit(policy.mask_on_reroute))


def _report(policy: Policy, mcp: Column, logical: Column, changed: Column) -> Column:
    """One row per entity: detections, transformed regions that it won, and distinct originals of those."""

    def one(entity: Column) -> Column:
        def row(mine: Column) -> Column:
            return F.struct(
                entity.alias("entity_type"), resolve.effective_action(policy, entity, mcp).alias("action"), F.size(F.filter(logical, lambda d: d.entity_type == entity)).alias("detected_count"),
                F.size(mine).alias("transformed_count"), F.size(F.array_distinct(mine)).alias("unique_transformed_count"),
            )

        return let(F.transform(F.filter(changed, lambda e: e.entity_type == entity), lambda e: e.original), row)

    return F.transform(_set(F.transform(logical, lambda d: d.entity_type)), one)


def _blocked_rows(rows: Column) -> Column:
    """Rows of a blocked result: nothing was transformed, and some row says block."""
    has = F.exists(rows, lambda r: r.action == "block")
    return F.transform(rows, lambda r: r.withField("action", F.when(has, r.action).otherwise("block")).withField("transformed_count", F.lit(0)).withField("unique_transformed_count", F.lit(0)))


def classified(policy: Policy, text: Column) -> Column:
    """The first class with a matching pattern, or the default class."""
    out = F.lit(policy.default_class)
    for name, patterns in reversed(policy.classes):
        out = F.when(detect.any_pattern(text, list(patterns)), name).otherwise(out)
    return out


def _breach(reason: str, measured: Column, most: int) -> Column:
    return F.struct(F.lit(reason).alias("reason"), measured.cast("long").alias("measured"), F.lit(most).cast("long").alias("maximum"))


def _preflight(requests: DataFrame, policy: Policy) -> DataFrame:
    """What is known without a scan: bounds, safety, tool sources, faces; ``early`` names what settles a request, ``scan`` is whether nothing does."""
    df = limits(requests)
    known = F.coalesce(F.col("cached_decision") == "block", F.lit(False))  # the session is blocked: nothing else matters
    df = df.withColumns({"error": F.when(~known, F.col("error")), "known": known})
    routes = lambda rows: _set(F.filter(F.transform(rows, lambda r: r.route), lambda r: r.isNotNull()))
    df = df.withColumns({
        "safety": F.when(~F.col("known") & F.col("error").isNull() & ~F.col("mcp_empty") & ~F.col("attachments_present"), safety_rule(policy, F.col("segments"))),
        "sources": source_rows(policy, _set(F.coalesce("mcp_sources", _strings())), F.col("destination_model")),
        "has_face": F.coalesce(F.col("face_count") > 0, F.lit(False)),
    })
    df = df.withColumn("source_routes", routes(F.col("sources")))
    face_route = F.when(F.col("has_face") & F.lit(policy.faces.action == "reroute"), F.lit(policy.faces.route_class or policy.default_target))
    face_block = F.coalesce(F.col("face_status") == "failed", F.lit(False)) | (F.col("has_face") & F.lit(policy.faces.action == "block"))
    source_block = F.exists("sources", lambda r: r.action == "block") | (F.size("source_routes") > 1)
    early = (
        F.when(F.col("known"), "cached").when(F.col("error").isNotNull(), "error").when(F.col("mcp_empty"), "empty").when(F.col("attachments_present"), "attachments").when(F.col("safety").isNotNull(), "safety")
        .when(face_block, "face").when(source_block, "source").when(~F.col("text_pii_enabled"), "unscanned")
    )
    return df.withColumns({"face_route": face_route, "early": early, "scan": early.isNull()})


def _routed(df: DataFrame, policy: Policy) -> DataFrame:
    """Detections, regions, routes, and whether the request is ``blocked``."""
    mcp = F.col("request_kind") == "mcp"
    df = df.withColumns({"logical": F.flatten(F.transform("plans", lambda p: p.logical)), "regions": F.flatten(F.transform("plans", lambda p: p.regions))})
    rerouted = F.filter(F.array_distinct(F.transform("logical", lambda d: d.entity_type)), lambda e: resolve.effective_action(policy, e, mcp) == "reroute")
    needed = F.array_union(F.col("source_routes"), F.array_distinct(F.transform(rerouted, lambda e: resolve.route_of(policy, e))))
    one = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(_strings())
    held = F.when(F.col("cached_decision") == "reroute", F.col("cached_route"))  # a session's route: another one is a conflict
    df = df.withColumns({"held": held, "routes": F.array_union(F.array_union(needed, one(F.col("face_route"))), one(held))})
    text_block = F.col("scan") & F.exists("regions", lambda r: r.action == "block")
    settled = F.col("early").isin("cached", "attachments", "safety", "face", "source")
    blocked = F.coalesce(settled, F.lit(False)) | (F.col("scan") | F.coalesce(F.col("early") == "unscanned", F.lit(False))) & (text_block | (F.size("routes") > 1))
    df = df.withColumn("blocked", F.coalesce(blocked, F.lit(False)))
    light = lambda p: F.transform(F.filter(p.regions, lambda r: _changes(policy, r)), lambda r: F.struct(r.entity_type.alias("entity_type"), r.action.alias("action"), F.substr(p.text, r.start + 1, r.end - r.start).alias("original")))
    return df.withColumns({"apply": F.col("scan") & ~F.col("blocked"), "changed": F.when(F.col("scan") & ~F.col("blocked"), F.flatten(F.transform("plans", light))).otherwise(F.array().cast("array<struct<entity_type:string,action:string,original:string>>"))})


def _rewritten(df: DataFrame, policy: Policy, keys: transform.Keys, operators: Mapping[str, transform.Operator] | None) -> DataFrame:
    """``out``, the segments with their regions replaced, and ``reversal``; ``clash``, whether a placeholder is ambiguous or was in the request before."""
    df = df.withColumn("nonce", F.coalesce(F.col("placeholder_namespace"), digests_nonce(keys)))
    edited = F.transform("plans", lambda p: F.struct(p.id.alias("id"), p.text.alias("text"), transform.done(p.text, p.regions, policy, keys, F.col("nonce"), operators).alias("edits")))
    df = df.withColumn("edited", F.when(F.col("apply"), edited))
    out = F.when(F.col("apply"), F.transform("edited", lambda p: F.struct(p.id.alias("id"), transform.spliced(p.text, p.edits).alias("text")))).when(~F.col("blocked") & F.col("error").isNull(), F.col("segments"))
    none = F.array().cast("array<struct<placeholder:string,original:string>>")
    reversible = any(e.action in ("encrypt", "reversible_replace") for e in policy.entity_policies) or policy.default_action in ("encrypt", "reversible_replace")
    df = df.withColumns({"out": out, "reversal": F.coalesce(transform.reversal(F.flatten(F.transform("edited", lambda p: p.edits))), none) if reversible else none})
    original = F.array_join(F.transform("segments", lambda s: s.text), "\n")
    clash = transform.conflicting(F.col("reversal")) | F.exists("reversal", lambda p: F.contains(original, p.placeholder)) if reversible else F.lit(False)
    return df.withColumn("clash", F.coalesce(clash, F.lit(False)))


def _concluded(df: DataFrame, policy: Policy) -> DataFrame:
    """Actions, route, decision, report rows and notices, with faces and tool sources added."""
    mcp, blocked, apply, live_face = F.col("request_kind") == "mcp", F.col("blocked"), F.col("apply"), F.col("has_face") & F.col("error").isNull() & ~F.col("blocked")
    kept = F.filter(F.transform("regions", lambda r: r.action), lambda a: a.isin("pass", "reroute"))
    altered = F.filter(F.transform("changed", lambda e: e.action), lambda a: a != "reroute")
    route = F.when(~blocked & (F.col("scan") | (F.col("early") == "unscanned")) & (F.size("routes") == 1), F.get(F.col("routes"), F.lit(0)))
    df = df.withColumns({"actions": F.when(apply, _set(F.concat(kept, altered))).otherwise(_strings()), "route": route})
    decision = F.when(blocked, "block").when(F.col("route").isNotNull(), "reroute").when(F.exists("actions", lambda a: a != "pass"), "apply_actions").otherwise("pass")
    df = df.withColumn("decision", decision)
    some = F.size("logical") > 0
    notices = (
        F.when(mcp, _strings()).when(F.col("early") == "attachments", F.array(F.lit(ATTACHED))).when(F.col("early") == "safety", F.array(F.col("safety.message")))
        .when(~apply, _strings()).when(F.col("decision") == "reroute", F.array(F.lit(policy.notice_rerouted))).when(some & (F.array_join("actions", ",") == "pass"), F.array(F.lit(PASSED)))
        .when(some, F.array(F.lit(policy.notice_masked))).otherwise(F.array(F.lit(NOTHING)) if policy.show_when_no_pii else _strings())
    )
    # faces
    withheld = live_face & F.lit(policy.faces.action == "text-only")
    lone = live_face & (F.col("decision") == "pass") & ~some
    notices = F.when(lone, _strings()).otherwise(notices)
    notices = F.when(live_face & F.lit(policy.faces.action == "reroute"), F.array(F.lit(policy.notice_rerouted))).when(withheld, F.concat(notices, F.array(F.lit(FACES)))).otherwise(notices)
    general = classified(policy, F.array_join(F.transform("out", lambda s: s.text), "\n"))
    df = df.withColumns({
        "notices": notices, "route": F.when(apply & F.col("route").isNull() & ~mcp, general).otherwise(F.col("route")),
        "decision": F.when(live_face & F.lit(policy.faces.action == "reroute"), "reroute").when(withheld & (F.col("decision") == "pass"), "apply_actions").otherwise(F.col("decision")),
    })
    told = F.array_contains("notices", policy.notice_rerouted)
    face_row = F.struct(F.lit("FACE").alias("entity_type"), F.when(blocked, "block").otherwise(policy.faces.action).alias("action"), F.col("face_count").cast("int").alias("detected_count"), F.lit(0).alias("transformed_count"), F.lit(0).alias("unique_transformed_count"))
    faces = F.when(F.col("has_face") & F.col("error").isNull(), F.array(face_row.cast(ROW))).otherwise(_rows())
    source = F.transform("sources", lambda r: F.struct(r.entity_type.alias("entity_type"), r.action.alias("action"), F.lit(1).alias("detected_count"), F.lit(0).alias("transformed_count"), F.lit(0).alias("unique_transformed_count")).cast(ROW))
    text = F.when(F.col("scan"), _report(policy, mcp, F.col("logical"), F.col("changed")).cast(f"array<{ROW}>")).otherwise(_rows())
    rows = F.array_sort(F.concat(text, faces, F.when(F.col("error").isNull(), source).otherwise(_rows())))
    acted = F.concat("actions", F.when(live_face, F.array(F.lit(policy.faces.action))).otherwise(_strings()), F.transform("sources", lambda r: r.action))
    return df.withColumns({
        "rows": let(rows, lambda r: F.when(blocked, _blocked_rows(r)).otherwise(r)), "actions": F.when(blocked, F.array(F.lit("block"))).otherwise(_set(acted)),
        "notices": F.when((F.col("decision") == "reroute") & ~told, F.concat("notices", F.array(F.lit(policy.notice_rerouted)))).otherwise(F.col("notices")),
    })


def decided(requests: DataFrame, policy: Policy, detector: detect.Detector, keys: transform.Keys, diagnostics: bool = False, columns: tuple[str, ...] | None = None, operators: Mapping[str, transform.Operator] | None = None) -> DataFrame:
    """The result row of every request, or those of its ``columns`` that are named."""
    df = planned(_preflight(requests, policy), policy, detector)
    df = _concluded(_rewritten(_routed(df, policy), policy, keys, operators), policy)
    bad = F.exists("plans", lambda p: p.bad)
    error = (
        F.when(F.col("error").isNotNull(), F.col("error")).when(bad, _breach("invalid_span", F.size(F.filter("plans", lambda p: p.bad)), 0))
        .when(F.col("clash"), _breach("placeholder", F.size("reversal"), 0)).when(F.size("rows") > MAX_ENTITIES, _breach("entities", F.size("rows"), MAX_ENTITIES))
    )
    df = df.withColumn("error", error)
    fine, open_ = F.col("error").isNull(), F.col("error").isNull() & ~F.col("blocked")
    late = F.coalesce(F.col("error.reason").isin("invalid_span", "placeholder", "entities"), F.lit(False))
    some = lambda c, kind: F.when(late, F.array().cast(kind)).otherwise(F.col(c))
    rows = some("rows", f"array<{ROW}>")
    counts = F.transform(rows, lambda r: F.struct(r.entity_type.alias("entity_type"), r.detected_count.alias("count")))
    results = [
        F.col("request_id"), F.when(fine, F.col("decision")).alias("decision"), (fine & F.col("decision").isin("pass", "apply_actions")).alias("remote_allowed"),
        F.when(open_, F.col("out")).alias("segments"), F.transform(rows, lambda r: r.entity_type).alias("entities"), counts.alias("entity_counts"), some("actions", "array<string>").alias("applied_actions"), rows.alias("report_rows"),
        F.col("scan").alias("scan_performed"), F.size(F.filter("regions", lambda r: r.overlap)).alias("overlap_count"), F.when(open_, F.col("route")).alias("route_class"),
        F.when(open_, F.col("reversal")).otherwise(F.array().cast("array<struct<placeholder:string,original:string>>")).alias("reversal"), F.col("safety.name").alias("safety_rule"),
        some("notices", "array<string>").alias("response_notices"), F.size("segments").alias("text_leaf_count"), F.col("error"),
        (F.col("known") | (fine & F.col("held").isNotNull() & ~F.col("blocked"))).alias("from_cache"),
    ]
    names = ["request_id", "decision", "remote_allowed", "segments", "entities", "entity_counts", "applied_actions", "report_rows", "scan_performed", "overlap_count", "route_class", "reversal", "safety_rule", "response_notices", "text_leaf_count", "error", "from_cache"]
    if columns is not None:
        results = [results[names.index(c)] for c in columns]
    if diagnostics:
        results += diagnosed(policy, F.col("plans"))
    # a generator row: filters of callers are not rewritten into the long chain of expressions above
    return df.select(F.inline(F.array(F.struct(*results))))


def digests_nonce(keys: transform.Keys) -> Column:
    """Nonce of a request without a conversation namespace."""
    from ..functions.digests import nonce

    return nonce(keys.nonce_seed, F.col("request_id"))


def diagnosed(policy: Policy, plans: Column, most: int = MAX_DIAGNOSTICS) -> list[Column]:
    """Logical detections and effective regions of all segments, at most ``most`` of each, and whether more were left out."""

    def of_segment(p: Column) -> Column:
        # a region's detections stand one after another in the order of all detections
        acts = F.flatten(F.transform(p.regions, lambda r: F.array_repeat(r.action, r.size)))

        def one(d: Column, i: Column, resolved: Column) -> Column:
            return F.struct(
                p.id.alias("segment_id"), d.start.alias("start"), d.end.alias("end"), d.entity_type.alias("entity_type"), d.score.alias("score"), detect.taxonomy(d.source).alias("source"),
                resolve.action_of(policy, d.entity_type).alias("configured_action"), F.get(resolved, i).alias("resolved_action"),
            )

        return let(acts, lambda resolved: F.transform(p.logical, lambda d, i: one(d, i, resolved)))

    def regions(p: Column) -> Column:
        return F.transform(p.regions, lambda r: F.struct(
            p.id.alias("segment_id"), r.start.alias("start"), r.end.alias("end"), r.entity_type.alias("entity_type"), r.action.alias("action"), detect.taxonomy(r.source).alias("source"),
            r.score.alias("score"), r.members.alias("member_entity_types"), r.overlap.alias("overlap"),
        ))

    logical, effective = F.flatten(F.transform(plans, of_segment)), F.flatten(F.transform(plans, regions))
    more = (F.size(logical) > most) | (F.size(effective) > most)
    return [F.slice(logical, 1, most).alias("logical_detections"), F.slice(effective, 1, most).alias("effective_regions"), more.alias("diagnostics_truncated")]


def simulated(results: DataFrame) -> DataFrame:
    """Echo simulation: the forwarded text with its placeholders restored, and how many of each entity were."""
    text = F.array_join(F.transform("segments", lambda s: s.text), "\n")
    back = F.filter(transform.placeholders(text), lambda p: F.exists("reversal", lambda r: r.placeholder == p))
    kinds = F.transform(back, lambda p: F.regexp_extract(p, r"^<(?:REV|ENCRYPTED)_([A-Z0-9_]+)_[0-9a-f]{16}_[0-9a-f]{16}>$", 1))
    counts = F.transform(_set(kinds), lambda e: F.struct(e.alias("entity_type"), F.size(F.filter(kinds, lambda k: k == e)).alias("restored")))
    status = F.when(F.col("decision") == "block", "skipped").otherwise("complete")
    return results.select("request_id", status.alias("status"), transform.restored(text, F.col("reversal")).alias("text"), F.coalesce(counts, F.array().cast("array<struct<entity_type:string,restored:int>>")).alias("restored"))
