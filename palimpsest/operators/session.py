"""Sticky session decisions over a table of requests, and receipts.

A block makes every later request of the session a block without a scan; a reroute sends later ones to the same
route; a second route is a conflict and blocks. Expiry slides: a gap longer than the time to live
starts afresh. All of it is windows over (session, order), partitioned by session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def episodes(df: DataFrame, key: str, time: str, ttl_seconds: int) -> Column:
    """Number of the stretch, within a session, without a gap of more than ``ttl_seconds``."""
    w = Window.partitionBy(key).orderBy(time)
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))
    return F.sum(F.when(gap > ttl_seconds * 1_000_000, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def sticky(df: DataFrame, key: str = "session_key", order: str = "turn", time: str | None = None, ttl_seconds: int | None = None) -> DataFrame:
    """``df`` with ``final_decision``, ``final_route`` and ``from_cache``; needs ``decision`` and ``route_class``.

    With a ``request_kind`` column also ``session_error``: a session that has a decision takes requests of that decision's kind only;
    another one gets the error, no decision, and leaves the session as it was.
    """
    keys = [key]
    if ttl_seconds is not None:
        df = df.withColumn("episode", episodes(df, key, time or order, ttl_seconds))
        keys.append("episode")
    past = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    kinds = "request_kind" in df.columns
    taints = F.col("decision").isin("block", "reroute")
    bad = F.coalesce(F.col("request_kind") != F.first(F.when(taints, F.col("request_kind")), ignorenulls=True).over(past), F.lit(False)) if kinds else F.lit(False)
    df = df.withColumn("__bad", bad)
    df = df.withColumn("__own", F.when((F.col("decision") == "reroute") & ~F.col("__bad"), F.col("route_class")))
    df = df.withColumn("__route", F.first("__own", ignorenulls=True).over(past))
    df = df.withColumn("__stop", ~F.col("__bad") & (F.coalesce(F.col("decision") == "block", F.lit(False)) | F.coalesce(F.col("__own") != F.col("__route"), F.lit(False))))
    df = df.withColumn("from_cache", ~F.col("__bad") & F.coalesce(F.max("__stop").over(past), F.lit(False)))
    final = F.when(F.col("__bad"), None).when(F.col("from_cache") | F.col("__stop"), "block").when(F.coalesce("__route", "__own").isNotNull(), "reroute").otherwise(F.col("decision"))
    df = df.withColumn("final_decision", final)
    route = F.when(F.col("final_decision") == "reroute", F.coalesce("__route", "__own")).when(F.col("__bad") | (F.col("final_decision") == "block"), None).otherwise(F.col("route_class"))
    df = df.withColumn("final_route", route)
    if kinds:
        df = df.withColumn("session_error", F.when(F.col("__bad"), "request_kind"))
    return df.drop("__own", "__route", "__stop", "__bad")


def _doubts(d: Column) -> dict[str, Column]:
    """What makes a stored decision unsound, by name."""
    names, counted = F.transform(d.report_rows, lambda r: r.entity_type), F.transform(d.entity_counts, lambda c: c.entity_type)
    acts = F.transform(d.report_rows, lambda r: r.action)
    says = lambda action: F.coalesce(F.array_contains(acts, action), F.lit(False))
    known = F.map_from_entries(F.transform(d.entity_counts, lambda c: F.struct(c.entity_type, c["count"])))
    block, reroute, routed = d.decision == "block", d.decision == "reroute", d.route_class.isNotNull()
    once = lambda x: F.size(x) == F.size(F.array_distinct(x))
    return {
        "block_transforms": block & F.exists(d.report_rows, lambda r: r.transformed_count > 0),
        "block_without_row": block & (F.size(acts) > 0) & ~says("block"),
        "decision": ~F.coalesce(block | reroute, F.lit(False)),
        "entities": ~once(d.entities) | (F.array_sort(d.entities) != F.array_sort(counted)),
        "face": F.array_contains(counted, "FACE"),
        "mcp": (d.request_kind == "mcp") & (~block | routed | says("reroute") | (F.size(d.response_notices) > 0)),
        "no_route": reroute & ~routed,
        "remote_allowed": d.remote_allowed,
        "request_notices": F.size(d.request_notices) > 0,
        "reroute_rows": reroute & (says("block") | ~says("reroute")),
        "route_of_block": block & routed,
        "rows_exceed_counts": F.exists(d.report_rows, lambda r: r.detected_count > F.coalesce(F.element_at(known, r.entity_type), F.lit(-1))),
        "rows_order": F.array_sort(names) != names,
        "rows_repeat": ~once(names),
    }


def unsound(d: Column) -> Column:
    """Why a stored session decision cannot be trusted (the first reason, by name), or null.

    ``d`` has request_kind, decision, route_class, remote_allowed, entities, entity_counts (rows of entity_type and count), report_rows,
    request_notices and response_notices. Routing must be closed, counts must agree, and rows must fit the decision.
    """
    return F.coalesce(*[F.when(wrong, F.lit(name)) for name, wrong in sorted(_doubts(d).items())])


def held(results: DataFrame, key: str = "session_key", order: str = "seq") -> DataFrame:
    """Session, decision, route, kind, overlaps, counts and rows that every session holds after its last request; sessions without a decision have no row.

    ``results`` has request_kind, decision, route_class, overlap_count, entity_counts and report_rows of each request. Counts and overlaps are
    the largest since the session was rerouted; rows are those of the first such request, overlaid with later reroute rows; a second
    route overlays all of its rows and blocks; a request that is blocked by itself brings its own.
    """
    told = sticky(results, key, order)
    writes = F.col("session_error").isNull() & F.col("final_decision").isin("block", "reroute") & ~F.col("from_cache")
    live = told.where(writes).withColumn("__conflict", (F.col("final_decision") == "block") & (F.col("decision") != "block"))
    live = live.withColumn("__alone", (F.col("decision") == "block"))
    by = Window.partitionBy(key)
    live = live.withColumn("__first", F.min(order).over(by)).withColumn("__last", F.max(order).over(by)).withColumn("__ends", F.max("__alone").over(by))
    # a request that is blocked by itself is the last to write, and what stood before it is dropped
    live = live.where(~F.col("__ends") | F.col("__alone"))
    last = F.col(order) == F.col("__last")
    head = live.groupBy(key).agg(
        F.max(F.when(last, F.col("final_decision"))).alias("decision"), F.max(F.when(last, F.col("final_route"))).alias("route"), F.max(F.when(last, F.col("request_kind"))).alias("kind"),
        F.max(F.coalesce("overlap_count", F.lit(0))).alias("overlaps"),
    )
    counts = live.select(key, F.explode("entity_counts").alias("c")).groupBy(key, "c.entity_type").agg(F.max("c.count").alias("count"))
    counts = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("entity_type", "count"))).alias("entity_counts"))
    each = live.select(key, order, (F.col(order) == F.col("__first")) | F.col("__alone") | F.col("__conflict"), F.explode("report_rows").alias("r")).toDF(key, order, "all", "r")
    rows = each.where(F.col("all") | (F.col("r.action") == "reroute")).groupBy(key, F.col("r.entity_type").alias("entity")).agg(F.max_by("r", order).alias("r"))
    rows = rows.groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("report_rows"))
    out = head.join(counts, key, "left").join(rows, key, "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    kinds = dict(out.dtypes)
    report = empty(F.col("report_rows"), kinds["report_rows"])
    says = F.exists(report, lambda r: r.action == "block")
    shown = F.transform(report, lambda r: r.withField("action", F.when(says, r.action).otherwise("block")).withField("transformed_count", F.lit(0).cast("long")))
    return out.select(key, "decision", "route", "kind", "overlaps", empty(F.col("entity_counts"), kinds["entity_counts"]).alias("entity_counts"), F.when(F.col("decision") == "block", shown).otherwise(report).alias("report_rows"))


def merged_counts(now: Column, cached: Column) -> Column:
    """Entity counts (maps) of a request and of its session: the larger of each."""
    return F.map_zip_with(now, cached, lambda _, a, b: F.greatest(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))))


def merged_entities(now: Column, cached: Column) -> Column:
    """Entities of a request and of its session, sorted."""
    return F.array_sort(F.array_union(now, cached))


def overlaid_rows(cached: Column, now: Column) -> Column:
    """Report rows that a session keeps: those it has, overlaid with the request's reroute rows, by entity."""
    fresh = F.filter(now, lambda r: r.action == "reroute")
    old = F.filter(cached, lambda r: ~F.exists(fresh, lambda x: x.entity_type == r.entity_type))
    return F.array_sort(F.concat(old, fresh))


def recorded(receipts: DataFrame) -> DataFrame:
    """Receipts as a set of (scope, digest); both are 64 lower-case hex digits, others are dropped into no set but fail."""
    ok = F.col("scope").rlike("^[0-9a-f]{64}$") & F.col("digest").rlike("^[0-9a-f]{64}$")
    checked = receipts.withColumn("digest", F.when(ok, F.col("digest")).otherwise(F.raise_error(F.lit("a receipt is not a SHA-256 pair"))))
    return checked.select("scope", "digest").distinct()


def verified(claims: DataFrame, receipts: DataFrame) -> DataFrame:
    """For each claim id (claim_id, scope, digest rows), whether every digest was recorded for its scope."""
    known = receipts.select("scope", "digest", F.lit(True).alias("known"))
    joined = claims.join(known, ["scope", "digest"], "left")
    return joined.groupBy("claim_id").agg(F.every(F.coalesce("known", F.lit(False))).alias("verified"))
