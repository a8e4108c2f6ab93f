"""Whole session decisions on streams: the decision that holds, its counts, its report rows, with sliding expiry.

A session's state is composite: one value (kind, decision, route, overlaps), a map of counts by entity and a map of report rows by entity. A
request of a session that was rerouted adds to both maps, and only the entries that changed are written; what is read is checked
before it is used, as a decision that does not hold together must not let a request pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Entities that a result may have.
MOST_ENTITIES = 64
INPUT = (
    "session_key string, seq long, request_kind string, decision string, route_class string, overlap_count long, entity_counts array<struct<entity_type:string,count:long>>, "
    "report_rows array<struct<entity_type:string,action:string,detected_count:long,transformed_count:long>>"
)
OUTPUT = (
    "session_key string, seq long, final_decision string, final_route string, from_cache boolean, session_error string, overlap_count long, entity_counts array<struct<entity_type:string,count:long>>, "
    "report_rows array<struct<entity_type:string,action:string,detected_count:long,transformed_count:long>>"
)
_HEAD = T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "decision", "route")] + [T.StructField("overlaps", T.LongType())])
_ENTITY = T.StructType([T.StructField("entity_type", T.StringType())])
_COUNT = T.StructType([T.StructField("count", T.LongType())])
_ROW = T.StructType([T.StructField("action", T.StringType()), T.StructField("detected", T.LongType()), T.StructField("transformed", T.LongType())])

Rows = dict[str, tuple[str, int, int]]


@dataclass
class Held:
    """What a session is known by: ``rows`` are (action, detected, transformed) by entity."""

    kind: str
    decision: str
    route: str | None
    overlaps: int
    counts: dict[str, int] = field(default_factory=dict)
    rows: Rows = field(default_factory=dict)


#: What makes a held decision unsound, by name.
UNSOUND: dict[str, Callable[[Held], bool]] = {
    "block_transforms": lambda h: h.decision == "block" and any(t for _, _, t in h.rows.values()),
    "block_without_row": lambda h: h.decision == "block" and bool(h.rows) and all(a != "block" for a, _, _ in h.rows.values()),
    "decision": lambda h: h.decision not in ("block", "reroute"),
    "face": lambda h: "FACE" in h.counts,
    "mcp": lambda h: h.kind == "mcp" and (h.decision != "block" or any(a == "reroute" for a, _, _ in h.rows.values())),
    "no_route": lambda h: h.decision == "reroute" and h.route is None,
    "reroute_rows": lambda h: h.decision == "reroute" and ("reroute" not in {a for a, _, _ in h.rows.values()} or "block" in {a for a, _, _ in h.rows.values()}),
    "route_of_block": lambda h: h.decision == "block" and h.route is not None,
    "rows_exceed_counts": lambda h: any(d > h.counts.get(e, -1) for e, (_, d, _) in h.rows.items()),
}


def unsound(held: Held) -> str | None:
    """The first reason, by name, why a held decision cannot be used."""
    return next((name for name, wrong in UNSOUND.items() if wrong(held)), None)


def _blocked(rows: Rows) -> Rows:
    """Nothing of a blocked result was transformed, and some row says block."""
    says = any(a == "block" for a, _, _ in rows.values())
    return {e: (a if says else "block", d, 0) for e, (a, d, _) in rows.items()}


@dataclass
class Answer:
    """The effective result of one request."""

    decision: str | None
    route: str | None
    from_cache: bool = False
    error: str | None = None
    overlaps: int = 0
    counts: dict[str, int] = field(default_factory=dict)
    rows: Rows = field(default_factory=dict)


def follow(held: Held | None, kind: str, decision: str, route: str | None, overlaps: int, counts: dict[str, int], rows: Rows) -> tuple[Held | None, Answer]:
    """What a session holds after a request, and the request's answer; an error leaves the session as it was."""
    if held and held.kind != kind:
        return held, Answer(None, None, error="request_kind")
    if held and held.decision == "block":
        return held, Answer("block", None, True, None, held.overlaps, held.counts, held.rows)
    kept = rows
    if held and decision != "block":
        conflict = decision == "reroute" and route != held.route
        counts = {e: max(counts.get(e, 0), held.counts.get(e, 0)) for e in {*counts, *held.counts}}
        overlaps = max(overlaps, held.overlaps)
        fresh = rows if conflict else {e: r for e, r in rows.items() if r[0] == "reroute"}
        kept = held.rows | fresh
        decision, route = ("block", None) if conflict else ("reroute", held.route)
        rows = kept if conflict else rows
    if len(counts) > MOST_ENTITIES:
        return held, Answer(None, None, error="entity_bound")
    if decision == "block":
        route, rows, kept = None, _blocked(rows), _blocked(kept)
    answer = Answer(decision, route, False, None, overlaps, counts, rows)
    if decision not in ("block", "reroute"):
        return held, answer
    return Held(kind, decision, route, overlaps, counts, kept), answer


def _items(values: Any) -> Any:
    return [] if values is None else values


class Session(StatefulProcessor):
    """Keeps a session's whole decision; requests of a batch are taken in the order of ``seq``."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = [self.ttl_ms] if self.ttl_ms else []
        self.head = handle.getValueState("head", _HEAD, *ttl)
        self.counts = handle.getMapState("counts", _ENTITY, _COUNT, *ttl)
        self.rows = handle.getMapState("rows", _ENTITY, _ROW, *ttl)

    def _read(self) -> Held | None:
        if not self.head.exists():
            return None
        kind, decision, route, overlaps = self.head.get()
        counts = {k[0]: v[0] for k, v in self.counts.iterator()} if self.counts.exists() else {}
        rows = {k[0]: tuple(v) for k, v in self.rows.iterator()} if self.rows.exists() else {}
        return Held(kind, decision, route, overlaps, counts, rows)

    def _write(self, before: Held | None, now: Held) -> None:
        # with expiry every entry is written again, as its clock starts with its last write; else only those that changed
        self.head.update((now.kind, now.decision, now.route, now.overlaps))
        for state, old, new in ((self.counts, before.counts if before else {}, {e: (n,) for e, n in now.counts.items()}), (self.rows, before.rows if before else {}, now.rows)):
            for entity in old.keys() - new.keys():
                state.removeKey((entity,))
            for entity, value in new.items():
                if self.ttl_ms or old.get(entity) != (value[0] if state is self.counts else value):
                    state.updateValue((entity,), value)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        before = self._read()
        wrong = unsound(before) if before else None
        held = before
        for r in sorted(rows, key=lambda r: r.seq):
            if wrong:
                a = Answer(None, None, error=f"session_state:{wrong}")
            else:
                own = {x["entity_type"]: (x["action"], x["detected_count"], x["transformed_count"]) for x in _items(r.report_rows)}
                held, a = follow(held, r.request_kind, r.decision, r.route_class, r.overlap_count or 0, {x["entity_type"]: x["count"] for x in _items(r.entity_counts)}, own)
            counts = [dict(entity_type=e, count=n) for e, n in sorted(a.counts.items())]
            report = [dict(entity_type=e, action=x, detected_count=d, transformed_count=t) for e, (x, d, t) in sorted(a.rows.items())]
            yield Row(session_key=key[0], seq=r.seq, final_decision=a.decision, final_route=a.route, from_cache=a.from_cache, session_error=a.error, overlap_count=a.overlaps, entity_counts=counts, report_rows=report)
        if held and not wrong:
            self._write(before, held)

    def close(self) -> None:
        pass


def session_stream(results: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Effective results of a stream of ``INPUT`` rows."""
    return results.groupBy("session_key").transformWithState(statefulProcessor=Session(ttl_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")
