"""Sticky sessions on streams: a keyed state with expiry per session, and receipts.

The state's clock starts at its last write, so a live decision is written again whenever it is read (sliding
expiry); receipts are not touched on a read (fixed expiry).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DECISION = T.StructType([T.StructField("decision", T.StringType()), T.StructField("route", T.StringType()), T.StructField("kind", T.StringType())])
OUTPUT = "session_key string, seq long, final_decision string, final_route string, from_cache boolean, session_error string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def step(state: tuple[str, str | None] | None, decision: str, route: str | None) -> tuple[tuple[str, str | None] | None, str, str | None, bool]:
    """The session's next state, and the final decision and route of one request, and whether the state alone gave it."""
    if state and state[0] == "block":
        return state, "block", None, True
    own = route if decision == "reroute" else None
    cached = state[1] if state else None
    if decision == "block" or (own and cached and own != cached):
        return ("block", None), "block", None, False
    if own or cached:
        return ("reroute", cached or own), "reroute", cached or own, False
    return None, decision, route, False


class Taint(StatefulProcessor):
    """Keeps the decision that holds for a session; requests of a batch are taken in the order of ``seq``."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("decision", DECISION, self.ttl_ms) if self.ttl_ms else handle.getValueState("decision", DECISION)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        state = (held[0], held[1]) if held else None
        kind = held[2] if held else None
        for r in sorted(rows, key=lambda r: r.seq):
            if kind is not None and r.request_kind != kind:  # an error of this request; the session stays as it was
                yield Row(session_key=key[0], seq=r.seq, final_decision=None, final_route=None, from_cache=False, session_error="request_kind")
                continue
            state, decision, route, cached = step(state, r.decision, r.route_class)
            kind = r.request_kind if state else kind
            yield Row(session_key=key[0], seq=r.seq, final_decision=decision, final_route=route, from_cache=cached, session_error=None)
        if state:
            self.state.update((state[0], state[1], kind))

    def close(self) -> None:
        pass


def sticky_stream(results: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Final decisions of a stream of (session_key, seq, request_kind, decision, route_class)."""
    return results.groupBy("session_key").transformWithState(statefulProcessor=Taint(ttl_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


class Receipts(StatefulProcessor):
    """Records digests of a scope (op ``put``) and answers whether they were recorded (op ``check``)."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        key, value = T.StructType([T.StructField("digest", T.StringType())]), T.StructType([T.StructField("seen", T.BooleanType())])
        self.known = handle.getMapState("receipts", key, value, self.ttl_ms) if self.ttl_ms else handle.getMapState("receipts", key, value)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        for r in sorted(rows, key=lambda r: r.seq):
            if r.op == "put":
                for d in r.digests:
                    if not self.known.containsKey((d,)):
                        self.known.updateValue((d,), (True,))
            else:
                yield Row(scope=key[0], seq=r.seq, verified=all(self.known.containsKey((d,)) for d in r.digests))

    def close(self) -> None:
        pass


def receipts_stream(calls: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Answers to a stream of (scope, seq, op, digests)."""
    return calls.groupBy("scope").transformWithState(statefulProcessor=Receipts(ttl_ms), outputStructType="scope string, seq long, verified boolean", outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")
