"""The engine: lazy analyses of request rows under a policy."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog, policy as policies
from ..functions import digests
from ..operators import decide, detect, session, transform
from ..policy import Policy, PolicyError
from ..sources import provider_json, requests as sources


def issues(error: PolicyError, most: int = 128) -> list[dict[str, str]]:
    """What is wrong with a candidate policy: one entry per named field (at most ``most``), paths of at most 16 parts, codes and parts in a safe alphabet."""
    paths = [(p,) for p in error.path] or [()]
    safe = lambda part: re.sub(r"[^A-Za-z0-9_.-]", "_", str(part))[:64]
    return [{"stage": safe(error.stage), "path": "/".join(safe(x) for x in path[:16]), "message": str(error)[:500]} for path in paths[:most]]


@dataclass(frozen=True)
class Engine:
    """Analyses under one policy, one detector and one set of keys."""

    policy: Policy = field(default_factory=policies.default)
    detector: detect.Detector | None = None
    keys: transform.Keys = transform.Keys(b"example-key-of-an-example-engine")
    policy_version: str = "v1"
    #: Actions of the caller's own, in place of built-in ones.
    operators: Mapping[str, transform.Operator] | None = None

    def _detector(self, policy: Policy) -> detect.Detector:
        base = self.detector or detect.deterministic()
        return detect.layered(base, detect.policy_patterns(policy))

    def analyze(self, requests: DataFrame, diagnostics: bool = False, columns: tuple[str, ...] | None = None) -> DataFrame:
        """Result rows of requests (any columns of ``sources.requests.REQUEST``); with ``columns`` only those are computed."""
        return decide.decided(self._named(sources.requests(requests)), self.policy, self._detector(self.policy), self.keys, diagnostics, columns, self.operators)

    def analyze_sessions(self, requests: DataFrame, decisions: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
        """Result rows of requests whose sessions may have a decision (``session_key``, ``decision``, ``route_class``; one row a session): those of blocked sessions are never scanned."""
        held = decisions.where(F.col("decision").isin("block", "reroute")).select("session_key", F.col("decision").alias("cached_decision"), F.col("route_class").alias("cached_route"))
        rows = sources.requests(requests).drop("cached_decision", "cached_route").join(held, "session_key", "left")
        return self.analyze(rows, columns=columns)

    def _named(self, requests: DataFrame) -> DataFrame:
        """Chat requests of a session share placeholders over their turns."""
        stable = (F.col("request_kind") == "chat") & (F.col("scope") == "session") & F.col("session_key").isNotNull()
        own = digests.namespace(self.keys.hash_key, F.col("session_key"), self.policy_version)
        return requests.withColumn("placeholder_namespace", F.coalesce("placeholder_namespace", F.when(stable, own)))

    def analyze_documents(self, docs: DataFrame, key: str = "doc_id", text: str = "text", columns: tuple[str, ...] | None = None) -> DataFrame:
        """Result rows of documents: request scope, fresh placeholders."""
        return self.analyze(sources.documents(docs, key, text), columns=columns)

    def analyze_json(self, bodies: DataFrame) -> DataFrame:
        """Result rows of provider requests (request_id, body), with the rewritten ``body`` and bounded ``paths``."""
        leaves = provider_json.extracted(bodies)
        results = self.analyze(leaves.where("problem IS NULL"))
        return provider_json.rebuilt(bodies, leaves, results)

    def preview(self, requests: DataFrame, update: Mapping[str, Any] | None = None) -> DataFrame:
        """Results under an overridden policy, without the reversal map."""
        policy = policies.overridden(self.policy, update or {})
        return Engine(policy, self.detector, self.keys, self.policy_version, self.operators).analyze(requests).drop("reversal")

    def evaluate(self, requests: DataFrame, candidate: Mapping[str, Any]) -> tuple[DataFrame | None, DataFrame | None, list[dict[str, str]]]:
        """What a candidate policy would do: results with diagnostics, echo simulation, and issues. An invalid candidate is a result, not an error."""
        try:
            policy = policies.overridden(self.policy, candidate)
        except PolicyError as error:
            return None, None, issues(error)
        results = Engine(policy, self.detector, self.keys, self.policy_version, self.operators).analyze(requests, diagnostics=True)
        return results.drop("reversal"), decide.simulated(results), []

    def sticky(self, results: DataFrame, order: str = "turn") -> DataFrame:
        """Decisions with those of earlier requests of the session applied (``session_key``, ``decision``, ``route_class``, order)."""
        return session.sticky(results, order=order, ttl_seconds=None)

    @staticmethod
    def actions(spark: SparkSession) -> DataFrame:
        """The action registry."""
        rows = [(a.name, a.decision, a.reversible, a.severity, a.strictness, list(a.params), a.notes) for a in catalog.ACTIONS]
        return spark.createDataFrame(rows, "name string, decision string, reversible boolean, severity string, strictness int, params array<string>, notes string")

    def catalog(self, spark: SparkSession) -> DataFrame:
        """Entities that text detection can report, with their configured action and strictness."""
        names = list(dict.fromkeys([*catalog.ENTITIES, *(c.entity for c in self.policy.custom_recognizers)]))
        table = {e.entity_type: e.action for e in self.policy.entity_policies}
        rows = [(n, table.get(n, self.policy.default_action), catalog.STRICTNESS[table.get(n, self.policy.default_action)]) for n in names]
        return spark.createDataFrame(rows, "entity_type string, action string, strictness int")

    def describe(self) -> str:
        """The policy as JSON."""
        return json.dumps(policies.to_dict(self.policy))
