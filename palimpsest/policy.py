"""Policies: validated, immutable configuration that becomes literal maps inside a plan."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any

from . import catalog


class PolicyError(ValueError):
    """A policy that cannot be used; ``stage`` says where it failed (schema, merge or compile)."""

    def __init__(self, message: str, stage: str = "schema", path: tuple[str, ...] = ()) -> None:
        super().__init__(message)
        self.stage, self.path = stage, path


_ROUTE = re.compile(r"^[A-Za-z0-9_.:/-]+$")
_SOURCE = "MCP_TOOL_"


def _need(ok: bool, message: str, *path: str) -> None:
    if not ok:
        raise PolicyError(message, path=path)


def _pattern(value: str, most: int = 4000) -> None:
    _need(0 < len(value) <= most, "a pattern is empty or too long")
    try:
        re.compile(value)
    except re.error as error:
        raise PolicyError(f"invalid pattern: {error}", "compile") from error


@dataclass(frozen=True)
class Mask:
    """Parameters of the actions that change text."""

    masking_char: str = "*"
    chars_to_mask: int = 100
    from_end: bool = True
    new_value: str | None = None


@dataclass(frozen=True)
class EntityPolicy:
    """What to do with one entity type (or one tool source, ``MCP_TOOL_*``)."""

    entity_type: str
    action: str
    patterns: tuple[str, ...] = ()
    route_class: str | None = None
    masking_char: str = "*"
    chars_to_mask: int = 100
    from_end: bool = True
    new_value: str | None = None
    hash_type: str = "sha256"

    def __post_init__(self) -> None:
        _need(self.action in catalog.STRICTNESS, f"unknown action {self.action}", self.entity_type)
        _need(self.route_class is None or self.action == "reroute", "a route needs the action reroute", self.entity_type)
        _need(self.route_class is None or bool(_ROUTE.match(self.route_class)), "invalid route", self.entity_type)
        _need(self.entity_type != "FACE", "FACE is not found in text", self.entity_type)
        _need(len(self.patterns) <= 64, "too many patterns", self.entity_type)
        _need(len(self.masking_char) == 1, "a mask is one character", self.entity_type)
        _need(self.chars_to_mask >= 0, "chars_to_mask is negative", self.entity_type)
        if self.entity_type.startswith(_SOURCE):
            _need(self.action in ("pass", "block", "reroute") and not self.patterns, "a tool source can pass, block or reroute only", self.entity_type)
        for p in self.patterns:
            _pattern(p)


@dataclass(frozen=True)
class CustomRecognizer:
    """A scored pattern of the customer's own."""

    name: str
    entity: str
    regex: str
    score: float
    languages: tuple[str, ...]

    def __post_init__(self) -> None:
        _pattern(self.regex)
        _need(0 < self.score <= 1, "a score is over 0 and at most 1", self.name)
        _need(self.entity != "FACE" and not self.entity.startswith(_SOURCE), "reserved entity", self.name)


@dataclass(frozen=True)
class Faces:
    """Action for faces that a trusted scanner counted."""

    action: str = "block"
    route_class: str | None = None

    def __post_init__(self) -> None:
        _need(self.action in ("block", "text-only", "reroute"), "unknown face action")
        _need(self.route_class is None or self.action == "reroute", "a route needs the action reroute")


@dataclass(frozen=True)
class Policy:
    """Everything that a decision depends on."""

    analyzer_languages: tuple[str, ...] = ("en",)
    supported_languages: tuple[str, ...] = ("en", "de", "nl")
    score_threshold: float = 0.45
    default_action: str = "block"
    default_operator: Mask = Mask()
    analyzer_entities: tuple[str, ...] = ()
    mask_on_reroute: bool = True
    hash_window_hours: int = 24
    entity_policies: tuple[EntityPolicy, ...] = ()
    model_source_policies: Mapping[str, tuple[EntityPolicy, ...]] = field(default_factory=dict)
    custom_recognizers: tuple[CustomRecognizer, ...] = ()
    faces: Faces = Faces()
    safety_enabled: tuple[str, ...] = tuple(name for name, _, _ in catalog.SAFETY)
    safety_custom: tuple[tuple[str, str, str], ...] = ()
    classes: tuple[tuple[str, tuple[str, ...]], ...] = ()
    default_class: str = "general"
    notice_rerouted: str = "Request rerouted because sensitive data was detected."
    notice_masked: str = "Sensitive data was anonymized."
    show_when_no_pii: bool = False
    default_target: str = "local"
    session_ttl_hours: int = 24

    def __post_init__(self) -> None:
        _need(self.default_action in catalog.STRICTNESS, "unknown default action")
        _need(bool(self.analyzer_languages), "no analyzer language")
        for name, values in (("analyzer", self.analyzer_languages), ("supported", self.supported_languages)):
            _need(len(set(values)) == len(values), f"{name} language twice")
        _need(set(self.analyzer_languages) <= set(self.supported_languages), "analyzer language is not supported")
        _need(0 <= self.score_threshold <= 1, "threshold outside 0 to 1")
        _need(1 <= self.hash_window_hours <= 720, "hash window outside 1 to 720 hours")
        for name, values in (("entity policy", [e.entity_type for e in self.entity_policies]), ("custom entity", [c.entity for c in self.custom_recognizers])):
            _need(len(set(values)) == len(values), f"{name} twice")
        known = {*catalog.ENTITIES, *(c.entity for c in self.custom_recognizers)}
        unknown = set(self.analyzer_entities) - known
        _need(not unknown, f"unknown entities: {sorted(unknown)}")
        for rules in self.model_source_policies.values():
            _need(all(e.entity_type.startswith(_SOURCE) for e in rules), "a model rule is for tool sources")
            _need(len({e.entity_type for e in rules}) == len(rules), "model rule twice")
        _need(all(set(c.languages) <= set(self.supported_languages) for c in self.custom_recognizers), "custom recognizer language is not supported")
        builtin = {name for name, _, _ in catalog.SAFETY}
        _need(set(self.safety_enabled) <= builtin, "unknown safety rule")
        for _, pattern, _ in self.safety_custom:
            _pattern(pattern)
        for _, patterns in self.classes:
            for p in patterns:
                _pattern(p)

    @property
    def entities(self) -> tuple[str, ...]:
        """The selected entities: those named, or the catalogue and the customer's own."""
        return self.analyzer_entities or (*catalog.ENTITIES, *(c.entity for c in self.custom_recognizers))

    @property
    def safety_rules(self) -> tuple[tuple[str, str, str], ...]:
        """Enabled built-in rules in the order enabled, then custom ones."""
        built = {r[0]: r for r in catalog.SAFETY}
        return (*(built[n] for n in self.safety_enabled), *self.safety_custom)


def _build(kind: type, value: Any) -> Any:
    """A dataclass from plain data; unknown keys are errors."""
    _need(isinstance(value, Mapping), f"{kind.__name__} needs named fields")
    names = {f.name for f in fields(kind)}
    unknown = set(value) - names
    _need(not unknown, f"unknown fields: {sorted(unknown)}", *sorted(unknown))
    out = dict(value)
    if kind is Policy:
        makers = {"default_operator": Mask, "faces": Faces}
        out |= {k: _build(makers[k], v) for k, v in value.items() if k in makers}
        many = {"entity_policies": EntityPolicy, "custom_recognizers": CustomRecognizer}
        out |= {k: tuple(_build(many[k], x) for x in v) for k, v in value.items() if k in many}
        if "model_source_policies" in value:
            out["model_source_policies"] = {m: tuple(_build(EntityPolicy, x) for x in rules) for m, rules in value["model_source_policies"].items()}
        if "classes" in value:
            out["classes"] = tuple((n, tuple(p)) for n, p in value["classes"])
        if "safety_custom" in value:
            out["safety_custom"] = tuple(tuple(x) for x in value["safety_custom"])
    for k, v in out.items():
        if isinstance(v, list):
            out[k] = tuple(v)
    try:
        return kind(**out)
    except TypeError as error:
        raise PolicyError(str(error)) from error


def from_dict(value: Mapping[str, Any]) -> Policy:
    """A policy from plain (JSON or YAML) data."""
    return _build(Policy, value)


def to_dict(policy: Policy) -> dict[str, Any]:
    """Plain data of a policy; ``from_dict`` restores it."""
    from dataclasses import asdict

    return json.loads(json.dumps(asdict(policy)))


def load(path: str) -> Policy:
    """A policy from a JSON file, or a YAML file where the yaml module is there."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        return from_dict(yaml.safe_load(text))
    return from_dict(json.loads(text))


def overridden(base: Policy, update: Mapping[str, Any]) -> Policy:
    """A policy with ``update`` merged in: nested fields are merged, lists and ``model_source_policies`` replaced."""
    unknown = set(update) - {f.name for f in fields(Policy)}
    _need(not unknown, f"unknown fields: {sorted(unknown)}", *sorted(unknown))
    merged = to_dict(base)
    for key, value in update.items():
        old = merged.get(key)
        nested = isinstance(old, dict) and isinstance(value, Mapping) and key != "model_source_policies"
        merged[key] = {**old, **value} if nested else value
    try:
        return from_dict(merged)
    except PolicyError as error:
        raise PolicyError(str(error), "merge" if error.stage == "schema" else error.stage, error.path) from error


def default() -> Policy:
    """The self-contained policy that examples and tests use."""
    return Policy(
        supported_languages=("en",), default_action="pass", show_when_no_pii=True,
        entity_policies=(
            EntityPolicy("EMAIL_ADDRESS", "mask"), EntityPolicy("PHONE_NUMBER", "mask"),
            EntityPolicy("IBAN", "reroute", route_class="local"), EntityPolicy("PASSWORD_OR_SECRET", "block"),
        ),
    )


__all__ = ["CustomRecognizer", "EntityPolicy", "Faces", "Mask", "Policy", "PolicyError", "default", "from_dict", "load", "overridden", "replace", "to_dict"]
