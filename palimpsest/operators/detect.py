"""Detectors: each is a function from a text column to a span array, so layers compose without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import catalog
from ..functions import context, identifiers, spans
from ..functions.checks import CHECKS
from ..functions.literals import mapping
from ..functions.prefilter import possible
from ..policy import Policy
from .windows import adaptive

Detector = Callable[[Column], Column]


def deterministic(entities: tuple[str, ...] | None = None) -> Detector:
    """The plain patterns of the catalogue, score 1; ``entities`` limits them before the plan is built."""
    chosen = [(e, p) for e, p in catalog.DETERMINISTIC if entities is None or e in entities]
    return lambda text: spans.ordered(spans.union([spans.pattern_spans(text, e, p, 1.0, "deterministic") for e, p in chosen]))


def policy_patterns(policy: Policy) -> Detector:
    """Patterns that the policy gives to entities; score 0.95, neither thresholded nor selected."""
    chosen = [(e.entity_type, p) for e in policy.entity_policies for p in e.patterns]
    return lambda text: spans.union([spans.pattern_spans(text, e, p, 0.95, "policy-regex") for e, p in chosen])


def _hits(text: Column, rule: catalog.Rule) -> Column:
    hits = spans.found(text, rule.pattern)
    return F.filter(hits, lambda m: CHECKS[rule.check](m.value)) if rule.check else hits


def _scored(hits: Column, contents: Column, rule: catalog.Rule, languages: tuple[str, ...]) -> Column:
    def one(m: Column) -> Column:
        near = context.supports(contents, m.start, rule.entity, languages, rule.context)
        return spans.span(rule.entity, m.start, m.end, F.when(near, context.boosted(rule.score)).otherwise(F.lit(rule.score)), "deterministic")

    return F.transform(hits, one)


def country_rules(countries: tuple[str, ...]) -> list[catalog.Rule]:
    """Rules for the national numbers of some countries, each with its check characters."""
    if unknown := set(countries) - set(identifiers.COUNTRIES):
        raise ValueError(f"no numbers of {sorted(unknown)}; known: {', '.join(identifiers.COUNTRIES)}")
    return [catalog.Rule(x.entity, x.pattern, x.score, name, x.context) for name, x in identifiers.IDENTIFIERS.items() if x.country in countries]


def scored_rules(policy: Policy, countries: tuple[str, ...] = ()) -> Detector:
    """Scored rules with checks and context, the national numbers of ``countries``, and the policy's custom recognizers.

    Only selected entities are looked for, an invalid value scores nothing, context can raise a
    built-in rule's score, and what stays under the threshold is dropped.
    """
    selected, languages = set(policy.entities), policy.analyzer_languages
    rules = [r for r in (*catalog.RULES, *country_rules(countries)) if r.entity in selected]
    custom = [c for c in policy.custom_recognizers if c.entity in selected and set(c.languages) & set(languages)]

    def scored(text: Column, hits: Column) -> Column:
        # words are looked for only in texts where a rule has found something that they can support
        supported = reduce(lambda a, b: a | b, [F.size(hits[f"r{i}"]) > 0 for i, r in enumerate(rules) if context.has_phrases(r.entity, languages, r.context)], F.lit(False))
        contents = F.when(supported, spans.let(context.words(text), lambda index: context.contents(index, languages)))
        return spans.let(contents, lambda c: spans.union([_scored(hits[f"r{i}"], c, r, languages) for i, r in enumerate(rules)]))

    def run(text: Column) -> Column:
        hits = F.struct(*[_hits(text, r).alias(f"r{i}") for i, r in enumerate(rules)]) if rules else None
        built = spans.let(hits, lambda h: scored(text, h)) if rules else spans.no_spans()
        own = [spans.pattern_spans(text, c.entity, c.regex, c.score, "deterministic") for c in custom]
        return spans.best(F.filter(spans.union([built, *own]), lambda s: (s.score > 0) & (s.score >= policy.score_threshold)))

    return run


def layered(*detectors: Detector) -> Detector:
    """Spans of all layers."""
    return lambda text: spans.union([d(text) for d in detectors])


def normalized_labels(spans_: Column, labels: dict[str, str] = catalog.LABELS, ignored: tuple[str, ...] = ()) -> Column:
    """Labels of another recognizer as catalogue entities; ignored labels are dropped."""
    table = mapping(labels)
    kept = F.filter(spans_, lambda s: ~s.entity_type.isin(*ignored)) if ignored else spans_
    return F.transform(kept, lambda s: s.withField("entity_type", F.coalesce(F.element_at(table, s.entity_type), s.entity_type)))


def taxonomy(source: Column) -> Column:
    """Detector names collapsed to the four public ones."""
    return F.when(source == "policy-regex", "policy_regex").when(source.isin("spacy", "transformer"), source).otherwise("deterministic")


def provenance(name: Column) -> Column:
    """Public source of a recognizer's class name."""
    return F.when(name.contains("Transformer") | name.contains("GLiNER"), "transformer").when(name.contains("Spacy"), "spacy").otherwise("deterministic")


@dataclass(frozen=True)
class SpanModel:
    """A model plug-in: ``find(texts) -> list of spans per text``, spans as (entity, start, end, score, source)."""

    name: str
    find: Callable[[list[str]], list[list[tuple[str, int, int, float, str]]]]


def above(spans_: Column, threshold: float) -> Column:
    """Spans of at least a score."""
    return F.filter(spans_, lambda s: s.score >= threshold)


def with_model(segments: DataFrame, model: SpanModel, text: str = "text", into: str = "spans", threshold: float = 0.0, entities: tuple[str, ...] | None = None, errors: str | None = None) -> DataFrame:
    """``segments`` with a model's spans of at least ``threshold``, in Arrow batches.

    Malformed evidence (place, score, type, or an entity outside ``entities``) and a model that fails are never dropped: they end the query, or, with a
    column named by ``errors``, become an error value of their row, which then has no spans. A batch that fails as a whole is asked text by text.
    """
    added = {into, errors} - {None}
    fields = [f for f in segments.schema.fields if f.name not in added]
    schema = T.StructType([*fields, T.StructField(into, T._parse_datatype_string(f"array<{spans.SPAN}>")), *([T.StructField(errors, T.StringType())] if errors else [])])
    names = [f.name for f in fields]

    def checked(t: str, hit: tuple) -> dict:
        entity, start, end, score, source = hit
        ok = isinstance(entity, str) and (entities is None or entity in entities) and type(start) is int and type(end) is int and isinstance(score, (int, float)) and not isinstance(score, bool)
        if not ok or not (0 <= start < end <= len(t) and 0 <= score <= 1):
            raise ValueError(f"{model.name} returned an invalid span")
        return {"entity_type": entity, "start": start, "end": end, "score": float(score), "source": source}

    def asked(texts: list[str]) -> list[list[dict]]:
        found = model.find(texts)
        if len(found) != len(texts):
            raise ValueError(f"{model.name} answered for {len(found)} of {len(texts)} texts")
        return [[x for x in (checked(t, h) for h in hits) if x["score"] >= threshold] for t, hits in zip(texts, found, strict=True)]

    def each(texts: list[str]) -> tuple[list[list[dict] | None], list[str | None]]:
        """Spans and errors, one text at a time."""
        rows, failed = [], []
        for t in texts:
            try:
                rows += asked([t])
                failed.append(None)
            except Exception as e:  # the plug-in's own; its message may hold text, so only its kind is told
                rows.append(None)
                failed.append("invalid_evidence" if isinstance(e, (TypeError, ValueError)) else "model_failed")
        return rows, failed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("source", pa.string())]))
        for b in batches:
            texts = [t or "" for t in b.column(names.index(text)).to_pylist()]
            failed: list[str | None] = [None] * len(texts)
            try:
                rows = asked(texts)
            except Exception:
                if errors is None:
                    raise
                rows, failed = each(texts)
            told = [pa.array(failed, pa.string())] if errors else []
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names))], pa.array(rows, kind), *told], names=schema.names)

    return segments.select(*names).mapInArrow(run, schema)


def remote(name: str, call: Callable[[str], list[tuple[str, int, int, float]]], labels: dict[str, str], ignored: tuple[str, ...] = (), too_large: type[Exception] = ValueError, size: int = 1024, overlap: int = 128, max_calls: int = 1000) -> SpanModel:
    """A model behind a call, as a plug-in: texts go out in overlapping windows, a window that is too large is halved, labels become entities, ignored ones go.

    A label that is neither mapped nor ignored fails: evidence is not dropped silently.
    """

    def one(window: str) -> list[tuple[str, int, int, float, str]]:
        out = []
        for label, start, end, score in call(window):
            if label in ignored:
                continue
            if label not in labels:
                raise RuntimeError(f"{name} answered with an unknown label")
            out.append((labels[label], start, end, score, "transformer"))
        return out

    return SpanModel(name, lambda texts: adaptive(texts, one, too_large, size, overlap, max_calls))


def create(mode: str, policy: Policy) -> Detector:
    """The detector of a mode: ``deterministic`` (plain patterns), ``rules`` (scored rules with context), ``combined`` (both), each with the policy's own patterns."""
    layers = {"deterministic": (deterministic(),), "rules": (scored_rules(policy),), "combined": (deterministic(), scored_rules(policy))}
    if mode not in layers:
        raise ValueError(f"unknown mode {mode}; one of {sorted(layers)}")
    return layered(*layers[mode], policy_patterns(policy))


def python_pattern_spans(segments: DataFrame, patterns: list[tuple[str, str, float]], text: str = "text", into: str = "spans") -> DataFrame:
    """Spans of patterns in Python's own syntax, for those that Java does not read the same way."""
    import re

    compiled = [(e, re.compile(p), s) for e, p, s in patterns]

    def find(texts: list[str]) -> list[list[tuple[str, int, int, float, str]]]:
        return [[(e, m.start(), m.end(), s, "policy-regex") for e, p, s in compiled for m in p.finditer(t)] for t in texts]

    return with_model(segments, SpanModel("policy-regex", find), text, into)


def exploded(segments: DataFrame, span_column: str = "spans", keys: tuple[str, ...] = ("request_id", "segment_id")) -> DataFrame:
    """One row per span."""
    return segments.select(*keys, F.explode(span_column).alias("s")).select(*keys, "s.*")


def any_pattern(text: Column, patterns: list[str]) -> Column:
    """Whether some pattern matches."""
    return reduce(lambda a, b: a | b, [possible(text, p) & text.rlike(spans.unicode_pattern(p)) for p in patterns], F.lit(False))
