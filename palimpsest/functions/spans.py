"""Span expressions: matches with code-point offsets, validation, and union by set.

A span is ``struct<entity_type, start, end, score, source>``; offsets are half-open code points of one text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .prefilter import possible

SPAN = "struct<entity_type:string,start:int,end:int,score:double,source:string>"


def no_spans() -> Column:
    """An empty span array."""
    return F.array().cast(f"array<{SPAN}>")


def span(entity: Column | str, start: Column, end: Column, score: Column | float, source: Column | str) -> Column:
    """One span."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        lit(entity).alias("entity_type"), start.cast("int").alias("start"), end.cast("int").alias("end"), lit(score).cast("double").alias("score"), lit(source).alias("source")
    )


def unicode_pattern(pattern: str) -> str:
    """Java pattern with Unicode classes, as Python's ``str`` patterns have them."""
    return f"(?U){pattern}"


MATCH = "struct<value:string,start:int,end:int>"


def found(text: Column, pattern: str) -> Column:
    """All matches of a pattern as ``array<struct<value, start, end>>``, without a Python function.

    One search: matches are marked by a separator made from the text's own hash (which it cannot hold but by chance), and the
    text is split at it into gaps and matches in turn; offsets are running sums of their lengths. Texts that lack what the
    pattern needs are not searched.
    """

    def search(mark: Column) -> Column:
        pieces = F.split(F.regexp_replace(text, F.lit(unicode_pattern(pattern)), F.concat(mark, F.lit("$0"), mark)), mark, -1)

        def cut(parts: Column) -> Column:
            ends = running(F.transform(parts, F.length), F.lit(0), "int", lambda x, y: x + y)
            value = lambda e, i: F.struct(F.get(parts, i).alias("value"), e.alias("start"), (e + F.length(F.get(parts, i))).alias("end"))
            return let(ends, lambda at: F.filter(F.transform(at, lambda e, i: F.when(i % 2 == 1, value(e, i))), lambda m: m.isNotNull()))

        return F.when(F.size(pieces) > 1, let(pieces, cut))

    marked = let(F.concat(F.lit("\x01"), F.hex(F.xxhash64(text)), F.lit("\x01")), search)
    return F.coalesce(F.when(possible(text, pattern), marked), F.array().cast(f"array<{MATCH}>")).cast(f"array<{MATCH}>")


def between(text: Column, separator: str) -> Column:
    """Offsets (start, end) of all that stands between single separator characters: what ``found`` says of ``[^separator]+``, from one split."""
    parts = F.split(text, F.lit(f"[{separator}]"), -1)

    def cut(all_: Column) -> Column:
        starts = running(F.transform(all_, lambda p: F.length(p) + 1), F.lit(0), "int", lambda x, y: x + y)
        return F.filter(F.zip_with(starts, all_, lambda a, p: F.struct(a.alias("start"), (a + F.length(p)).alias("end"))), lambda t: t.end > t.start)

    return let(parts, cut)


def consumed(text: Column, pattern: str) -> Column:
    """Values of a pattern that no letter, number or ``_`` touches, where each neighbour is consumed, as in engines without look-around: one that stood after a match does not stand before the next."""
    outside = r"[^\p{L}\p{N}_]"
    return F.when(possible(text, pattern), F.regexp_extract_all(text, F.lit(rf"(?:^|{outside})({pattern})(?:\z|{outside})"), F.lit(1)))


def running(values: Column, zero: Column, kind: str, merge: Callable[[Column, Column], Column], widths: tuple[int, ...] = (16, 256)) -> Column:
    """For each element of an array, the merge of ``zero`` and all elements before it (``merge`` is associative, ``zero`` changes nothing): by short blocks, whose totals are taken the same way, so long arrays cost little more than their length."""
    state = f"struct<t:{kind},out:array<{kind}>>"
    empty = F.struct(zero.cast(kind).alias("t"), F.array().cast(f"array<{kind}>").alias("out")).cast(state)
    step = lambda acc, x: F.struct(merge(acc.t, x).cast(kind).alias("t"), F.concat(acc.out, F.array(acc.t)).alias("out"))
    width, wider = widths[0], widths[1:]

    def joined(parts: Column) -> Column:
        def moved(bases: Column) -> Column:
            return F.flatten(F.zip_with(parts, bases, lambda part, base: F.transform(part.out, lambda o: merge(base, o).cast(kind))))

        def summed(part: Column, i: Column) -> Column:
            return F.aggregate(F.slice(parts, 1, i), zero.cast(kind), lambda acc, x: merge(acc, x.t).cast(kind))

        return let(running(F.transform(parts, lambda part: part.t), zero, kind, merge, wider) if wider else F.transform(parts, summed), moved)

    def blocks(v: Column) -> Column:
        starts = F.filter(F.transform(v, lambda _, i: i), lambda i: i % width == 0)
        return let(F.transform(starts, lambda i: F.aggregate(F.slice(v, i + 1, width), empty, step)), joined)

    return let(values, lambda v: F.when(F.size(v) <= width, F.aggregate(v, empty, step, lambda acc: acc.out)).otherwise(blocks(v)))


def grouped(items: Column, first: Callable[[Column, Column], Column]) -> Column:
    """A sorted array cut into arrays; ``first(items, i)`` says whether place ``i`` starts one (place 0 always does)."""

    def cut(all_: Column) -> Column:
        starts = F.filter(F.transform(all_, lambda _, i: i), lambda i: (i == 0) | first(all_, i))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.slice(all_, i + 1, F.coalesce(F.get(at, k + 1), F.size(all_)) - i)))

    return let(items, cut)


def pattern_spans(text: Column, entity: str, pattern: str, score: float, source: str) -> Column:
    """Spans of all matches of one pattern."""
    return F.transform(found(text, pattern), lambda m: span(entity, m.start, m.end, score, source))


def union(parts: list[Column]) -> Column:
    """All spans of several arrays (UNION ALL)."""
    return reduce(lambda a, b: F.concat(a, b), parts) if parts else no_spans()


def ordered(spans: Column) -> Column:
    """Distinct spans by start, end, entity, falling score, source."""
    key = lambda s: F.struct(s.start.alias("a"), s.end.alias("b"), s.entity_type.alias("c"), (-s.score).alias("d"), s.source.alias("e"))
    return F.transform(distinct(F.transform(spans, key)), lambda k: span(k.c, k.a, k.b, -k.d, k.e))


def distinct(items: Column) -> Column:
    """An array's distinct elements in order: sorted and compared one by one, as structs have no hash."""
    return let(F.array_sort(items), lambda all_: F.filter(all_, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(all_, i - 1))))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body (or a lambda in it) uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def best(spans: Column, by_source: bool = False) -> Column:
    """The best-scored span of each (entity, start, end), or also of each source; the first source on a tie."""
    source = lambda s: [s.source.alias("e")] if by_source else []
    key = lambda s: F.struct(s.start.alias("a"), s.end.alias("b"), s.entity_type.alias("c"), *source(s))
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(key(s).alias("k"), (-s.score).alias("d"), s.source.alias("e"))))
    tops = let(ranked, lambda r: F.filter(r, lambda x, i: (i == 0) | (x.k != F.get(r, i - 1).k)))
    return F.transform(tops, lambda x: span(x.k.c, x.k.a, x.k.b, -x.d, x.e))


def invalid(spans: Column, text: Column) -> Column:
    """Whether some span lies outside the text, is empty, or has a score outside 0 to 1 (or none)."""
    outside = lambda n: F.exists(spans, lambda s: (s.start < 0) | (s.end > n) | (s.end <= s.start) | s.score.isNull() | F.isnan(s.score) | (s.score < 0) | (s.score > 1))
    return F.coalesce(let(F.length(text), outside), F.lit(False))


def validated(spans: Column, text: Column) -> Column:
    """The spans; the query fails if one is invalid, as evidence must not be dropped silently."""
    return F.when(invalid(spans, text), F.raise_error(F.lit("invalid span")).cast(f"array<{SPAN}>")).otherwise(spans)
