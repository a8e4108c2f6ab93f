"""Context words before a match: whole words, casefolded, inflections folded, stop words left out."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import CONTEXT, INFLECTIONS, STOP_WORDS
from .literals import mapping, strings
from .spans import found, let


def _fold(word: Column) -> Column:
    # beyond lower case: letters that are one to a reader who ignores case
    low = F.replace(F.translate(F.lower(word), "ςſ", "σs"), F.lit("ß"), F.lit("ss"))
    return F.coalesce(F.element_at(mapping(INFLECTIONS), low), low)


def words(text: Column) -> Column:
    """All words (letters and digits) with their starts: ``array<struct<word, start>>``."""
    return F.transform(found(text, r"[^\W_]+"), lambda m: F.struct(_fold(m.value).alias("word"), m.start.alias("start")))


def content(index: Column, language: str) -> Column:
    """The words that are no stop words of a language."""
    stop = strings(STOP_WORDS.get(language, ()))
    return F.filter(index, lambda w: ~F.array_contains(stop, w.word))


def _begun(words_: Column, start: Column) -> Column:
    """How many of the words, which are in order, begin before ``start``: found by halving."""
    halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.size(words_) + 1)).cast("int"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at.lo + at.hi) / 2).cast("int")
        before = F.get(words_, middle).start < start
        lo = F.when((at.lo < at.hi) & before, middle + 1).otherwise(at.lo)
        hi = F.when((at.lo < at.hi) & ~before, middle).otherwise(at.hi)
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    return F.aggregate(halvings, F.struct(F.lit(0).alias("lo"), F.size(words_).alias("hi")), halve, lambda at: at.lo)


def before(content_: Column, start: Column, size: int = 5) -> Column:
    """The last ``size`` of the content words that begin before ``start``."""
    last = lambda n: F.transform(F.slice(content_, F.greatest(n - size + 1, F.lit(1)), F.least(n, F.lit(size))), lambda w: w.word)
    return let(_begun(content_, start), last)


def window(index: Column, start: Column, language: str, size: int = 5) -> Column:
    """The last ``size`` content words that begin before ``start``, for one language."""
    return let(content(index, language), lambda words_: before(words_, start, size))


def contains_phrase(window_: Column, phrase: str) -> Column:
    """Whether the words of ``phrase`` stand in the window, one after another."""
    parts = _folded(phrase)
    if not parts:
        return F.lit(False)
    n = len(parts)
    wanted = strings(parts)
    places = F.when(F.size(window_) >= n, F.sequence(F.lit(1), F.size(window_) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(places, lambda i: F.slice(window_, i, n) == wanted)


def contents(index: Column, languages: tuple[str, ...]) -> Column:
    """The content words of each language, as fields of one struct."""
    return F.struct(*[content(index, language).alias(language) for language in languages])


def _folded(phrase: str) -> list[str]:
    return [INFLECTIONS.get(w.casefold(), w.casefold()) for w in phrase.split()]


def _any_phrase(phrases: tuple[str, ...]) -> Callable[[Column], Column]:
    """Whether a window has one of the phrases; those of one word are looked up together."""
    single = sorted({x[0] for x in map(_folded, phrases) if len(x) == 1})
    longer = sorted({p for p in phrases if len(_folded(p)) > 1})

    def has(near: Column) -> Column:
        parts = ([F.arrays_overlap(near, strings(single))] if single else []) + [contains_phrase(near, p) for p in longer]
        return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)

    return has


def supports(contents_: Column, start: Column, entity: str, languages: tuple[str, ...], own: tuple[str, ...] = ()) -> Column:
    """Whether a context phrase of the entity (or of the rule's own) stands before ``start`` in some language."""
    out = F.lit(False)
    for language in languages:
        if phrases := (*own, *CONTEXT.get(entity, {}).get(language, ())):
            out = out | let(before(contents_[language], start), _any_phrase(phrases))
    return out


def has_phrases(entity: str, languages: tuple[str, ...], own: tuple[str, ...] = ()) -> bool:
    """Whether any context phrase can support an entity."""
    return bool(languages) and bool(own or any(CONTEXT.get(entity, {}).get(language) for language in languages))


def boosted(score: Column | float) -> Column:
    """A supported score: 0.35 more, at least 0.4 and at most 1."""
    score = score if isinstance(score, Column) else F.lit(score)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.4), score + 0.35))
