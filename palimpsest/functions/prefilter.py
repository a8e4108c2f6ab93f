"""Necessary conditions of a pattern, read off its syntax tree: literals that a matching text must hold.

A search for literals costs a small part of what a pattern costs, and most texts fail it. Conditions are only ever
left out, never guessed: a pattern that Python cannot parse, or that asks for nothing certain, has none.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from re import _constants as op
from re import _parser as syntax

from pyspark.sql import Column
from pyspark.sql import functions as F

from .literals import strings

#: A condition: the text holds one of these literals; the empty set stands for a decimal digit.
Needs = tuple[frozenset[str], ...]
DIGIT: frozenset[str] = frozenset()
#: Beyond so many alternatives a condition is not worth its search.
MOST = 24
# Characters that case-insensitive search takes for an ASCII letter, though lower-casing does not make them one.
FOLDED = ("ſıİ", "sii")


def _best(needs: list[frozenset[str]]) -> frozenset[str] | None:
    """The most telling condition: the one whose shortest literal is longest, a digit last."""
    good = [n for n in needs if len(n) <= MOST]
    return max(good, key=lambda n: (min(map(len, n), default=0), -len(n)), default=None)


def _is_digit(items: list) -> bool:
    return bool(items) and all((kind is op.CATEGORY and av is op.CATEGORY_DIGIT) or (kind is op.RANGE and 48 <= av[0] <= av[1] <= 57) or (kind is op.LITERAL and 48 <= av <= 57) for kind, av in items)


def _needs(tree) -> list[frozenset[str]]:
    out: list[frozenset[str]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if run:
            out.append(frozenset([run]))
        run = ""

    for kind, av in tree:
        if kind is op.LITERAL:
            run += chr(av)
            continue
        close()
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and av[0] >= 1:
            out += _needs(av[2])
        elif kind is op.SUBPATTERN:
            out += _needs(av[3])
        elif kind is op.ATOMIC_GROUP:
            out += _needs(av)
        elif kind is op.IN and _is_digit(av):
            out.append(DIGIT)
        elif kind is op.BRANCH:
            parts = [_best(_needs(x)) for x in av[1]]
            if all(p is not None for p in parts) and len({p == DIGIT for p in parts}) == 1:
                out.append(frozenset().union(*parts))
    close()
    return out


@lru_cache(1024)
def needs(pattern: str) -> tuple[Needs, bool]:
    """The conditions of a pattern, the most telling first, and whether letters count in either case."""
    try:
        tree = syntax.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return (), False
    folded = bool(tree.state.flags & re.IGNORECASE)
    found = [frozenset(x.lower() for x in n) for n in _needs(tree)] if folded else _needs(tree)
    if folded:
        found = [n for n in found if all(x.isascii() for x in n)]
    unique = list(dict.fromkeys(n for n in found if len(n) <= MOST))
    return tuple(sorted(unique, key=lambda n: (-min(map(len, n), default=0), len(n)))[:3]), folded


def lowered(text: Column) -> Column:
    """A text in which folded literals are looked for."""
    return F.lower(F.translate(text, *FOLDED))


def possible(text: Column, pattern: str, low: Column | None = None) -> Column:
    """Whether the conditions of a pattern hold; ``low`` is the lowered text where the caller has it."""
    conditions, folded = needs(pattern)
    where = (low if low is not None else lowered(text)) if folded else text

    def one(n: frozenset[str]) -> Column:
        if n == DIGIT:
            return text.rlike(r"\p{Nd}")
        return F.contains(where, F.lit(next(iter(n)))) if len(n) == 1 else F.exists(strings(sorted(n)), lambda x: F.contains(where, x))

    return reduce(lambda a, b: a & b, [one(n) for n in conditions], F.lit(True))
