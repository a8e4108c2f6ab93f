"""Telephone numbers by numbering plan.

A plan gives each prefix of a country's national numbers the lengths that they can have there; the longest prefix that a number begins with
decides, and a prefix without lengths is not in use. The prefixes of all countries are one trie of digits, written as one regular expression: a
prefix's branch excludes its longer ones, so exactly one branch can apply. A number with + (or 00) is read as international; others as
national numbers of the regions that are asked for.

What looks like a date, a time stamp or a count with grouped thousands is no number, whatever its digits.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Plan:
    """A country's calling code, the digits before a national number at home, and (prefixes, lengths) of national numbers; ``middle`` restricts what follows an area code."""

    code: str
    trunk: str
    numbers: tuple[tuple[str, tuple[int, ...]], ...]
    middle: str = ""


# Numbering plans from the public descriptions of the national regulators; [a-b] stands for any of these digits.
PLANS: dict[str, Plan] = {
    "US": Plan("1", "1", (("[2-9]", (10,)), ("[2-9]11", ()), ("37", ()), ("96", ())), r"\d{2}[2-9]\d"),
    "GB": Plan("44", "0", (("1", (9, 10)), ("2[0-9]", (10,)), ("3[0347]", (10,)), ("5[56]", (10,)), ("70", (10,)), ("7[1-57-9]", (10,)), ("76", (10,)), ("80[08]", (9, 10)), ("8[47]", (10,)), ("9[018]", (10,)))),
    "DE": Plan("49", "0", (("[2-9]", (6, 7, 8, 9, 10, 11)), ("15", (11,)), ("16", (10,)), ("17", (10, 11)), ("180", (8, 9, 10, 11)), ("700", (11,)), ("800", (10, 11)), ("900", (10, 11)))),
    "NL": Plan("31", "0", (("[1-57]", (9,)), ("6[1-58]", (9,)), ("8[58]", (9,)), ("800", (7, 10)), ("90[069]", (7, 10)))),
    "FR": Plan("33", "0", (("[1-7]", (9,)), ("8[0-29]", (9,)), ("9", (9,)))),
    "BE": Plan("32", "0", (("[1-35-9]", (8,)), ("4", (8,)), ("4[5-9]", (9,)))),
    "ES": Plan("34", "", (("[689]", (9,)), ("7[1-4]", (9,)))),
    "IT": Plan("39", "", (("0[1-9]", (6, 7, 8, 9, 10, 11)), ("3[1-9]", (9, 10)), ("80", (6, 9)))),
    "CH": Plan("41", "0", (("[2-6]", (9,)), ("7[4-9]", (9,)), ("8[04]", (9,)))),
    "AT": Plan("43", "0", (("1", (4, 5, 6, 7, 8, 9, 10, 11, 12, 13)), ("[2-7]", (7, 8, 9, 10, 11, 12, 13)), ("6[5-9]", (10, 11, 12, 13)))),
    "PL": Plan("48", "", (("[1-8]", (9,)),)),
    "IL": Plan("972", "0", (("[23489]", (8,)), ("5", (9,)), ("7", (9,)))),
    "IN": Plan("91", "0", (("[1-5]", (10,)), ("[6-9]", (10,)))),
    "BR": Plan("55", "0", (("[1-9][1-9][2-5]", (10,)), ("[1-9][1-9]9", (11,)))),
    "AU": Plan("61", "0", (("[23478]", (9,)),)),
    "JP": Plan("81", "0", (("[1-9]", (9,)), ("[789]0", (10,)), ("50", (10,)))),
}
#: Regions whose national numbers are read when none are named. Canada shares the plan of the United States.
REGIONS: tuple[str, ...] = ("US", "GB", "DE", "IL", "IN", "BR", "NL")


def prefixes(plan: Plan) -> dict[str, tuple[int, ...]]:
    """Every prefix of a plan, digit by digit."""
    out: dict[str, tuple[int, ...]] = {}
    for form, lengths in plan.numbers:
        parts = re.findall(r"\[[^]]+\]|\d", form)
        digits = [re.sub(r"(\d)-(\d)", lambda m: "".join(str(x) for x in range(int(m[1]), int(m[2]) + 1)), p.strip("[]")) for p in parts]
        out |= {"".join(p): lengths for p in product(*digits)}
    return out


def _branches(known: dict[str, tuple[int, ...]]) -> str:
    """The trie below a node as alternatives: ``known`` has what is left of the prefixes that pass it, and the digits that still follow each."""
    out = []
    for digit in sorted({p[0] for p in known if p}):
        below = {p[1:]: lengths for p, lengths in known.items() if p.startswith(digit)}
        here = below.pop("", None)
        rest = [f"(?:{_branches(below)})"] if below else []
        if here:
            longer = "".join(f"(?!{re.escape(p)})" for p in sorted(below)) if below else ""
            rest += [longer + f"\\d{{{n}}}" for n in here if n > 0]
        if rest:
            out.append(f"{digit}(?:{'|'.join(rest)})")
    return "|".join(out) or "(?!)"


def pattern(region: str) -> str:
    """The national numbers of a region, as one expression."""
    plan = PLANS[region]
    left = {p: tuple(n - len(p) for n in lengths) for p, lengths in prefixes(plan).items()}
    guard = f"(?=\\d{plan.middle})" if plan.middle else ""
    return guard + f"(?:{_branches(left)})"


def _international(regions: tuple[str, ...]) -> str:
    return "^(?:" + "|".join(f"{PLANS[r].code}{pattern(r)}" for r in regions) + ")$"


def _national(regions: tuple[str, ...]) -> str:
    # where there are no digits before a national number, it stands as it is; at home a 1 may be left out
    head = {"": "", "0": "0", "1": "1?"}
    return "^(?:" + "|".join(f"{head[PLANS[r].trunk]}{pattern(r)}" for r in regions) + ")$"


#: Dates, time stamps, and counts whose thousands are grouped.
_OTHER = (
    r"^(?:(?:19|20)\d{2}([-/. ])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])(?:\D.*)?"
    r"|(?:0?[1-9]|[12]\d|3[01])([-/.])(?:0?[1-9]|[12]\d|3[01])\2(?:19|20)?\d{2}(?:\D.*)?"
    r"|(?:19|20)\d{6}(?: \d{2,6})?|\d{1,3}(?:([ .])\d{3})(?:\3\d{3})*)$"
)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(value: Column, regions: tuple[str, ...] = REGIONS) -> Column:
    """Whether a value is a telephone number: an international one of any plan, or a national one of ``regions``."""
    digits = _digits(value)
    abroad = value.startswith("+")
    from_home = digits.startswith("00")
    everywhere = _international(tuple(PLANS))
    return (
        F.when(abroad, F.regexp_replace(value, r"\(0\)", "").startswith("+") & _digits(F.regexp_replace(value, r"\(0\)", "")).rlike(everywhere))
        .when(value.rlike(_OTHER), False)
        .when(from_home, F.substr(digits, F.lit(3)).rlike(everywhere))
        .otherwise(digits.rlike(_national(regions)))
    )


def region(value: Column) -> Column:
    """The country of an international number, or null."""
    digits = F.regexp_replace(_digits(F.regexp_replace(value, r"\(0\)", "")), "^00", "")
    return F.coalesce(*[F.when(digits.rlike(_international((r,))), F.lit(r)) for r in PLANS])
