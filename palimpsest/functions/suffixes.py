"""Public suffixes of domains: rules, wildcards and exceptions, the longest match decides.

A rule names the labels at the end of a domain under which names are given out. ``*.x`` stands for every label before x, ``!a.x`` takes
a.x out of it again. A domain counts if a rule matches and a label stands before the suffix; one whose last label no rule knows does not.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Suffixes:
    """A set of rules, in the published notation."""

    rules: tuple[str, ...]

    @cached_property
    def plain(self) -> tuple[str, ...]:
        return tuple(r for r in self.rules if r[0] not in "*!")

    @cached_property
    def wild(self) -> tuple[str, ...]:
        return tuple(r[2:] for r in self.rules if r.startswith("*."))

    @cached_property
    def excepted(self) -> tuple[str, ...]:
        return tuple(r[1:] for r in self.rules if r.startswith("!"))

    @cached_property
    def depth(self) -> int:
        return max(r.count(".") + 1 for r in self.rules)

    def size(self, domain: Column) -> Column:
        """Labels of the domain's public suffix; 0 if no rule matches."""
        # a label is never empty, and a dot at the end is no label
        name = F.lower(F.regexp_replace(domain, r"\.$", ""))
        labels = F.size(F.split(name, r"\."))
        last = lambda k: F.substring_index(name, ".", -k)
        found, out = F.lit(0), F.lit(None).cast("int")
        for k in range(1, self.depth + 1):
            here = last(k).isin(*self.plain) if self.plain else F.lit(False)
            if k > 1 and self.wild:
                here = here | last(k - 1).isin(*self.wild)
            found = F.when((labels >= k) & here, F.lit(k)).otherwise(found)
            if k > 1 and self.excepted:
                out = F.when((labels >= k) & last(k).isin(*self.excepted), F.lit(k - 1)).otherwise(out)
        bad = name.rlike(r"(^|\.)(\.|$)")
        return F.when(bad, 0).otherwise(F.coalesce(out, found))

    def registrable(self, domain: Column) -> Column:
        """Whether the domain is a name under a public suffix."""
        size = self.size(domain)
        return (size > 0) & (F.size(F.split(F.regexp_replace(domain, r"\.$", ""), r"\.")) > size)


def parsed(lines: Iterable[str]) -> Suffixes:
    """Rules of a list in the published format: one a line, up to the first white space; ``//`` begins a remark."""
    rules = [line.split()[0].lower() for line in lines if line.strip() and not line.lstrip().startswith("//")]
    return Suffixes(tuple(dict.fromkeys(rules)))


# Common public suffixes, a part of the published list; ``parsed`` reads the whole.
COMMON = Suffixes((
    "com", "org", "net", "edu", "gov", "int", "mil", "info", "biz", "name", "pro", "io", "co", "ai", "app", "dev", "me", "tv", "cloud", "online", "shop", "site", "tech", "xyz", "email", "example", "test",
    "at", "au", "be", "bg", "br", "ca", "ch", "cl", "cn", "cz", "de", "dk", "ee", "es", "eu", "fi", "fr", "gr", "hr", "hu", "ie", "il", "in", "is", "it", "jp", "kr", "lt", "lu", "lv", "mx", "my", "nl", "no", "nz", "pl", "pt", "ro", "rs", "ru",
    "se", "sg", "si", "sk", "th", "tr", "tw", "ua", "uk", "us", "za",
    "ac.at", "co.at", "gv.at", "or.at", "com.au", "net.au", "org.au", "edu.au", "gov.au", "com.br", "net.br", "org.br", "gov.br", "com.cn", "net.cn", "org.cn", "gov.cn", "ac.il", "co.il", "org.il", "gov.il", "co.in", "net.in", "org.in", "ac.in", "gov.in",
    "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "co.kr", "or.kr", "go.kr", "com.mx", "org.mx", "co.nz", "net.nz", "org.nz", "govt.nz", "com.pl", "net.pl", "org.pl", "com.pt", "com.sg", "edu.sg", "com.tr", "org.tr", "gov.tr", "com.tw", "org.tw", "com.ua",
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "nhs.uk", "org.uk", "plc.uk", "police.uk", "sch.uk", "co.za", "org.za", "gov.za",
    "*.bd", "*.ck", "!www.ck", "*.er", "*.fk", "*.kh", "*.mm", "*.np", "*.pg", "*.kawasaki.jp", "!city.kawasaki.jp", "*.kobe.jp", "!city.kobe.jp", "*.sch.uk",
))
