"""Validity checks of matched values, as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import identifiers, phones, suffixes


def digits(value: Column) -> Column:
    """The decimal digits of a value as integers."""
    return F.transform(F.filter(F.split(value, ""), lambda c: c.rlike("[0-9]")), lambda c: c.cast("int"))


def luhn(value: Column) -> Column:
    """Card checksum over the digits, separators ignored."""
    return F.call_function("luhn_check", F.regexp_replace(value, "[^0-9]", ""))


def octets(value: Column) -> Column:
    """Four numbers of at most 255."""
    return F.forall(F.split(value, r"\."), lambda x: x.cast("int") <= 255)


def eleven(value: Column) -> Column:
    """Dutch citizen number: weights 9 to 2 and -1, remainder 0 modulo 11, not all zeros."""
    weights = F.array(*[F.lit(w) for w in (9, 8, 7, 6, 5, 4, 3, 2, -1)])
    total = F.aggregate(F.zip_with(digits(value), weights, lambda a, b: a * b), F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    return (value != "000000000") & (F.size(digits(value)) == 9) & (F.pmod(total, F.lit(11)) == 0)


def mod97(value: Column) -> Column:
    """Bank account number: its first four characters moved to the end, letters as 10 to 35, remainder 1 modulo 97."""
    bare = F.upper(F.regexp_replace(value, "[^A-Za-z0-9]", ""))
    moved = F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))
    letters = F.filter(F.split(moved, ""), lambda c: c != "")

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(letters, F.lit(0), step) == 1


def phone(value: Column) -> Column:
    """A number of some country's numbering plan."""
    return phones.valid(value)


def suffix(value: Column) -> Column:
    """The mail domain is a name under a public suffix."""
    return suffixes.COMMON.registrable(F.substring_index(value, "@", -1))


CHECKS: dict[str, Callable[[Column], Column]] = {"luhn": luhn, "octets": octets, "eleven": eleven, "mod97": mod97, "phone": phone, "suffix": suffix}
CHECKS |= {name: kind.valid for name, kind in identifiers.IDENTIFIERS.items()}
