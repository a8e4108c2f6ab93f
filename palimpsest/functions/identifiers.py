"""Check characters of national and tax numbers: a table of public specifications, and the few families of sums they use.

Every number is one row: where it is from, the entity it is, its form, and its checks. A ``Sum`` weighs the characters' values and takes the total by a
modulus; the remainder is zero, or names the check character. ``hybrid`` and ``dihedral`` carry a state from digit to digit. All are
expressions over the value, so a rule with a check stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _numbers(values: tuple[int, ...]) -> Column:
    return F.expr(f"array({', '.join(map(str, values))})")


def bare(value: Column) -> Column:
    """Letters and digits of a value, in capitals."""
    return F.upper(F.regexp_replace(value, "[^A-Za-z0-9]", ""))


def _characters(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


@dataclass(frozen=True)
class Sum:
    """Weights from the left (0 leaves a place out); ``letters`` has the check character of each remainder ('-': none is valid), else the remainder is 0.

    A character's value is its place in 0-9A-Z, or what ``values`` has there; ``odd`` is another table for the first, third, ... place.
    """

    weights: tuple[int, ...]
    modulus: int
    letters: str = ""
    at: int = -1
    offset: int = 0
    values: tuple[int, ...] = ()
    odd: tuple[int, ...] = ()

    def __call__(self, value: Column) -> Column:
        known = _numbers(self.values or tuple(range(36)))
        odd = _numbers(self.odd) if self.odd else known
        place = lambda c: F.call_function("instr", F.lit(_ALPHABET), c)
        chars = _characters(value)
        worth = F.transform(chars, lambda c, i: F.get(F.when(i % 2 == 0, odd).otherwise(known) if self.odd else known, place(c) - 1))
        total = F.aggregate(F.zip_with(worth, _numbers(self.weights), lambda x, w: x * w), F.lit(self.offset), lambda a, x: a + x)
        rest = F.pmod(total, F.lit(self.modulus))
        good = rest == 0 if not self.letters else F.substr(F.lit(self.letters), rest + 1, F.lit(1)) == F.element_at(chars, self.at if self.at < 0 else self.at + 1)
        return F.coalesce((F.length(value) == len(self.weights)) & good, F.lit(False))


def doubled(value: Column) -> Column:
    """Every second digit from the right doubled, digits added up: a multiple of ten."""
    return F.call_function("luhn_check", value)


def hybrid(value: Column) -> Column:
    """A product carried modulo 11 and a sum modulo 10, from the left; what is left to 11 is the last digit."""
    chars = F.transform(_characters(value), lambda c: c.try_cast("int"))
    body = F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0)))

    def step(carry: Column, d: Column) -> Column:
        total = (carry + d) % 10
        return (F.when(total == 0, 10).otherwise(total) * 2) % 11

    return F.coalesce((F.size(chars) > 1) & ((11 - F.aggregate(body, F.lit(10), step)) % 10 == F.element_at(chars, -1)), F.lit(False))


def _turn(a: int, b: int) -> int:
    """Product of two symmetries of a pentagon: 0 to 4 are turns, 5 to 9 reflections."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
    return 5 + (a - b) % 5 if b < 5 else (a - b) % 5


#: The permutation that is applied once more with every place.
_PLACES = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def dihedral(value: Column) -> Column:
    """Digits from the right, each permuted by its place, multiplied in the symmetries of a pentagon: the identity."""
    rows, row = [], tuple(range(10))
    for _ in range(8):
        rows.append(row)
        row = tuple(_PLACES[x] for x in row)
    product = _numbers(tuple(_turn(a, b) for a in range(10) for b in range(10)))
    permuted = _numbers(tuple(x for r in rows for x in r))
    digits = F.transform(F.reverse(_characters(value)), lambda c, i: F.get(permuted, (i % 8) * 10 + c.try_cast("int")))
    return F.coalesce((F.length(value) > 0) & (F.aggregate(digits, F.lit(0), lambda a, x: F.get(product, a * 10 + x)) == 0), F.lit(False))


def _powers(n: int, modulus: int) -> tuple[int, ...]:
    return tuple(pow(10, n - 1 - i, modulus) for i in range(n))


@dataclass(frozen=True)
class Identifier:
    """A kind of number: ``checks`` must all hold for its letters and digits, after ``swaps`` (pattern, replacement)."""

    country: str
    entity: str
    pattern: str
    checks: tuple[Callable[[Column], Column], ...]
    context: tuple[str, ...]
    swaps: tuple[tuple[str, str], ...] = ()
    score: float = 0.5

    def valid(self, value: Column) -> Column:
        """Whether a value has this form's check characters."""
        plain = bare(value)
        for pattern, replacement in self.swaps:
            plain = F.regexp_replace(plain, pattern, replacement)
        # the value is worked out once, however many checks there are
        def all_(v: Column) -> Column:
            out = self.checks[0](v)
            for check in self.checks[1:]:
                out = out & check(v)
            return out

        return F.get(F.transform(F.array(plain), all_), F.lit(0))


# Forms, weights and check letters of public specifications. An entry's values of characters are 0-9 for digits and 10-35 for letters unless said.
_FISCAL_ODD = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)
_FISCAL_EVEN = (*range(10), *range(26))
_FIRST_XYZ = (*range(10), *[0] * 23, 0, 1, 2)
IDENTIFIERS: dict[str, Identifier] = {
    "NL_BSN": Identifier("NL", "BSN", r"\b(?!0{9})\d{9}\b", (Sum((9, 8, 7, 6, 5, 4, 3, 2, -1), 11),), ("bsn", "burgerservicenummer")),
    "UK_NHS": Identifier("GB", "HEALTH_INSURANCE_ID", r"\b\d{3}[- ]?\d{3}[- ]?\d{4}\b", (Sum((10, 9, 8, 7, 6, 5, 4, 3, 2, 0), 11, "0-987654321"),), ("nhs", "national health service")),
    "US_ABA": Identifier("US", "BANK_ACCOUNT", r"\b[0-3]\d{3}-?\d{4}-?\d\b", (Sum((3, 7, 1, 3, 7, 1, 3, 7, 1), 10),), ("aba", "routing", "bank")),
    "CA_SIN": Identifier("CA", "NATIONAL_ID_NUMBER", r"\b[1-79]\d{2}[- ]?\d{3}[- ]?\d{3}\b", (doubled,), ("sin", "social insurance")),
    "DE_TAX_ID": Identifier("DE", "TAX_ID", r"\b[1-9]\d ?\d{3} ?\d{3} ?\d{3}\b", (hybrid,), ("steuerid", "idnr", "steueridentifikationsnummer")),
    "DE_VAT": Identifier("DE", "VAT_NUMBER", r"\bDE ?[1-9]\d{8}\b", (hybrid,), ("ust", "umsatzsteuer", "vat"), (("^DE", ""),)),
    "DE_ID_CARD": Identifier("DE", "NATIONAL_ID_NUMBER", r"\b[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{8}\d\b", (Sum((7, 3, 1, 7, 3, 1, 7, 3, 1, -1), 10),), ("personalausweis", "ausweis", "reisepass")),
    "ES_NIF": Identifier("ES", "NATIONAL_ID_NUMBER", r"\b\d{8}-?[A-HJ-NP-TV-Z]\b", (Sum((*_powers(8, 23), 0), 23, "TRWAGMYFPDXBNJZSQVHLCKE"),), ("dni", "nif")),
    "ES_NIE": Identifier("ES", "NATIONAL_ID_NUMBER", r"\b[XYZ]-?\d{7}-?[A-HJ-NP-TV-Z]\b", (Sum((*_powers(8, 23), 0), 23, "TRWAGMYFPDXBNJZSQVHLCKE", values=_FIRST_XYZ),), ("nie", "extranjero")),
    "IT_FISCAL_CODE": Identifier("IT", "TAX_ID", r"\b[A-Z]{6}[0-9LMNP-V]{2}[A-EHLMPRST][0-9LMNP-V]{2}[A-Z][0-9LMNP-V]{3}[A-Z]\b", (Sum((*[1] * 15, 0), 26, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", values=_FISCAL_EVEN, odd=_FISCAL_ODD),), ("codice", "fiscale")),
    "IT_VAT": Identifier("IT", "VAT_NUMBER", r"\b(?:IT ?)?\d{11}\b", (doubled,), ("partita", "iva"), (("^IT", ""),)),
    "FR_NIR": Identifier("FR", "NATIONAL_ID_NUMBER", r"\b[12] ?\d{2} ?(?:0[1-9]|1[0-2]|[2-9]\d) ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3} ?\d{2}\b", (Sum((*_powers(13, 97), 10, 1), 97),), ("sécurité sociale", "nir"), (("^(.{5})2A", "$119"), ("^(.{5})2B", "$118"))),
    "BE_NN": Identifier("BE", "NATIONAL_ID_NUMBER", r"\b\d{2}\.?(?:0\d|1[0-2])\.?[0-3]\d-?\d{3}[.-]?(?!00)\d{2}\b", (lambda v: Sum((*_powers(9, 97), 10, 1), 97)(v) | Sum((*_powers(9, 97), 10, 1), 97, offset=2 * pow(10, 9, 97))(v),), ("rijksregister", "registre national")),
    "PT_NIF": Identifier("PT", "TAX_ID", r"\b[1235689]\d{2} ?\d{3} ?\d{3}\b", (Sum((9, 8, 7, 6, 5, 4, 3, 2, 0), 11, "00987654321"),), ("nif", "contribuinte")),
    "PL_PESEL": Identifier("PL", "NATIONAL_ID_NUMBER", r"\b\d{2}[0-9]\d[0-3]\d{6}\b", (Sum((1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1), 10),), ("pesel",)),
    "FI_HETU": Identifier("FI", "NATIONAL_ID_NUMBER", r"\b[0-3]\d[01]\d{3}[-+ABCDEFYXWVU]\d{3}[0-9A-FHJ-NPR-Y]\b", (Sum((*_powers(9, 31), 0), 31, "0123456789ABCDEFHJKLMNPRSTUVWXY"),), ("hetu", "henkilötunnus"), (("^(\\d{6})[A-FU-Y](?=.{4}$)", "$1"),)),
    "SE_PERSONNUMMER": Identifier("SE", "NATIONAL_ID_NUMBER", r"\b\d{2}[01]\d[0-9]\d[-+]?\d{4}\b", (doubled,), ("personnummer", "samordningsnummer")),
    "NO_FNR": Identifier("NO", "NATIONAL_ID_NUMBER", r"\b[0-7]\d[0-9]\d{3} ?\d{5}\b", (Sum((3, 7, 6, 1, 8, 9, 4, 5, 2, 1, 0), 11), Sum((5, 4, 3, 2, 7, 6, 5, 4, 3, 2, 1), 11)), ("fødselsnummer", "fnr")),
    "CH_AHV": Identifier("CH", "NATIONAL_ID_NUMBER", r"\b756\.?\d{4}\.?\d{4}\.?\d{2}\b", (Sum((1, 3, 1, 3, 1, 3, 1, 3, 1, 3, 1, 3, 1), 10),), ("ahv", "avs")),
    "AU_TFN": Identifier("AU", "TAX_ID", r"\b\d{3} ?\d{3} ?\d{3}\b", (Sum((1, 4, 3, 7, 5, 8, 6, 9, 10), 11),), ("tfn", "tax file")),
    "AU_ABN": Identifier("AU", "TAX_ID", r"\b[1-9]\d ?\d{3} ?\d{3} ?\d{3}\b", (Sum((10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19), 89, offset=-10),), ("abn", "business number")),
    "AU_MEDICARE": Identifier("AU", "HEALTH_INSURANCE_ID", r"\b[2-6]\d{3} ?\d{5} ?\d\b", (Sum((1, 3, 7, 9, 1, 3, 7, 9, 0, 0), 10, "0123456789", at=8),), ("medicare",)),
    "SG_NRIC": Identifier("SG", "NATIONAL_ID_NUMBER", r"\b[ST]\d{7}[A-JZ]\b", (lambda v: F.when(v.startswith("T"), Sum((0, 2, 7, 6, 5, 4, 3, 2, 0), 11, "JZIHGFEDCBA", offset=4)(v)).otherwise(Sum((0, 2, 7, 6, 5, 4, 3, 2, 0), 11, "JZIHGFEDCBA")(v)),), ("nric",)),
    "IN_AADHAAR": Identifier("IN", "NATIONAL_ID_NUMBER", r"\b[2-9]\d{3}[- ]?\d{4}[- ]?\d{4}\b", (dihedral,), ("aadhaar", "uidai")),
    "BR_CPF": Identifier("BR", "TAX_ID", r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b", (Sum((10, 9, 8, 7, 6, 5, 4, 3, 2, 0, 0), 11, "00987654321", at=9), Sum((11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 0), 11, "00987654321", at=10), lambda v: ~v.rlike(r"^(\d)\1*$")), ("cpf",)),
}
COUNTRIES: tuple[str, ...] = tuple(sorted({x.country for x in IDENTIFIERS.values()}))
