"""Surrogates for personal data: keyed, type-consistent replacements of detected entities.

Entities are found by pattern, reduced to a canonical value (so differently formatted mentions of
one value agree), and each distinct canonical value gets one surrogate. Numbers, addresses, secrets and mail
names go through a keyed Feistel permutation of their own format: half of the characters shift the other half, each within
its kind (a letter becomes a letter of the same case, a digit a digit, an octet an octet), so distinct values of a format get
distinct surrogates by construction; card and bank numbers get valid check digits. Names are invented
from syllables of the script, given names with an ending of the title's gender.

Names: a name that follows a title, or begins with a common given name and goes on with a capitalised word (with particles, initials,
apostrophes and hyphens), gives its words to the document; wherever such a word stands in that document, with or without the title, capitalised
or in capitals, alone or with a genitive s, it is the same entity and gets the same surrogate. It is no name before a word of
places and institutions, nor, if it is an everyday word, at the start of a sentence that goes on with anything but a verb of persons.

Dates, time stamps, decimal fractions, numbers with grouped thousands and runs of up to eight digits are found too, and stay as they are, so that no part
of them is taken for a telephone number. Secrets are long mixed words, keys with a known prefix (which stays), and what is assigned to a password.

Collision checks run over the distinct values of the whole table: a surrogate that two values
share (formats can meet), or that is itself a value of the table, is drawn again with the next attempt number,
until none is left. No format holds a draw up: a name gets one more syllable with each attempt, and from attempt
``ROOMY`` on other formats, which then must be crowded, are left: one more digit with each attempt, and for private addresses
10.0.0.0/8, for others any address, then 2001:db8::/32.

A text is searched once: the pattern marks matches and kinds with a separator made from the text's own hash, and
the pieces between separators are written; everything later joins on a row number. Texts without an at sign, a digit or a name are
left as they are. Everything is built-in expressions.

Defined results: a null or empty text stays as it is; repeated rows get equal replacements; texts
of any length are handled whole; an initial before a name becomes another letter, without a collision check; extra columns
of any name pass through, and ``doc_id`` is not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

# Titles by gender. (en, de, fr, es, nl, ru, el)
MALE = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Meneer", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Mevrouw", "Госпожа", "Κυρία")
#: Titles that tell no gender.
NEUTRAL = ("Dr", "Doctor", "Prof", "Professor", "President", "Senator", "Governor", "Judge", "Captain", "Sergeant", "Minister", "Kanzler", "Président", "Presidente", "Доктор", "Δρ")
# Common given names that are not everyday words.
MEN = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Steven Paul Andrew Joshua Kenneth Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob "
    "Hans Peter Klaus Jürgen Wolfgang Andreas Stefan Markus Jean Pierre Jacques Luc José Juan Carlos Luis Miguel Jan Piet Willem Иван Сергей Дмитрий Алексей Γιώργος Νίκος Mohammed Ahmed Ali"
).split()
WOMEN = (
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Betty Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Anna Emma Julia "
    "Ursula Monika Petra Sabine Claudia Katharina Marie Isabelle Sophie Camille María Carmen Ana Lucía Johanna Maria Елена Ольга Наталья Татьяна Μαρία Ελένη Fatima Aisha"
).split()
# Words after a name that make it one of a place or an institution.
PLACES = (
    "House Street Road Avenue Lane Square Park Bridge River Lake Island Mountain Mountains Sea County City Center Centre University College School Hospital Church Cathedral Airport Station Hall Museum Library Bank "
    "Award Prize Foundation Institute Company Inc Ltd Straße Strasse Platz Allee"
).split()
# Surnames that are everyday words too, and verbs of persons.
EVERYDAY = "white black brown green gray grey young long short rose may will mark grant stone wood woods hill field fields rich price bell cook baker king bishop page banks bush rice best day love little small strong sharp cross weiß schwarz klein groß lang kurz".split()
VERBS = "said says told tells asked asks wrote writes replied answered was is has had will would could should did does went came met left joined called and also then kam ging sagte war ist hat".split()
# Beginnings of keys.
KEYS = ("AKIA", "ASIA", "AROA", "AIDA", "AIza", "sk[-_]", "pk[-_]", "rk[-_]", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox[abeoprs]-", "npm_", "hf_")
# First and last letters of alphabets beyond ASCII, as code points.
LETTERS = (
    (0x00C0, 0x00D6), (0x00D8, 0x00DE), (0x00DF, 0x00F6), (0x00F8, 0x00FF), (0x0100, 0x017F), (0x0391, 0x03A1), (0x03B1, 0x03C9), (0x0410, 0x042F), (0x0430, 0x044F), (0x05D0, 0x05EA), (0x0641, 0x064A), (0x3041, 0x3096), (0x30A1, 0x30FA),
    (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
)
# Syllables of invented names by script.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi".split(),
    "cyrillic": "ба бе би бо да де ди до ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те ти то ва ве ви".split(),
    "greek": "βα βε βι βο δα δε δι δο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε σι σο τα τε τι το".split(),
}
ENDINGS = {"latin": ("an", "ela"), "cyrillic": ("ан", "ела"), "greek": ("ανος", "ελα")}

#: Attempts that stay in the format of the original, and rounds of the permutation.
ROOMY, ROUNDS = 3, 6

_any = lambda words: "|".join(sorted(words, key=len, reverse=True))
_TITLES = _any(MALE + FEMALE + NEUTRAL)
# Particles inside names, and academic titles before them.
PARTICLES = ("van", "von", "vom", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "ten", "ter", "zu", "zum", "bin", "al", "el", "af", "av")
DEGREES = ("Dr", "Prof", "Doctor", "Professor")
# Decimal digits of other scripts, each row from zero to nine.
DIGITS = "٠١٢٣٤٥٦٧٨٩" "۰۱۲۳۴۵۶۷۸۹" "०१२३४५६७८९" "０１２３４５６７８９"

_TITLE = rf"(?<!\p{{L}})(?:{_TITLES})\.? (?:(?:{'|'.join(DEGREES)})\.? ){{0,2}}"
_CORE = r"\p{Lu}(?:\p{Ll}{1,30}(?:\p{Lu}\p{Ll}{1,30})?|\p{Lu}{1,30})"
_WORD = rf"(?!(?:{_any(PLACES)})(?!\p{{L}}))(?:\p{{Lu}}['’])?{_CORE}(?:[-'’]{_CORE}){{0,3}}"
_BEFORE = rf"(?:(?:{'|'.join(PARTICLES)}|(?:\p{{Lu}}\.){{1,3}}) ){{0,4}}"
_GIVEN = rf"(?<!\p{{L}})(?:{_any([*MEN, *WOMEN])})(?:-{_CORE})?(?: {_BEFORE}{_WORD}){{1,2}}"
_TITLED = rf"{_TITLE}{_BEFORE}{_WORD}(?: {_BEFORE}{_WORD}){{0,2}}|{_GIVEN}"
_YEAR, _MONTH, _DAY = r"(?:1[6-9]|20)\d\d", r"(?:1[0-2]|0?[1-9])", r"(?:3[01]|[12]\d|0?[1-9])"
_CLOCK = r"(?:(?:T|,? )\d{1,2}[:.]\d{2}(?:[:.]\d{2}(?:[.,]\d{1,9})?)?)?(?:Z|(?:\+|-)\d{2}:?\d{2})?"
_HEX = r"[0-9A-Fa-f]{1,4}"
_ASSIGNED = r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_ -]?key|access[_ -]?key)[\"']?\s{0,2}[:=]\s{0,2}[\"']?"
#: Types in order of precedence; every pattern is bounded, so no text makes a match run long.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("email", r"(?<![\p{L}\p{N}._%+'-])[\p{L}\p{M}\p{N}._%+'-]{1,64}+@(?:[\p{L}\p{M}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}"),
    (
        "secret",
        r"(?<![A-Za-z0-9_])(?=[A-Za-z_]{0,256}[0-9])(?=[0-9_]{0,256}[A-Za-z])[A-Za-z0-9_]{24,256}(?![A-Za-z0-9_])"
        rf"|(?<![A-Za-z0-9_-])(?:{'|'.join(KEYS)})(?=[A-Za-z_-]{{0,256}}[0-9])[A-Za-z0-9_-]{{16,256}}(?![A-Za-z0-9_-])"
        rf"|(?<=[\s:=\"'])(?<={_ASSIGNED})(?=[^\s\"',;]{{0,63}}[0-9])[^\s\"',;]{{5,127}}[^\s\"',;.!?)\]]",
    ),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]\d)(?!\d)"),
    ("ip6", rf"(?<![\w:.])(?=[A-Fa-f:]{{0,39}}\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,5}})?::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![\w:])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    (
        "plain",
        rf"(?<![\w.,+-])(?:{_YEAR}(?<dash>[-./]){_MONTH}\k<dash>{_DAY}{_CLOCK}|{_DAY}(?<dot>[-./]){_DAY}\k<dot>(?:{_YEAR}|\d\d(?=[^\d.-]|$)){_CLOCK}|{_YEAR}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?:[T _-]?(?:[01]\d|2[0-3])(?:[0-5]\d){{1,2}})?"
        r"|[1-9]\d?(?<group>[ ,.\u00A0\u202F])\d{3}(?:\k<group>\d{3}){1,6}|[1-9]\d{2}(?<wide>[,\u00A0\u202F])\d{3}(?:\k<wide>\d{3}){1,6}|(?:0|[1-9]\d{0,8})\.\d{5,30}|\d{1,8}|1\d{9})(?!\w|[ .-]?\(?\d)",
    ),
    ("card", r"(?<![\w-])(?:\d{13,19}|\d{4}(?<gap>[ -])\d{4}\k<gap>\d{4}\k<gap>\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])"),
    ("phone", r"(?<![\w+])\+?\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w)"),
)
#: Any capitalised word, or a lone capital before a full stop: names are looked up among the document's own.
NAME = ("name", r"(?<!\p{L})\p{Lu}(?:\p{L}{1,60}|(?=\.))(?!\p{L})")


def _all(patterns: tuple[tuple[str, str], ...]) -> str:
    return "(?U)" + "|".join(f"(?<{kind}>{p})" for kind, p in patterns)


def names(text: Column) -> Column:
    """Words of the names of a text as ``array<struct<word, role>>``; the role is a gender (given name; n: not told), - (surname) or i (initial)."""
    given = lambda words: rf"^(?:{_any(words)})(?!\p{{L}})"

    def of(m: Column) -> Column:
        bare = F.regexp_replace(m, rf"(?U)^{_TITLE}", "")
        titled = lambda words: m.rlike(rf"(?U)^(?:{_any(words)})\.? ")
        gender = F.when(titled(FEMALE), "f").when(titled(MALE), "m").when(bare.rlike(given(WOMEN)), "f").when(bare.rlike(given(MEN)), "m").otherwise("n")
        tokens = F.split(bare, " ")

        def words(token: Column, i: Column) -> Column:
            found = F.regexp_extract_all(token, F.lit(r"\p{Lu}\p{L}*"), F.lit(0))
            return F.transform(found, lambda w: F.struct(F.lower(w).alias("word"), F.when(F.length(w) == 1, "i").when(i < F.size(tokens) - 1, gender).otherwise("-").alias("role")))

        return F.flatten(F.transform(tokens, words))

    found = F.regexp_extract_all(text, F.lit(f"(?U){_TITLED}"), F.lit(0))
    none = F.array().cast("array<struct<word:string,role:string>>")
    return F.coalesce(F.flatten(F.transform(found, of)), none)


def _groups(m: Column) -> Column:
    """The 32 hexadecimal digits of an address of version 6, whatever is left out in it."""
    halves = F.split(F.lower(m), "::", -1)
    part = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda x: x != "")
    left, right = part(0), part(1)
    return F.array_join(F.transform(F.concat(left, F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right)), right), lambda x: F.lpad(x, 4, "0")), "")


def canonical(kind: Column, m: Column) -> Column:
    """What mentions of one value have in common (names are handled by their words)."""
    bare = F.translate(F.regexp_replace(m, r"[^\p{L}\p{N}]", ""), DIGITS, "0123456789" * (len(DIGITS) // 10))
    return F.when(kind == "email", F.lower(m)).when(kind == "ip6", _groups(m)).when(kind.isin("ip", "secret", "name"), m).when(kind == "iban", F.upper(bare)).otherwise(bare)


def _digest(*parts: Column | str) -> Column:
    """192 hex digits that depend on the parts."""
    seed = F.concat_ws("\x1f", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.concat(*[F.sha2(F.concat(F.lit(f"{i}\x1f"), seed), 256) for i in range(3)])


def _number(digest: Column, i: Column | int) -> Column:
    """The i-th number 0..65535 of a digest, around and around."""
    at = (F.lit(i) if isinstance(i, int) else i) % 48 * 4 + 1
    return F.conv(F.substr(digest, at, F.lit(4)), 16, 10).cast("int")


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is written and computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _feistel(cells: Column, seed: Column) -> Column:
    """A keyed permutation of ``array<struct<c, m, ...>>``: every ``c`` stays within 0..m-1, and distinct arrays stay distinct.

    In each round the codes of one half, through a digest, shift those of the other.
    """

    def step(s: Column, k: Column) -> Column:
        digest = _digest(seed, k.cast("string"), F.array_join(F.transform(s.x, lambda e: e.c.cast("string")), ","))
        moved = _once(digest, lambda v: F.transform(s.y, lambda e, i: e.withField("c", (e.c + _number(v, i)) % e.m)))
        return F.struct(moved.alias("x"), s.x.alias("y"))

    def halves(c: Column) -> Column:
        half = F.shiftright(F.size(c), 1)
        start = F.struct(F.slice(c, 1, half).alias("x"), F.slice(c, half + 1, F.size(c) - half).alias("y"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s.x, s.y))

    return _once(cells, halves)


def _alike(value: Column, seed: Column) -> Column:
    """Each letter and digit of ``value`` replaced by one of its kind (hexadecimal stays hexadecimal); distinct for distinct values of one seed and shape."""

    def cell(ch: Column, hexadecimal: Column) -> Column:
        n = F.ascii(ch)
        digit, upper, lower = ch.rlike("^[0-9]$"), ch.rlike("^[A-Z]$"), ch.rlike("^[a-z]$")
        code = F.when(hexadecimal, F.conv(ch, 16, 10).cast("int")).when(digit, n - 48).when(upper, n - 65).when(lower, n - 97)
        size = F.when(hexadecimal, 16).when(digit, 10).when(upper | lower, 26)
        first = F.lit(0)
        for a, z in LETTERS:
            inside = n.between(a, z)
            code, size, first = code.when(inside, n - a), size.when(inside, z - a + 1), F.when(inside, a).otherwise(first)
        known = F.when(digit & ~hexadecimal, "d").when(upper, "u").when(hexadecimal, "h").when(lower, "l").when(n > 127, F.when(first > 0, "w").otherwise("")).otherwise("")
        return F.struct(code.otherwise(0).alias("c"), size.otherwise(1).alias("m"), known.alias("k"), ch.alias("s"), first.alias("b"))

    def shown(e: Column) -> Column:
        return F.when(e.k == "d", F.chr(e.c + 48)).when(e.k == "u", F.chr(e.c + 65)).when(e.k == "l", F.chr(e.c + 97)).when(e.k == "h", F.lower(F.hex(e.c))).when(e.k == "w", F.decode(F.unhex(F.lpad(F.hex(e.c + e.b), 4, "0")), "UTF-16BE")).otherwise(e.s)

    cells = _once(value.rlike("^(?=.*[a-f])[0-9a-f]{16,}$"), lambda h: F.transform(F.filter(F.split(value, ""), lambda ch: ch != ""), lambda ch: cell(ch, h)))
    return F.array_join(F.transform(_feistel(cells, seed), shown), "")


def _mod97(digits: Column) -> Column:
    """Remainder modulo 97 of a decimal string, letters counting as 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: F.when(c.rlike("[0-9]"), acc * 10 + value(c)).otherwise(acc * 100 + value(c)) % 97
    return F.aggregate(F.filter(F.split(digits, ""), lambda c: c != ""), F.lit(0), step)


def _address(value: Column, attempt: Column, seed: Column) -> Column:
    """Private addresses stay private, others stay unicast; the octets are permuted."""
    o = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    first, second = F.get(o, F.lit(0)), F.get(o, F.lit(1))
    small = (first == 192) & (second == 168) | (first == 172) & second.between(16, 31)
    private = first.isin(10, 127) | small
    cell = lambda c, m, base: F.struct(c.cast("int").alias("c"), m.cast("int").alias("m"), base.cast("int").alias("b"))
    lit = F.lit
    whole = lambda x: cell(x, lit(256), lit(0))
    wide = F.when(attempt >= ROOMY, F.array(cell(lit(0), lit(1), lit(10)), whole(second)))  # 10.0.0.0/8
    held = (
        F.when(small, F.coalesce(wide, F.array(cell(lit(0), lit(1), first), F.when(first == 192, cell(lit(0), lit(1), lit(168))).otherwise(cell(second - 16, lit(16), lit(16))))))
        .when(private & (attempt < ROOMY), F.array(cell(lit(0), lit(1), first), whole(second)))
        .otherwise(F.array(F.when(first.between(1, 223), cell(first - 1, lit(223), lit(1))).when(first >= 224, cell(first - 224, lit(32), lit(224))).otherwise(cell(lit(0), lit(1), lit(0))), whole(second)))
    )
    cells = F.concat(held, F.transform(F.slice(o, 3, 2), whole))
    four = F.array_join(F.transform(_feistel(cells, seed), lambda e: (e.c + e.b).cast("string")), ".")
    d = _digest("ipv6", seed, value)
    six = F.concat(F.lit("2001:db8:"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.lower(F.hex(_number(d, i)))), ":"))
    return F.when(attempt < 2 * ROOMY, four).otherwise(six)


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The replacement of a canonical value."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"))
    domain = F.substring_index(value, "@", -1)
    host = _alike(F.regexp_replace(domain, r"\.[^.]+$", ""), F.concat_ws("\x1f", F.lit(key), F.lit("domain"), F.substring_index(domain, ".", -1)))
    more = _digest("more", seed, value)
    extra = F.when(attempt < ROOMY, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), attempt - ROOMY), lambda i: (_number(more, i) % 10).cast("string")), ""))
    # one permutation serves all formats: the part of the value that is free to change
    valid_card = (kind == "card") & F.call_function("luhn_check", value)
    free = F.when(kind == "email", F.substring_index(value, "@", 1)).when(valid_card, F.substr(value, F.lit(1), F.length(value) - 1)).when(kind == "iban", F.substr(value, F.lit(5)))
    prefix = F.regexp_extract(value, f"^(?:{'|'.join(KEYS)})", 0)
    free = free.when(kind == "ip6", F.substr(value, F.lit(9))).when(kind == "secret", F.substr(value, F.length(prefix) + 1)).otherwise(value)
    country = F.substring(value, 1, 2)

    def finished(body: Column) -> Column:
        email = F.concat(body, F.when(attempt > 0, attempt.cast("string")).otherwise(""), F.lit("@"), host, F.lit(".example"))
        check = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: F.concat(body, x.cast("string"))), lambda x: F.call_function("luhn_check", x))[0]
        iban = F.concat(country, F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0"), body)
        return F.when(kind == "email", email).when(valid_card, check).when(kind == "iban", iban).when(kind == "ip6", F.concat(F.lit("20010db8"), F.substring(body, 1, 24))).when(kind == "secret", F.concat(prefix, body)).otherwise(body)

    return F.when(kind == "ip", _address(value, attempt, seed)).when(kind == "name", _named(value, key, attempt)).otherwise(_once(F.concat(_alike(free, seed), extra), finished))


def _named(value: Column, key: str, attempt: Column) -> Column:
    """An invented name in the script of the original (``role word``), a given name with the gender's ending; an initial is a letter."""
    role, word = F.substring(value, 1, 1), F.substr(value, F.lit(3))
    digest = _digest(key, "name", F.when(role == "-", "").otherwise(role), F.lower(word), attempt.cast("string"))
    by_script = lambda of: F.when(word.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(word.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))
    pool = by_script(lambda s: F.array(*[F.lit(x) for x in SYLLABLES[s]]))
    ending = F.when(role == "f", by_script(lambda s: F.lit(ENDINGS[s][1]))).when(role == "m", by_script(lambda s: F.lit(ENDINGS[s][0]))).otherwise("")
    made = _once(pool, lambda p: _once(digest, lambda d: F.array_join(F.transform(F.sequence(F.lit(0), attempt + 2), lambda k: F.get(p, _number(d, k) % F.size(p))), "")))
    name = F.initcap(F.concat(made, ending))
    return F.when(role == "i", F.substring(name, 1, 1)).otherwise(name)


def _formatted(kind: Column, match: Column, new: Column) -> Column:
    """The surrogate with the separators (or the capitals) of this mention; what it is longer goes to the end."""
    spaced = F.transform(F.split(match, ""), lambda c, i: F.when(c.rlike(r"[\p{L}\p{N}]"), F.substr(new, F.length(F.regexp_replace(F.substr(match, F.lit(1), i), r"[^\p{L}\p{N}]", "")) + 1, F.lit(1))).otherwise(c))
    spaced = F.concat(F.array_join(spaced, ""), F.substr(new, F.length(F.regexp_replace(match, r"[^\p{L}\p{N}]", "")) + 1))
    loud = (F.length(match) > 1) & (F.upper(match) == match)
    groups = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substr(new, i * 4 + 1, F.lit(4)), "^0{1,3}", "")), ":")
    return F.when(kind == "ip6", groups).when(kind.isin("email", "ip", "secret"), new).when(kind == "name", F.when(loud, F.upper(new)).otherwise(new)).otherwise(spaced)


def searched(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__pieces`` (gaps and marked matches in turn), ``__names``, ``__row`` and ``__h``, the one pass over the texts; as a written table."""
    column = F.col(f"`{text}`")
    df = docs.withColumn("__h", F.lower(F.hex(F.xxhash64(column)))).withColumn("__names", names(column))
    outer, inner = _marks(F.col("__h"))
    named = F.size("__names") > 0
    template = lambda kinds: F.concat(outer, *[x for k, _ in kinds for x in (F.lit("${" + k + "}"), inner)], outer)
    mark = lambda kinds: F.regexp_replace(column, F.lit(_all(kinds)), template(kinds))
    marked = F.when(named, mark((*PATTERNS, NAME))).otherwise(mark(PATTERNS))
    hit = named | F.contains(column, F.lit("@")) | column.rlike(r"\p{Nd}")
    pieces = F.when(hit, F.split(marked, outer, -1)).otherwise(F.array(column))
    return written(df.withColumn("__pieces", pieces).withColumn("__row", F.monotonically_increasing_id()).drop(text), "searched")


def _marks(h: Column) -> tuple[Column, Column]:
    """Separators of matches and of kinds; a text cannot hold those of its own hash but by chance."""
    return F.concat(F.lit("\x01"), h, F.lit("\x01")), F.concat(F.lit("\x02"), h, F.lit("\x02"))


def _ordinary(word: Column, p: Column, inner: Column) -> Column:
    """Whether a capitalised word is no name where it stands: before a word of places, or an everyday word that begins a sentence about something else."""
    bare = lambda piece: F.coalesce(F.array_join(F.split(piece, inner, -1), ""), F.lit(""))
    place = (p.after == " ") & bare(p.next).isin(*PLACES)
    last = bare(p.last)
    abbreviated = p.before.startswith(".") & (last.isin(*MALE, *FEMALE, *NEUTRAL, *DEGREES) | (F.length(last) == 1))
    starts = ((p.last.isNull() & p.before.rlike(r"^\s*$")) | p.before.rlike(r"[.!?][\"')\]]*\s+$|\n\s*$")) & ~abbreviated
    goes_on = p.after.rlike(rf"^ (?!(?:{'|'.join(VERBS)})(?!\p{{L}}))\p{{Ll}}")
    return F.coalesce(place | (starts & goes_on & F.lower(word).isin(*EVERYDAY)), F.lit(False))


def mentions(found: DataFrame) -> DataFrame:
    """Mentions of a searched table in order: ``__row``, ``i``, kind, match, value, and ``rest``, what follows the value inside the match; as a written table."""
    _, inner = _marks(F.col("__h"))
    around = F.transform("__pieces", lambda p, i: F.when(i % 2 == 1, F.struct(F.split(p, inner, -1).alias("parts"), *[F.get("__pieces", i + k).alias(n) for n, k in (("last", -2), ("before", -1), ("after", 1), ("next", 2))])))
    each = found.where(F.size("__pieces") > 1).select("__row", "__h", F.posexplode(around).alias("i", "p")).where("i % 2 = 1")
    kind = F.element_at(F.array(*[F.lit(k) for k, _ in (*PATTERNS, NAME)]), F.array_position(F.transform("p.parts", lambda x: x != ""), F.lit(True)).cast("int"))
    each = each.select("__row", "__h", "i", "p", kind.alias("kind"), F.array_join("p.parts", "").alias("match")).where("kind <> 'plain'")
    each = each.where((F.col("kind") != "name") | ~_ordinary(F.col("match"), F.col("p"), inner)).drop("p", "__h")
    plain = each.where("kind <> 'name'").select("__row", "i", "kind", "match", canonical(F.col("kind"), F.col("match")).alias("value"), F.lit("").alias("rest"))
    own = found.where(F.size("__names") > 0).select("__row", F.explode("__names").alias("n")).groupBy("__row", F.col("n.word").alias("word")).agg(F.min("n.role").alias("role"))
    low = F.lower("match")
    words = F.array_distinct(F.array(low, F.regexp_replace(low, "s$", "")))
    looked = each.where("kind = 'name'").select("__row", "i", "match", F.explode(words).alias("word")).join(own, ["__row", "word"])
    best = looked.groupBy("__row", "i", "match").agg(F.max(F.struct(F.length("word").alias("n"), "word", "role")).alias("w"))
    named = best.select("__row", "i", F.lit("name").alias("kind"), F.substr("match", F.lit(1), F.col("w.n")).alias("match"), F.concat("w.role", F.lit(" "), "w.word").alias("value"), F.substr("match", F.col("w.n") + 1).alias("rest"))
    return written(plain.unionByName(named), "mentions")


def drawn(values: DataFrame, key: str) -> DataFrame:
    """kind, value, attempt, new for the distinct ``values`` (kind, value): no two with one surrogate, none that is a value.

    Every attempt beyond ``ROOMY`` has a larger space than the last, so the rounds end.
    """
    new = surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)
    own = F.when(F.col("kind") == "name", F.substr("value", F.lit(3))).otherwise(F.col("value"))
    real = values.select("kind", own.alias("own")).distinct()
    wide = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be merged into one task
    spread = lambda df: df.repartition(wide, "kind", "value").withColumn("new", new)
    table = written(spread(values.withColumn("attempt", F.lit(0))), "surrogates")
    while True:
        holder = F.min(F.struct(F.xxhash64("value"), "value"))
        shared = table.groupBy("kind", "new").agg(F.count("*").alias("n"), holder.getField("value").alias("holder")).where("n > 1")
        lost = table.join(shared, ["kind", "new"]).where(F.col("value") != F.col("holder")).select("kind", "value")
        shown = F.when(F.col("kind") == "name", F.lower("new")).otherwise(F.col("new"))
        taken = table.withColumn("own", shown).join(real, ["kind", "own"], "left_semi").select("kind", "value")
        again = written(lost.union(taken).distinct(), "collisions")
        if again.isEmpty():
            return table
        moved = table.join(again.withColumn("again", F.lit(1)), ["kind", "value"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0)))
        table = written(spread(moved.select("kind", "value", "attempt")), "surrogates")


def replace_entities(docs: DataFrame, key: str = "surrogates-v1", text: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with every entity in ``text`` replaced; with ``counts`` also ``n_entities`` and ``n_distinct``."""
    own = [f"__own{i}" for i in range(len(docs.columns))]  # so that no column is taken for one of these
    at = own[docs.columns.index(text)]
    found = searched(docs.toDF(*own), at)
    each = mentions(found)
    initial = (F.col("kind") == "name") & F.col("value").startswith("i ")
    table = drawn(each.where(~initial).select("kind", "value").distinct(), key)
    letters = each.where(initial).select("kind", "value").distinct().select("kind", "value", _named(F.col("value"), key, F.lit(0)).alias("new"))
    new = each.join(table.select("kind", "value", "new").union(letters), ["kind", "value"])
    new = new.select("__row", "i", F.concat_ws(":", "kind", "value").alias("value"), F.concat(_formatted(F.col("kind"), F.col("match"), F.col("new")), "rest").alias("new"))
    lists = new.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("i", "new"))).alias("__new"), F.count("*").alias("__n"), F.count_distinct("value").alias("__distinct"))
    pieces, inner = F.col("__pieces"), _marks(F.col("__h"))[1]
    hit = found.where(F.size("__pieces") > 1).join(lists, "__row", "left")
    unmarked = lambda p: F.array_join(F.split(p, inner, -1), "")
    spliced = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 0, p).otherwise(F.coalesce(F.element_at("__new", i), unmarked(p)))), "")
    missed = found.where(F.size("__pieces") == 1)
    shape = lambda new_text, extra: [*[new_text.alias(c) if o == at else F.col(o).alias(c) for o, c in zip(own, docs.columns, strict=True)], *(extra if counts else [])]
    number = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    zero = [F.lit(0).cast("long").alias("n_entities"), F.lit(0).cast("long").alias("n_distinct")]
    return missed.select(*shape(pieces[0], zero)).union(hit.select(*shape(spliced, [number(F.col("__n"), "n_entities"), number(F.col("__distinct"), "n_distinct")])))
