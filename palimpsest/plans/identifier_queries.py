"""Registered queries over national numbers, telephone numbers and mail suffixes; the SQL restates each rule in its own way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, identifiers, phones, spans, suffixes
from .queries import dealt, register, span_sql, table

# ---- national numbers
#: Digits of the numbers that are made from a key; the last character of some is a letter.
_DIGITS = {
    "NL_BSN": 9, "UK_NHS": 10, "US_ABA": 9, "CA_SIN": 9, "DE_TAX_ID": 11, "IT_VAT": 11, "FR_NIR": 15, "BE_NN": 11, "PT_NIF": 9, "PL_PESEL": 11, "SE_PERSONNUMMER": 10, "NO_FNR": 11, "CH_AHV": 13, "AU_TFN": 9, "AU_ABN": 11, "AU_MEDICARE": 10, "BR_CPF": 11,
    "ES_NIF": 8, "FI_HETU": 9,
}
_LETTERS = {"ES_NIF": "TRWAGMYFPDXBNJZSQVHLCKE", "FI_HETU": "0123456789ABCDEFHJKLMNPRSTUVWXY"}
#: The weighted sums, told again for the SQL: weights, modulus, offset, letters by remainder, place of the check character (0: none).
_SUMS = """('NL_BSN', [9, 8, 7, 6, 5, 4, 3, 2, -1], 11, 0, '', 0), ('UK_NHS', [10, 9, 8, 7, 6, 5, 4, 3, 2, 0], 11, 0, '0-987654321', 10), ('US_ABA', [3, 7, 1, 3, 7, 1, 3, 7, 1], 10, 0, '', 0),
('FR_NIR', [50, 5, 49, 34, 81, 76, 27, 90, 9, 30, 3, 10, 1, 10, 1], 97, 0, '', 0), ('PT_NIF', [9, 8, 7, 6, 5, 4, 3, 2, 0], 11, 0, '00987654321', 9), ('PL_PESEL', [1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1], 10, 0, '', 0),
('NO_FNR', [3, 7, 6, 1, 8, 9, 4, 5, 2, 1, 0], 11, 0, '', 0), ('NO_FNR', [5, 4, 3, 2, 7, 6, 5, 4, 3, 2, 1], 11, 0, '', 0), ('CH_AHV', [1, 3, 1, 3, 1, 3, 1, 3, 1, 3, 1, 3, 1], 10, 0, '', 0), ('AU_TFN', [1, 4, 3, 7, 5, 8, 6, 9, 10], 11, 0, '', 0),
('AU_ABN', [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19], 89, -10, '', 0), ('AU_MEDICARE', [1, 3, 7, 9, 1, 3, 7, 9, 0, 0], 10, 0, '0123456789', 9), ('BR_CPF', [10, 9, 8, 7, 6, 5, 4, 3, 2, 0, 0], 11, 0, '00987654321', 10), ('BR_CPF', [11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 0], 11, 0, '00987654321', 11)"""


def _candidates_sql() -> str:
    kinds = ", ".join(f"('{k}', {n}, '{_LETTERS.get(k, '')}')" for k, n in _DIGITS.items())
    return f"""k(name, n, letters) AS (VALUES {kinds}),
v AS (SELECT c_custkey, name, n, lpad(CAST(CAST(c_custkey AS HUGEINT) * 1000003 * (n + 7919) % CAST(10 AS HUGEINT) ** n AS HUGEINT)::VARCHAR, n, '0') || CASE WHEN letters = '' THEN '' ELSE letters[c_custkey % length(letters) + 1] END AS value FROM customer, k)"""


def _candidate(name: str) -> Column:
    n = _DIGITS[name]
    number = (F.col("c_custkey").cast("decimal(20,0)") * F.lit(1000003 * (n + 7919)).cast("decimal(18,0)")) % F.lit(str(10**n)).cast("decimal(16,0)")
    value = F.lpad(number.cast("decimal(16,0)").cast("string"), n, "0")
    if letters := _LETTERS.get(name):
        value = F.concat(value, F.substr(F.lit(letters), (F.col("c_custkey") % len(letters) + 1).cast("int"), F.lit(1)))
    return value


@register(f"""WITH {_candidates_sql()},
w(name, weights, modulus, more, letters, place) AS (VALUES {_SUMS}),
s AS (SELECT c_custkey, v.name, value, bool_and(CASE WHEN place = 0 THEN r = 0 ELSE letters[r + 1] = value[place] END) AS valid FROM
  (SELECT c_custkey, v.name, value, letters, place, CAST((((list_sum([CAST(value[i] AS BIGINT) * weights[i] FOR i IN range(1, n + 1)]) + more) % modulus) + modulus) % modulus AS INTEGER) AS r FROM v JOIN w ON v.name = w.name) v GROUP BY ALL),
l AS (SELECT c_custkey, name, value, list_sum([CASE WHEN (n - i) % 2 = 1 THEN 2 * CAST(value[i] AS INTEGER) - CASE WHEN value[i] > '4' THEN 9 ELSE 0 END ELSE CAST(value[i] AS INTEGER) END FOR i IN range(1, n + 1)]) % 10 = 0 AS valid FROM v WHERE name IN ('CA_SIN', 'IT_VAT', 'SE_PERSONNUMMER')),
h AS (SELECT c_custkey, name, value, (11 - list_reduce([CAST(10 AS BIGINT)] || [CAST(value[i] AS BIGINT) FOR i IN range(1, n)], lambda c, d: (CASE WHEN (c + d) % 10 = 0 THEN 20 ELSE (c + d) % 10 * 2 END) % 11)) % 10 = CAST(value[n] AS BIGINT) AS valid FROM v WHERE name = 'DE_TAX_ID'),
b AS (SELECT c_custkey, name, value, CAST(value[1:9] AS BIGINT) % 97 + CAST(value[10:] AS BIGINT) IN (97, 97 * 2) OR (CAST(value[1:9] AS BIGINT) + 2000000000) % 97 + CAST(value[10:] AS BIGINT) IN (97, 97 * 2) OR
  (CAST(value[10:] AS BIGINT) = 0 AND (CAST(value[1:9] AS BIGINT) % 97 = 0 OR (CAST(value[1:9] AS BIGINT) + 2000000000) % 97 = 0)) AS valid FROM v WHERE name = 'BE_NN'),
a AS (SELECT c_custkey, name, value, CASE name WHEN 'ES_NIF' THEN 'TRWAGMYFPDXBNJZSQVHLCKE'[CAST(value[1:8] AS BIGINT) % 23 + 1] ELSE '0123456789ABCDEFHJKLMNPRSTUVWXY'[CAST(value[1:9] AS BIGINT) % 31 + 1] END = value[-1] AS valid FROM v WHERE name IN ('ES_NIF', 'FI_HETU'))
SELECT c_custkey, name, value, valid AND NOT (name = 'BR_CPF' AND replace(value, value[1], '') = '') AS valid FROM (SELECT * FROM s UNION ALL SELECT * FROM l UNION ALL SELECT * FROM h UNION ALL SELECT * FROM b UNION ALL SELECT * FROM a)""")
def country_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check characters of nineteen kinds of national numbers, made from every customer's key."""
    each = [F.struct(F.lit(name).alias("name"), _candidate(name).alias("value")) for name in _DIGITS]
    keys = dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    rows = keys.select("c_custkey", F.explode(F.array(*each)).alias("x")).select("c_custkey", "x.*")
    valid = F.coalesce(*[F.when(F.col("name") == name, identifiers.IDENTIFIERS[name].valid(F.col("value"))) for name in _DIGITS])
    return rows.withColumn("valid", valid)


@register(rf"""WITH f AS (SELECT doc_id, value, start, [CAST(x AS BIGINT) FOR x IN regexp_extract_all(value, '[0-9]')] AS d FROM {span_sql("documents", "doc_id", "text", r"[0-9]{3}[- ]?[0-9]{3}[- ]?[0-9]{4}", "X")}),
s AS (SELECT *, 11 - list_sum([d[i] * (11 - i) FOR i IN range(1, 10)]) % 11 AS c FROM f)
SELECT doc_id, value, start, CASE WHEN c = 11 THEN 0 ELSE c END = d[10] AS valid FROM s""")
def health_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of ten digits in the documents, and whether it has a health number's check digit."""
    hits = table(spark, sf_dir, "documents").select("doc_id", F.explode(spans.found(F.col("text"), r"[0-9]{3}[- ]?[0-9]{3}[- ]?[0-9]{4}")).alias("m"))
    return hits.select("doc_id", "m.value", "m.start", checks.CHECKS["UK_NHS"](F.col("m.value")).alias("valid"))


# ---- telephone numbers
_CODES = tuple(p.code for p in phones.PLANS.values())


def _plan_sql() -> str:
    rows = [(region, plan.code, prefix, list(lengths), plan.trunk) for region, plan in phones.PLANS.items() for prefix, lengths in phones.prefixes(plan).items()]
    return "(VALUES " + ", ".join(f"('{r}', '{c}', '{p}', {n or '[]'}::INTEGER[], '{t}')" for r, c, p, n, t in rows) + ")"


_NATIONAL = ", ".join(f"'{r}'" for r in phones.REGIONS)


@register(f"""WITH p(region, code, prefix, lengths, trunk) AS {_plan_sql()},
d AS (SELECT c_custkey, lpad(CAST(CAST(c_custkey AS HUGEINT) * 7919000023 % 1000000000000 AS VARCHAR), 12, '0') AS d, [{', '.join(f"'{c}'" for c in _CODES)}][c_custkey % {len(_CODES)} + 1] AS code FROM customer),
v AS (SELECT c_custkey, unnest([{{'kind': 'abroad', 'value': '+' || code || d[3:c_custkey % 5 + 9]}}, {{'kind': 'home', 'value': '0' || d[3:c_custkey % 4 + 9]}}, {{'kind': 'bare', 'value': d[3:12]}}, {{'kind': 'raw', 'value': concat_ws('-', d[1:2], d[3:5], d[6:8], d[9:12])}}], recursive := true) FROM d),
c AS (SELECT DISTINCT c_custkey, kind, region, CASE WHEN abroad IS NOT NULL THEN abroad[length(code) + 1:] WHEN trunk = '0' THEN digits[2:] WHEN trunk = '1' AND digits[1] = '1' AND length(digits) = 11 THEN digits[2:] ELSE digits END AS number
      FROM (SELECT *, CASE WHEN kind = 'abroad' THEN digits WHEN starts_with(digits, '00') THEN digits[3:] END AS abroad FROM (SELECT *, replace(replace(value, '-', ''), '+', '') AS digits FROM v)), (SELECT DISTINCT region, code, trunk FROM p)
      WHERE CASE WHEN abroad IS NOT NULL THEN starts_with(abroad, code) ELSE region IN ({_NATIONAL}) AND (trunk <> '0' OR starts_with(digits, '0')) END),
l AS (SELECT c_custkey, kind, region, number, arg_max(lengths, length(prefix)) AS lengths FROM c JOIN p USING (region) WHERE starts_with(number, prefix) GROUP BY ALL),
g AS (SELECT c_custkey, kind, bool_or(list_contains(lengths, length(number)) AND (region <> 'US' OR number[4] >= '2')) AS valid FROM l GROUP BY ALL)
SELECT v.c_custkey, v.kind, v.value, coalesce(valid, false) AS valid FROM v LEFT JOIN g USING (c_custkey, kind)""")
def phone_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbering plans over numbers made from every customer's key: international, with a 0 before them, bare, and in groups."""
    number = (F.col("c_custkey").cast("decimal(20,0)") * F.lit("7919000023").cast("decimal(18,0)")) % F.lit("1000000000000").cast("decimal(16,0)")
    d = F.lpad(number.cast("decimal(16,0)").cast("string"), 12, "0")
    code = F.get(F.array(*map(F.lit, _CODES)), (F.col("c_custkey") % len(_CODES)).cast("int"))
    part = lambda n: F.substr(F.col("d"), F.lit(3), n.cast("int"))
    kinds = {
        "abroad": F.concat(F.lit("+"), F.col("code"), part(F.col("c_custkey") % 5 + 7)),
        "home": F.concat(F.lit("0"), part(F.col("c_custkey") % 4 + 7)),
        "bare": part(F.lit(10)),
        "raw": F.concat_ws("-", *[F.substring("d", a, n) for a, n in ((1, 2), (3, 3), (6, 3), (9, 4))]),
    }
    rows = dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select("c_custkey", d.alias("d"), code.alias("code"))
    each = rows.select("c_custkey", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()])).alias("x")).select("c_custkey", "x.*")
    return each.withColumn("valid", phones.valid(F.col("value")))


# ---- mail suffixes
_ENDS = ("com", "co.uk", "uk", "ck", "shop.ck", "www.ck", "kawasaki.jp", "city.kawasaki.jp", "x.kawasaki.jp", "invalidsuffix", "com.au", "gov.br", "x.np", "example")
_RULES = ", ".join(f"('{r}')" for r in suffixes.COMMON.rules)


@register(f"""WITH e AS (SELECT o_orderkey, [{', '.join(f"'{x}'" for x in _ENDS)}][o_orderkey % {len(_ENDS)} + 1] AS ending, o_orderkey % 3 AS more FROM orders),
d AS (SELECT o_orderkey, CASE more WHEN 0 THEN ending WHEN 1 THEN 'h' || CAST(o_orderkey AS VARCHAR) || '.' || ending ELSE 'mail.H' || CAST(o_orderkey AS VARCHAR) || '.' || ending END AS domain FROM e),
r(rule) AS (VALUES {_RULES}),
n AS (SELECT o_orderkey, domain, string_split(lower(domain), '.') AS labels FROM d),
k AS (SELECT o_orderkey, len(labels) AS n, unnest(range(1, len(labels) + 1)) AS k, labels FROM n),
s AS (SELECT o_orderkey, n, k, array_to_string(labels[n - k + 1:], '.') AS tail, array_to_string(['*'] || labels[n - k + 2:], '.') AS wild FROM k),
m AS (SELECT o_orderkey, max(CASE WHEN rule = tail OR (rule = wild AND k > 1) THEN k END) AS plain, max(CASE WHEN rule = '!' || tail THEN k - 1 END) AS excepted, any_value(n) AS n FROM s JOIN r ON rule = tail OR rule = '!' || tail OR rule = wild GROUP BY o_orderkey)
SELECT d.o_orderkey, domain, CAST(coalesce(excepted, plain, 0) AS INTEGER) AS suffix_labels, coalesce(n > coalesce(excepted, plain), false) AS registrable FROM d LEFT JOIN m USING (o_orderkey)""")
def mail_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public suffix of a domain made from every order's key."""
    ending = F.get(F.array(*map(F.lit, _ENDS)), (F.col("o_orderkey") % len(_ENDS)).cast("int"))
    key, more = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 3
    domain = F.when(more == 0, ending).when(more == 1, F.concat(F.lit("h"), key, F.lit("."), ending)).otherwise(F.concat(F.lit("mail.H"), key, F.lit("."), ending))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", domain.alias("domain"))
    return rows.select("o_orderkey", "domain", suffixes.COMMON.size(F.col("domain")).alias("suffix_labels"), suffixes.COMMON.registrable(F.col("domain")).alias("registrable"))
