"""Check characters, numbering plans and public suffixes against published examples and plain second implementations."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest import policy as P
from palimpsest.functions import identifiers, phones, suffixes
from palimpsest.functions.checks import CHECKS
from palimpsest.operators import detect
from palimpsest.plans import identifier_queries, queries

# published or well-known examples
VALID = [
    ("NL_BSN", "111222333"), ("UK_NHS", "943 476 5919"), ("UK_NHS", "943-476-5870"), ("US_ABA", "021000021"), ("US_ABA", "1210-0024-8"), ("CA_SIN", "046 454 286"), ("DE_TAX_ID", "86 095 742 719"), ("DE_TAX_ID", "47036892816"),
    ("DE_VAT", "DE136695976"), ("DE_ID_CARD", "T220001293"), ("ES_NIF", "12345678Z"), ("ES_NIF", "54362315-K"), ("ES_NIE", "X1234567L"), ("ES_NIE", "X-2482300-W"), ("IT_FISCAL_CODE", "RSSMRA85T10A562S"), ("IT_VAT", "IT 00743110157"),
    ("FR_NIR", "2 55 08 14 168 025 38"), ("BE_NN", "85.07.30-033.28"), ("PT_NIF", "123456789"), ("PL_PESEL", "44051401359"), ("FI_HETU", "131052-308T"), ("SE_PERSONNUMMER", "811218-9876"), ("NO_FNR", "151086 95088"),
    ("CH_AHV", "756.9217.0769.85"), ("AU_TFN", "123 456 782"), ("AU_ABN", "51 824 753 556"), ("AU_MEDICARE", "2123 45670 1"), ("SG_NRIC", "S1234567D"), ("IN_AADHAAR", "2341 2341 2346"), ("BR_CPF", "111.444.777-35"),
]


def asked(spark, check, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", check(F.col("v")).alias("x")).collect()
    return [r.x for r in sorted(rows)]


def test_published_numbers_are_valid_and_one_wrong_character_is_not(spark):
    r = random.Random(1)
    kinds = {}
    for name, value in VALID:
        wrong = set()
        places = [i for i, c in enumerate(value) if c.isdigit()]
        if name == "AU_MEDICARE":
            places = places[:-1]  # the last digit is the card's issue
        for i in places:
            wrong.add(value[:i] + r.choice([d for d in "0123456789" if d != value[i]]) + value[i + 1 :])
        kinds.setdefault(name, ([], []))
        kinds[name][0].append(value)
        kinds[name][1].extend(sorted(wrong))
    assert set(kinds) == set(identifiers.IDENTIFIERS)
    for name, (good, bad) in kinds.items():
        got = asked(spark, CHECKS[name], [*good, *bad, "", "x", None])
        assert all(got[: len(good)]), name
        # sums modulo ten miss a few single errors between digits of equal weight; none of these may be taken for valid more than rarely
        assert sum(map(bool, got[len(good) :])) <= len(bad) // 20, (name, [b for b, g in zip(bad, got[len(good) :], strict=False) if g])


def test_births_after_1999_and_corsica(spark):
    body = 17_073_003_3
    check = 97 - (2_000_000_000 + body) % 97
    assert asked(spark, CHECKS["BE_NN"], [f"{body}{check:02d}", f"{body}{(check + 1) % 97:02d}"]) == [True, False]
    for department, number in (("2A", "19"), ("2B", "18")):
        body = int(f"18505{number}168025")
        assert asked(spark, CHECKS["FR_NIR"], [f"1 85 05 {department} 168 025 {97 - body % 97:02d}"]) == [True]
    assert asked(spark, CHECKS["SG_NRIC"], ["T1234567J", "T1234567D"]) == [True, False]
    assert asked(spark, CHECKS["BR_CPF"], ["11111111111"]) == [False]


def test_country_rules_find_numbers_in_texts(spark):
    pol = P.Policy(analyzer_languages=("en", "de"), score_threshold=0.4)
    text = "dni 12345678Z, not 12345678A; codice RSSMRA85T10A562S; pesel 44051401359 or 44051401358"
    rows = spark.createDataFrame([(text,)], "t string").select(F.explode(detect.scored_rules(pol, ("ES", "IT", "PL"))(F.col("t"))).alias("s")).select("s.*").collect()
    got = {(r.entity_type, text[r.start : r.end]): r.score for r in rows if r.entity_type in ("NATIONAL_ID_NUMBER", "TAX_ID")}
    assert got == {("NATIONAL_ID_NUMBER", "12345678Z"): 0.85, ("TAX_ID", "RSSMRA85T10A562S"): 0.85, ("NATIONAL_ID_NUMBER", "44051401359"): 0.85}
    with pytest.raises(ValueError, match="XX"):
        detect.scored_rules(pol, ("XX",))


PHONES = {
    "US": (["+1 202-555-0143", "(212) 555-0100", "1 650 253 0000"], ["+1 911 555 0143", "+1 202 155 0143", "+1 202 555 014", "123-456-7890"]),
    "GB": (["+44 20 7946 0958", "020 7946 0958", "+44 7911 123456", "0161 496 0000"], ["+44 20 7946 095", "+44 6911 123456", "+44 7011"]),
    "DE": (["+49 30 901820", "030 901820", "+49 151 23456789", "0171 2345678"], ["+49 151 2345678", "+49 12 345678", "+49 0"]),
    "NL": (["+31 6 12345678", "06-12345678", "+31 20 794 0000", "0800 1234567"], ["+31 6 1234567", "+31 69 1234567", "+31 81 2345678 9"]),
    "FR": (["+33 1 70 18 99 00", "+33 6 12 34 56 78"], ["+33 1 70 18 99", "+33 83 12 34 56 7"]),
    "BE": (["+32 470 12 34 56", "+32 2 555 12 12"], ["+32 470 12 34 5", "+32 2 555 12 123"]),
    "ES": (["+34 912 345 678", "+34 612 345 678"], ["+34 512 345 678", "+34 91 234 567"]),
    "IT": (["+39 06 698 12345", "+39 312 345 6789"], ["+39 00 12345678", "+39 212 345 6789"]),
    "CH": (["+41 44 668 18 00", "+41 79 123 45 67"], ["+41 71 123 45", "+41 72 123 45 67"]),
    "AT": (["+43 1 58858", "+43 664 1234567"], ["+43 1 12", "+43 8 1234567"]),
    "IL": (["+972 50 234 5678", "050-234-5678"], ["+972 50 234 567"]),
    "IN": (["+91 98765 43210", "098765 43210"], ["+91 08765 43210", "+91 9876 4321"]),
    "BR": (["+55 11 96123 4567", "+55 11 2345 6789"], ["+55 11 6123 4567", "+55 01 2345 6789"]),
}


def test_numbers_of_each_plan_are_told_apart(spark):
    good = [v for x, _ in PHONES.values() for v in x]
    bad = [v for _, x in PHONES.values() for v in x]
    got = dict(zip([*good, *bad], asked(spark, phones.valid, [*good, *bad]), strict=True))
    assert [v for v in good if not got[v]] == [] and [v for v in bad if got[v]] == []
    regions = asked(spark, phones.region, [x[0][0] for x in PHONES.values()])
    # Switzerland's 71 numbers with too few digits and other plans do not overlap: calling codes are prefix-free
    assert regions == list(PHONES)


def test_dates_and_counts_are_no_numbers(spark):
    values = ["2023-01-15 10:30", "2023-01-15 10", "15.01.2023 1030", "01/15/2023", "2024 12 31 2359", "20240115 1030", "1 234 567 890", "1.234.567.890", "12 345 678", "0000000000", "3.14159265358", None]
    assert not any(asked(spark, phones.valid, values))


def test_the_trie_equals_a_longest_prefix_search(spark):
    r = random.Random(2)
    for region in ("DE", "BR", "BE", "US", "GB", "NL"):
        plan, known = phones.PLANS[region], phones.prefixes(phones.PLANS[region])
        numbers = ["".join(r.choice("0123456789") for _ in range(r.randrange(3, 14))) for _ in range(300)] + [p + "5" * k for p in known for k in range(4, 10)][:600]

        def brute(n):
            best = max((p for p in known if n.startswith(p)), key=len, default=None)
            return best is not None and len(n) in known[best] and (not plan.middle or n[3:4] >= "2")

        got = [x.x for x in spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "i int, n string").orderBy("i").select(F.col("n").rlike(f"^(?:{phones.pattern(region)})$").alias("x")).collect()]
        assert got == [brute(n) for n in numbers], region
        assert any(got) and not all(got)


def test_suffixes_wildcards_and_exceptions(spark):
    values = {
        "example.com": 1, "a.b.example.com": 1, "com": 1, "example.co.uk": 2, "co.uk": 2, "uk": 1, "bbc.uk": 1, "x.ck": 2, "a.x.ck": 2, "www.ck": 1, "a.www.ck": 1, "ck": 0, "city.kawasaki.jp": 2, "x.kawasaki.jp": 3,
        "a.x.kawasaki.jp": 3, "kawasaki.jp": 1, "example.invalidsuffix": 0, "EXAMPLE.CO.UK.": 2, "a..com": 0, "": 0, ".com": 0,
    }
    assert dict(zip(values, asked(spark, suffixes.COMMON.size, list(values)), strict=True)) == values
    registrable = dict(zip(values, asked(spark, suffixes.COMMON.registrable, list(values)), strict=True))
    assert [v for v in values if registrable[v]] == ["example.com", "a.b.example.com", "example.co.uk", "bbc.uk", "a.x.ck", "www.ck", "a.www.ck", "city.kawasaki.jp", "a.x.kawasaki.jp", "kawasaki.jp", "EXAMPLE.CO.UK."]
    own = suffixes.parsed(["// a list", "", "corp  // remark", "*.lan", "!x.lan"])
    assert asked(spark, own.registrable, ["a.corp", "b.a.lan", "a.lan", "x.lan", "example.com"]) == [True, True, False, True, False]
    assert asked(spark, CHECKS["suffix"], ["alex@example.com", "alex@example.invalidsuffix", "alex@co.uk", "alex@x.co.uk"]) == [True, False, False, True]


def test_keys_of_one_row_group_are_dealt_over_all_tasks(spark, tmp_path):
    spark.range(1, 2001).toDF("c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for query, kinds in ((identifier_queries.country_identifiers, 19), (identifier_queries.phone_numbers, 4), (queries.iban_mod97, 1), (queries.detect_iban, 1), (queries.detect_steuernummer, 1)):
        rows = query(spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in rows.groupBy("task").count().collect()]
        assert sum(sizes) == 2000 * kinds and len(sizes) == tasks and max(sizes) < 2 * 2000 * kinds // tasks
