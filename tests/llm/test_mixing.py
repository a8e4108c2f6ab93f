"""Mixing, divergence and resampling against plain second implementations, on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import divergence, mixing, resampling
from palimpsest.llm.mixing import Mix
from palimpsest.llm.resampling import Resample

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sourced(r, n=120, sources=("a", "b", "ß", "日", None)):
    rows = []
    for i in range(n):
        size = r.choice([0, 1, 3, 20, 60, 61, 62, 130])
        rows.append((i, " ".join(f"w{i}.{k}" for k in range(size)), r.choice(sources[:1] * 6 + sources)))
    rows += [(3, None, "a"), (None, "no id at all", "b"), (5, "twice the same", "ß"), (5, "twice the same", "ß"), (900, "tail", "only"), (901, "x " * 5000, "long")]
    return rows


SOURCED = "doc_id long, text string, source string"


def water(sizes, m):
    """Targets by resharing the excess until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: m.weights[i % len(m.weights)] for i, s in enumerate(names)}
    full, total = {}, m.percent * sum(sizes.values()) / 100
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > m.most * sizes[s]]
        if not over:
            return full | share
        full |= {s: float(m.most * sizes[s]) for s in over}


# 11
@pytest.mark.parametrize("m", [Mix(block=7, shard_blocks=16), Mix(block=64, shard_blocks=8, weights=(1, 9), percent=190), Mix(block=512, percent=40, most=1, key="other")])
def test_mix_meets_targets_and_limits(spark, m):
    rows = sourced(random.Random(1))
    docs = spark.createDataFrame(rows, SOURCED).withColumns({"rank": F.lit("clash"), "size": F.lit("clash"), "block": F.lit(1)})
    got = mixing.taken(docs, m).collect()
    size = {(d, t): len(WORD.findall(t or "")) for d, t, _ in rows}
    assert sorted((str(x.doc_id), x["size"]) for x in got) == sorted((str(d), size[d, t]) for d, t, _ in rows)
    sizes = Counter()
    for d, t, s in rows:
        sizes[s] += size[d, t]
    want = water(sizes, m)
    assert all(0 <= x.taken <= m.most * x["size"] for x in got)
    assert sum(x.taken for x in got) == sum(min(m.most * sizes[s], math.floor(want[s] + 0.5)) for s in sizes)
    by_size = {n: {want[s] for s in sizes if sizes[s] == n} for n in sizes.values()}
    assert all(any(math.isclose(x.target, w, rel_tol=1e-9) for w in by_size[x.source_size]) for x in got)
    again = mixing.taken(docs.repartition(5, "text"), m).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_the_mix_is_blocks_of_the_sources_lines(spark):
    m = Mix(block=16, shard_blocks=8)
    rows = sourced(random.Random(2), 60)
    docs = spark.createDataFrame(rows, SOURCED)
    mix = sorted(mixing.mixture(docs, m).collect(), key=lambda x: (x.shard, x.slot))
    assert [(x.shard, x.slot) for x in mix] == [(i // 8, i % 8) for i in range(len(mix))]
    source_of = {w: s for d, t, s in rows for w in WORD.findall(t or "") if w.startswith("w")}
    seen = Counter()
    for x in mix:
        words = x.text.split(" ")
        assert len(words) == x.n_words <= 16 and all(source_of.get(w, x.source) == x.source for w in words)
        seen.update(w for w in words if w in source_of)
        # the words of a document stand in their order
        for a, b in zip(words, words[1:], strict=False):
            if a in source_of and b in source_of and a.split(".")[0] == b.split(".")[0]:
                assert int(b.split(".")[1]) == int(a.split(".")[1]) + 1
    assert max(seen.values()) <= 2
    taken = {x.doc_id: x.taken for x in mixing.taken(docs, m).collect()}
    by_doc = Counter()
    for w, n in seen.items():
        by_doc[int(w[1:].split(".")[0])] += n
    clean = [d for d, t, _ in rows if d is not None and (t or "").startswith("w") and d != 5 and d != 3]
    assert all(taken[d] == by_doc[d] for d in clean)


def test_shard_counts_are_a_multinomial_draw(spark):
    m = Mix(block=1, shard_blocks=100, weights=(1, 2, 5), percent=100)
    docs = spark.createDataFrame([(i, "w " * 400, "abc"[i % 3]) for i in range(90)], SOURCED)
    rows = mixing._rows(docs, m)
    sources = mixing.targets(rows, m)
    counts = mixing.shard_counts(sources, m).cache()
    by_shard = counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()
    assert len(by_shard) == 360 and {x.n for x in by_shard} == {100}
    by_source = {x["rank"]: x for x in counts.groupBy("rank").agg(F.sum("n").alias("n")).collect()}
    want = {x["rank"]: x for x in sources.collect()}
    assert all(by_source[r].n == want[r].slots for r in want)
    spread = {r: [] for r in want}
    for x in counts.collect():
        spread[x["rank"]].append(x.n)
    for r, x in want.items():
        p = x.slots / 36_000
        assert 0.8 < np.var(spread[r] + [0] * (360 - len(spread[r]))) / (100 * p * (1 - p)) < 1.25


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_index_permutations(spark, n):
    for tweak in (0, 123_456_789):
        got = [x.p for x in spark.range(n).selectExpr(mixing.permuted("id", f"{n}L", f"{tweak}L", "k") + " AS p").collect()]
        assert sorted(got) == list(range(n))
    assert n < 97 or got != [x.p for x in spark.range(n).selectExpr(mixing.permuted("id", f"{n}L", "5L", "k") + " AS p").collect()]


def test_mix_of_nothing(spark):
    assert mixing.taken(spark.createDataFrame([], SOURCED)).count() == 0
    got = mixing.taken(spark.createDataFrame([(1, None, None), (2, " ", "a")], SOURCED)).collect()
    assert [(x["size"], x.target, x.taken) for x in got] == [(0, 0.0, 0)] * 2
    assert mixing.mixture(spark.createDataFrame([(1, "", "a")], SOURCED)).count() == 0
    with pytest.raises(ValueError, match="percent"):
        Mix(percent=201)


# 12
def audited(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = term.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(c):
            whole = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (whole + 2 * len(kept)) for t in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            found = [("pair", sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s))]
            found.append(("term", sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:top]))
            out |= {(lang, s, part, item.decode(), -v, i + 1) for part, rows_ in found for i, (v, item) in enumerate(rows_)}
    return out


@pytest.mark.parametrize(("bucket", "block", "least"), [(512, 128, 3), (4, 2, 2), (7, 3, 1)])
def test_audit_equals_brute_force(spark, monkeypatch, bucket, block, least):
    monkeypatch.setattr(divergence, "BUCKET", bucket)
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "ENTRIES", 50)
    monkeypatch.setattr(divergence, "STEP", 40)
    r = random.Random(3)
    words = ["the", "The", "été", "ÉTÉ", "日本", "x1y", "don't", *(f"{a}{b}" for a in "abcde" for b in "xyz")]
    rows = [(" ".join(r.choices(words, [1 / (i + 1) for i in range(len(words))], k=r.randrange(30))), r.choice(["en", "fr", None, ""]), r.choice(["s1", "s2", "S3", "ü", "日", None, ""])) for _ in range(150)]
    rows += [(None, "en", "s1"), ("", "xx", "alone"), ("...", "yy", "p"), (None, "yy", "q"), ("the " * 4000 + "end", "en", "s1")] + [("the same row", "fr", "s2")] * 5
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit("clash"), "n": F.lit(1), "p": F.lit("clash")})
    got = [tuple(x) for x in divergence.audit(docs, least, 4).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == audited(rows, least, 4)


def test_audit_of_nothing_and_of_large_counts(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
    n, whole, v = 9_000_000_000_000, 10_000_000_000_000, 3_000
    got = spark.range(1).select(divergence._share(F.lit(n), F.lit(whole), F.lit(v)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (whole + 2 * v)


# 13
def resampled(docs, target, r):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        w = word.findall((text or "").translate(LOWER))
        return len(w), Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % r.buckets for n in range(1, r.most + 1) for i in range(len(w) - n + 1))

    have, want, each = Counter(), Counter(), [(d, *features(t)) for d, t in docs]
    for _, _, c in each:
        have.update(c)
    for t in target:
        want.update(features(t)[1])
    whole, aim = sum(have.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[b] + 1) * (whole + r.buckets) / ((have[b] + 1) * (aim + r.buckets)))) for b in range(r.buckets)]
    out = []
    for d, n, c in each:
        weight = sum(gain[b] * k for b, k in c.items())
        h = int(hashlib.sha256(f"{r.seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, n, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    eligible = sorted((x for x in out if x[1] >= r.least_words), key=lambda x: (-x[4], -1 if x[0] is None else x[0]))
    drawn = eligible[: r.percent * len(eligible) // 100]
    return sorted(map(str, [(x[0], *x[2:]) for x in out])), [(x[0], x[4]) for x in drawn]


@pytest.mark.parametrize("r", [Resample(buckets=50, least_words=3, percent=30), Resample(most=3, buckets=200, least_words=1, percent=45, seed="s"), Resample()])
def test_resampling_equals_brute_force(spark, monkeypatch, r):
    g = random.Random(4)
    words = ["the", "The", "x1", "7", "été", "ÉTÉ", "日本", "a", "b-c", "don't", "\x00"]
    docs = [(i, "".join(g.choice(words) + g.choice([" ", "  ", "\n", ", "]) for _ in range(g.randrange(60)))) for i in range(90)]
    docs += [(None, "one two three four"), (400, None), (401, ""), (402, "long text, " * 800 + "tail"), (403, "x" * 3000 + " y z"), (7, "again"), (7, "again")]
    target = ["the x1 7 b c", None, "", "été " * 30]
    monkeypatch.setattr(resampling, "SLICE", 700)
    monkeypatch.setattr(resampling._slices, "__defaults__", (700,))
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"key": F.lit("clash"), "rank": F.lit(1)})
    got = resampling.resample(table, spark.createDataFrame([(t,) for t in target], "text string"), r).collect()
    rows, drawn = resampled(docs, target, r)
    assert sorted(str((x.doc_id, x.n_features, x.weight, x.score)) for x in got) == rows
    assert [(x.doc_id, x.score) for x in sorted((x for x in got if x["rank"] is not None), key=lambda x: x["rank"])] == drawn


def test_resampling_of_and_towards_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert resampling.resample(none, some).count() == 0
    got = resampling.resample(some, none.select("text"), Resample(least_words=1, percent=100)).collect()
    assert sorted((x.doc_id, x.n_features, x["rank"]) for x in got if x["rank"]) == [(1, 3, 1)]


def test_long_texts_are_cut_between_words():
    text = b"one two  three, four five six"
    for most in (1, 2, 4):
        for limit in (1, 4, 9, 100):
            rows, words = [], []
            for at, parts, along in resampling._slices([b"x", b"", text], most, limit):
                for i, part, n in zip(at, parts, along, strict=True):
                    found = re.findall(r"\w+", part)
                    rows.append(i)
                    words += found[: len(found) - n] if i == 2 else []
            assert words == re.findall(r"\w+", text.decode()) and set(rows) == {0, 1, 2}
