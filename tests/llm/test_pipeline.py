"""Stages on planted cases: what must go goes, clean documents stay, columns stay as they are."""

import random
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(n))


def text(r, lines=6):
    return "\n".join(words(r, 15).capitalize() + "." for _ in range(lines))


def planted():
    r = random.Random(7)
    clean = {i: text(r) for i in range(40)}
    item = words(r, 30)
    rows = dict(clean)
    rows[100] = clean[0]  # an exact copy
    rows[101] = clean[1].replace(clean[1].split()[40], "changed")  # a near copy
    rows[102] = text(r, 3) + "\n" + item + "\n" + text(r, 2)  # a benchmark passage
    rows[103] = "short text"
    rows[104] = " ".join(w + "###" for w in words(r, 80).split())  # junk
    rows[105] = "\n".join(clean[2].split("\n")[1:5]) + "\n" + text(r, 4)  # a run of lines that stands before
    rows[106] = None
    rows[107] = ""
    return clean, item, [(k, v, "en", "s", len(v or "")) for k, v in rows.items()] + [(None, text(r), None, None, None)]


def test_stages_and_run(spark, tmp_path):
    clean, item, rows = planted()
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        kept[name] = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(list(kept[name].values()), SCHEMA)
    assert not {103, 104, 106, 107} & set(kept["quality_rules"]) and {100, 101, 102, 105, None, *clean} <= set(kept["quality_rules"])
    assert kept["line_dedup"][105].text.count("\n") == 3 and 100 not in kept["line_dedup"]
    assert all(kept["line_dedup"][i].text == clean[i] for i in clean)
    assert 101 not in kept["near_dedup"] or kept["near_dedup"][101].text != rows[41][1]
    assert set(clean) | {None} <= set(kept["decontamination"]) and 102 not in kept["decontamination"]
    final = corpus_pipeline.run(spark, str(tmp_path))
    got = final.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= 2048 for r in got)
    assert {r.doc_id for r in final.collect()} == set(kept["decontamination"])


def test_stages_take_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_long_passages_of_one_or_two_lines_go(spark, tmp_path):
    r = random.Random(8)
    one, two, brief = words(r, 50), words(r, 30) + "\n" + words(r, 20), words(r, 24) + "\n" + words(r, 25)
    own = [text(r, 3) for _ in range(6)]
    rows = [(i, own[i] + "\n" + p, "en", "s", 0) for i, p in enumerate([one, one, two, two, brief, brief])]
    got = {x.doc_id: x.text for x in corpus_pipeline.lines(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()}
    assert got == {i: own[i] if i in (1, 3) else rows[i][1] for i in range(6)}


def test_one_row_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(60))
    copy = base.replace("w59", "changed")
    other, third = base.replace("w", "x"), base.replace("w", "y")
    rows = [(1, base, "b"), (1, copy, "a"), (1, base, "a"), (None, copy, "a"), (2, other, "a"), (2, other, "a"), (None, third, "a"), (None, third.replace("y59", "z"), "a"), (7, "", "a"), (7, "", "a"), (1, "own " * 9, "a")]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in rows], SCHEMA), "").collect()
    assert Counter(x.text.split()[0][0] if x.text else "" for x in got) == Counter({"w": 1, "x": 1, "y": 1, "o": 1, "": 2})
    assert [x.doc_id for x in got if x.text[:1] == "w"] == [1]


def test_stages_take_repeats_long_texts_and_extra_columns(spark, tmp_path):
    r = random.Random(12)
    item = words(r, 30)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    long = "\n".join(words(r, 12) for _ in range(6000))
    base = words(r, 120)
    near = " ".join("changed" if i == 60 else w for i, w in enumerate(base.split()))
    rows = [(1, base), (2, near), (3, long), (3, long), (4, words(r, 60) + " " + item), (None, words(r, 80)), (None, words(r, 80)), (5, None), (6, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA)
    clash = ("n_words", "failure_bits", "item_ids", "short_item_ids", "cid", "group", "seq", "total", "first", "h", "__key", "__place", "__gone", "__longest")
    for c in clash:
        docs = docs.withColumn(c, F.lit(c))
    got = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got[name] = out.collect()
        assert all(x[c] == c for x in got[name] for c in clash)
    ids = {name: Counter(x.doc_id for x in kept) for name, kept in got.items()}
    assert ids["quality_rules"] == Counter({1: 1, 2: 1, 3: 2, 4: 1, None: 2})
    assert ids["near_dedup"] == Counter({1: 1, 3: 1, 4: 1, None: 2, 5: 1, 6: 1}) and 2 not in ids["near_dedup"]
    assert ids["decontamination"] == Counter({1: 1, 2: 1, 3: 2, None: 2, 5: 1, 6: 1})
    assert {x.doc_id: x.text for x in got["line_dedup"]}[3] == long
