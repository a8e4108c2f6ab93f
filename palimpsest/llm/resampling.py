"""Importance resampling towards a target distribution of hashed n-grams.

Every text is turned into its features, all runs of 1 to ``most`` consecutive words, and every feature into a bucket: the crc32 of its bytes modulo
``buckets``. Buckets are counted over all documents (s of S features) and over all target texts (t of T). A bucket's gain is the smoothed log ratio of the two
shares, a document's weight the sum of its features' gains, and its score the weight plus Gumbel noise keyed by its doc_id; the highest
scores among documents of enough words are the sample, which is a draw without replacement in proportion to exp(weight / 1000).

The counting is SQL in DuckDB, one in-memory database for each task: ``unnest`` takes the words of a slice of texts, a window over them
builds the n-grams, and zlib's crc32, registered as a function, is asked once for each distinct n-gram of the slice. What comes out is
spilled to Parquet in the shared folder: for each document its bucket counts (at most ``buckets`` numbers, however long the text), and for each task its
totals, which Spark merges. The gains, one number for each bucket, go to the tasks that score the documents. Ranks are running counts
over ranges of the score.

Slices hold ``SLICE`` bytes of text; a longer text is cut between words and the words that its last n-grams need are read along, so a task's
memory depends on neither.

Defined results: a null or empty text has no features, weight 0 and its noise as score; a null doc_id counts as the empty string for its
noise and as the least doc_id in ties; rows that repeat have equal scores, and the ranks of rows equal in doc_id and score are
interchangeable; without target texts every gain is the one of zero counts; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .running import running
from .store import written

SLICE = 4 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


@dataclass(frozen=True)
class Resample:
    """n-gram sizes, buckets, the percentage of eligible documents to draw, their least number of words, and the seed of the noise."""

    most: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: str = "2024"


def _slices(texts: list[bytes], most: int, limit: int = SLICE) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Rows, texts and words read along of slices of at most about ``limit`` bytes; a longer text is cut between words."""
    rows, parts, along, size = [], [], [], 0
    for i, text in enumerate(texts):
        a = 0
        while a < len(text) or not a:
            gap = _GAP.search(text, a + limit) if a + limit < len(text) else None
            b = gap.start() if gap else len(text)
            extra = []
            if gap and most > 1:
                for w in _WORD.finditer(text, b):
                    extra.append(w.group())
                    if len(extra) == most - 1:
                        break
            rows.append(i)
            parts.append(b" ".join([text[a:b], *extra]).decode())
            along.append(len(extra))
            size += b - a
            a = b or 1
            if size >= limit:
                yield rows, parts, along
                rows, parts, along, size = [], [], [], 0
    if rows:
        yield rows, parts, along


def _sql(most: int, buckets: int) -> str:
    """Row, bucket, n of the features of ``slice``; and, with bucket null, the row's words."""
    grams = ["SELECT i, word AS gram FROM own"]
    for n in range(2, most + 1):
        ahead = " || ' ' || ".join(["word", *[f"lead(word, {k}) OVER d" for k in range(1, n)]])
        grams.append(f"SELECT i, gram FROM (SELECT i, p, own, {ahead} AS gram FROM w WINDOW d AS (PARTITION BY part ORDER BY p)) WHERE gram IS NOT NULL AND p <= own")
    return f"""
WITH x AS (SELECT i, part, along, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_CLASS}') AS words FROM slice),
w AS (SELECT i, part, len(words) - along AS own, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM x),
own AS (SELECT i, word FROM w WHERE p <= own),
c AS (SELECT i, gram, count(*) AS n FROM ({' UNION ALL '.join(grams)}) GROUP BY i, gram),
g AS (SELECT gram, zlib_crc32(gram) % {buckets} AS bucket FROM (SELECT DISTINCT gram FROM c))
SELECT i, bucket, CAST(sum(n) AS BIGINT) AS n FROM c JOIN g USING (gram) GROUP BY i, bucket
UNION ALL SELECT i, NULL, CAST(sum(len(words) - along) AS BIGINT) FROM x GROUP BY i ORDER BY i, bucket NULLS FIRST"""


def _crc32(grams: pa.ChunkedArray) -> pa.Array:
    return pa.array([zlib.crc32(g) for g in pc.cast(grams, pa.binary()).to_pylist()], pa.int64())


def _database() -> duckdb.DuckDBPyConnection:
    """A database in this task's memory alone: one thread, nothing on disk."""
    db = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "preserve_insertion_order": False})
    db.create_function("zlib_crc32", _crc32, [duckdb.sqltype("VARCHAR")], duckdb.sqltype("BIGINT"), type="arrow")
    return db


def bucket_counts(texts: DataFrame, r: Resample, key: str | None = None) -> DataFrame:
    """One row for each document (``key``, n_words, buckets, counts), and rows without a document (n_words null) with totals of many; without ``key`` those only."""
    fields = [T.StructField("key", texts.schema[key].dataType)] if key else []
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db, sql, total = _database(), _sql(r.most, r.buckets), np.zeros(r.buckets, np.int64)
        kind = None

        def rows(keys: pa.Array | None, n_words: np.ndarray | None, buckets: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x)) for x in (buckets.astype(np.int32), counts.astype(np.int64))]
            size = len(bounds) - 1
            words = pa.nulls(size, pa.int64()) if n_words is None else pa.array(n_words, pa.int64())
            named = [keys if keys is not None else pa.nulls(size, kind)] if key else []
            return pa.RecordBatch.from_arrays([*named, words, *lists], names=schema.names)

        def counted(batch: pa.RecordBatch, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
            held: tuple[int, np.ndarray, np.ndarray, int] | None = None  # a text that goes on in the next slice
            for at, parts, along in _slices(texts, r.most):
                slice = pa.table({"i": pa.array(at, pa.int64()), "part": pa.array(range(len(at)), pa.int64()), "along": pa.array(along, pa.int64()), "text": pa.array(parts, pa.string())})  # noqa: F841
                got = db.sql(sql).fetch_arrow_table()
                i, n = got.column("i").to_numpy(), got.column("n").to_numpy()
                words = got.column("bucket").is_null().to_numpy()
                bucket = pc.fill_null(got.column("bucket"), 0).to_numpy()
                np.add.at(total, bucket[~words], n[~words])
                if not key:
                    continue
                first, last = at[0], at[-1]
                n_words = n[words]
                bounds = np.searchsorted(i[~words], np.arange(first, last + 2))
                bucket, n = bucket[~words], n[~words]
                done = [(first + k, bucket[bounds[k] : bounds[k + 1]], n[bounds[k] : bounds[k + 1]], int(n_words[k])) for k in range(last - first + 1)]
                if held:
                    if held[0] == first:
                        all_ = np.zeros(r.buckets, np.int64)
                        np.add.at(all_, held[1], held[2])
                        np.add.at(all_, done[0][1], done[0][2])
                        some = np.flatnonzero(all_)
                        done[0] = (first, some, all_[some], held[3] + done[0][3])
                    else:
                        done.insert(0, held)
                held = done.pop()
                if done:
                    yield rows(batch.column(1).take(pa.array([d[0] for d in done])), [d[3] for d in done], np.concatenate([d[1] for d in done]), np.concatenate([d[2] for d in done]), np.cumsum([0, *(len(d[1]) for d in done)]))
            if held:
                yield rows(batch.column(1).take(pa.array([held[0]])), [held[3]], held[1], held[2], np.array([0, len(held[1])]))

        for b in batches:
            kind = b.column(1).type if key else None
            # what a step looks at stays small, whatever a batch holds
            values = b.column(0).cast(pa.large_binary())
            a = 0
            while a < b.num_rows:
                e, size = a, 0
                while e < b.num_rows and (e == a or size < SLICE):
                    size += len(values[e].as_buffer() or b"") if values[e].is_valid else 0
                    e += 1
                yield from counted(b.slice(a, e - a), [x or b"" for x in values[a:e].to_pylist()])
                a = e
        some = np.flatnonzero(total)
        if len(some):
            yield rows(None, None, some, total[some], np.array([0, len(some)]))

    return texts.select("text", *([key] if key else [])).mapInArrow(run, schema)


def _totals(counts: DataFrame) -> dict[int, int]:
    """Totals by bucket: at most ``buckets`` rows, merged by Spark."""
    each = counts.where("n_words IS NULL").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    got = each.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n")).collect()
    return {x["bucket"]: x["n"] for x in got}


def gains(have: dict[int, int], want: dict[int, int], buckets: int) -> np.ndarray:
    """The gain of every bucket, in thousandths of a nat."""
    s_all, t_all = sum(have.values()), sum(want.values())
    out = np.empty(buckets, np.int64)
    for b in range(buckets):
        s, t = have.get(b, 0), want.get(b, 0)
        out[b] = math.floor(1000.0 * math.log(float(t + 1) * float(s_all + buckets) / (float(s + 1) * float(t_all + buckets))))
    return out


def scored(counts: DataFrame, gain: np.ndarray, seed: str) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document of ``counts``."""
    kind = counts.schema["key"].dataType
    schema = T.StructType([T.StructField("key", kind), *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, n = b.column("buckets"), b.column("counts")
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            bucket, n = lists.flatten().to_numpy(), n.flatten().to_numpy()
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (n, gain[bucket] * n)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n_words"), *[pa.array(x[bounds[1:]] - x[bounds[:-1]], pa.int64()) for x in sums]], names=schema.names)

    weighed = counts.where("n_words IS NOT NULL").mapInArrow(run, schema)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    return weighed.select(F.col("key").alias("doc_id"), "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))


def resample(docs: DataFrame, target: DataFrame, r: Resample = Resample()) -> DataFrame:
    """doc_id, n_features, weight, score, rank (1, 2, ... of the documents drawn, else null) of every document; ``target`` has the texts to resemble."""
    counts = written(bucket_counts(docs, r, "doc_id"), "bucket-counts")
    wanted = written(bucket_counts(target, r), "target-counts")
    scores = written(scored(counts, gains(_totals(counts), _totals(wanted), r.buckets), r.seed), "resample-scores")
    eligible = F.col("n_words") >= r.least_words
    n = scores.where(eligible).count() * r.percent // 100
    # the ineligible come last; equal scores by doc_id, and repeated rows by their place in the table, so that none of them share a key
    order = [F.when(eligible, 0).otherwise(1), -F.col("score"), F.col("doc_id"), F.monotonically_increasing_id()]
    ranked = running(scores, order, {"before": F.lit(1)}, "resample-ranks")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(eligible & (F.col("before") < n), F.col("before") + 1).alias("rank"))
