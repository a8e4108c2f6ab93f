"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Lengths are integers up to the capacity, so the global best-fit-decreasing run needs only the
count of each length: sizes are taken from large to small, and each goes to the open sequence with
the least remaining space that still holds it, found in a segment tree over remaining capacities.
Equal sizes and equal sequences are handled as intervals, so the plan made on the driver depends on the
capacity, never on the number of documents, yet is the plan that one-by-one best fit would make.

Pieces are numbered within their length by (chunk, place in chunk), where chunk is the writing task;
the plan maps that number to a sequence and an offset.

Defined results: a null or empty text is the end id alone (one piece of length 1); a document of
exactly the capacity is not cut; repeated rows are packed each; an empty table packs to nothing; extra
columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import written
from .text import SpanIndex, Texts, chunks, ragged

END_ID = 0
#: Words kept per worker (some 60 bytes each); the table starts afresh beyond it.
MAX_WORDS = 2_000_000


class WordIds:
    """Token ids by white-space separated word; such words encode independently in this tokenizer."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.index = SpanIndex()
        self.begin, self.size, self.flat, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0

    def ids(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the documents, each followed by the end id, and the id bounds by document."""
        starts, ends, bounds = t.words()
        if len(self.index) > MAX_WORDS:
            self._clear()
        entry, new = self.index.numbers(t.data, starts, ends)
        if new:
            self._add([e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)])
        # the end id takes the place of one more word in each document
        n_words, n_docs = len(starts), len(t)
        place = np.arange(n_words) + np.repeat(np.arange(n_docs), np.diff(bounds))
        size, begin = np.ones(n_words + n_docs, np.int64), np.zeros(n_words + n_docs, np.int64)
        size[place], begin[place] = self.size[entry], self.begin[entry]
        stop = np.ones(n_words + n_docs, bool)
        stop[place] = False
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[ragged(begin, size)]
        ids[total[1:][stop] - 1] = END_ID
        return ids, np.concatenate([[0], total[1:][stop]])

    def _add(self, ids: list[list[int]]) -> None:
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for y in ids for x in y), np.uint32, int(size.sum()))
        if self.n + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.n], np.zeros(max(len(self.flat), len(flat)), np.uint32)])
        self.flat[self.n : self.n + len(flat)] = flat
        self.begin = np.concatenate([self.begin, self.n + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.n += len(flat)


@lru_cache(4)
def word_ids(path: str) -> WordIds:
    """The worker's word table for a tokenizer file."""
    return WordIds(path)


class SegmentTree:
    """Which remaining capacities have an open sequence; finds the least one that is at least ``x`` in O(log capacity)."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, x: int, on: bool) -> None:
        i = x + self.leaves
        self.any[i] = on
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def least(self, x: int) -> int:
        """-1 if there is none."""
        i = x + self.leaves
        if self.any[i]:
            return x
        while i > 1 and (i & 1 or not self.any[i + 1]):
            i >>= 1
        if i <= 1:
            return -1
        i += 1
        while i < self.leaves:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Plan rows (length, first rank, end rank, first sequence, pieces per sequence, used before).

    Piece ``rank`` of that length goes to sequence ``first + (rank - first rank) // per`` at offset
    ``used + (rank - first rank) % per * length``.
    """
    tree, open_ = SegmentTree(capacity), [[] for _ in range(capacity + 1)]
    plan, sequences = [], 0

    def put(remaining: int, lo: int, hi: int) -> None:
        if remaining and hi > lo:
            open_[remaining].append((lo, hi))
            tree.set(remaining, True)

    for size in sorted(histogram, reverse=True):
        rank, count = 0, histogram[size]
        while count:
            r = tree.least(size)
            if r < 0:
                r, per = capacity, capacity // size
                need = -(-count // per)
                lo, hi = sequences, sequences + need
                sequences += need
            else:
                per = r // size
                lo, hi = open_[r].pop()
                if not open_[r]:
                    tree.set(r, False)
            full = min(hi - lo, count // per)
            take = full * per
            rest = min(count - take, per - 1) if full < hi - lo else 0
            plan.append((size, rank, rank + take + rest, lo, per, capacity - r))
            put(r - per * size, lo, lo + full)
            if rest:
                put(r - rest * size, lo + full, lo + full + 1)
            put(r, lo + full + bool(rest), hi)
            rank, count = rank + take + rest, count - take - rest
    return np.array(plan, np.int64).reshape(-1, 6)


def pieces(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with chunk and the place among the chunk's pieces of that length."""
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "chunk", "place")], T.StructField("piece", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = word_ids(path), np.zeros(capacity + 1, np.int64)
        chunk = TaskContext.get().partitionId()
        for b in batches:
            for i, _, t in chunks(b.column(1)):
                ids, bounds = table.ids(t)
                n = np.diff(bounds)
                k = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), k)
                piece = ragged(np.zeros(len(k), np.int64), k)
                start = piece * capacity
                length = np.minimum(n[doc] - start, capacity)
                at = bounds[doc] + start
                view = memoryview(ids.astype("<u4").view(np.uint8))
                crc = np.fromiter((zlib.crc32(view[4 * a : 4 * (a + m)]) for a, m in zip(at, length, strict=True)), np.int64, len(at))
                order = np.argsort(length, kind="stable")
                counts = np.bincount(length, minlength=capacity + 1)
                place = np.empty(len(length), np.int64)
                place[order] = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts)
                place += seen[length]
                seen += counts
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(i + doc)), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(doc), chunk)), pa.array(place), pa.array(piece.astype(np.int32))], names=schema.names
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = written(pieces(docs, path, capacity), "pieces")
    counts = cut.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # at most one row per length
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_fit_decreasing(histogram, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    columns = {c: cut.schema[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
    schema = T.StructType([*columns.values(), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # ranks of one length grow with the rows of the plan, so (length, rank) is one sorted key
        big = int(plan[:, 2].max(initial=0)) + 1
        key = plan[:, 0] * big + plan[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            row = plan[np.searchsorted(key, length * big + rank, "right") - 1]
            d = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(row[:, 3] + d // row[:, 4]), pa.array(row[:, 5] + d % row[:, 4] * length)], names=schema.names)

    ranked = cut.join(offsets, ["length", "chunk"]).select(*columns, (F.col("before") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(run, schema)
