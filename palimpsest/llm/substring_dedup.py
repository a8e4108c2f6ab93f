"""Exact repeats of at least ``window`` words, found through fixed-block anchors.

1. Index: every document is cut into non-overlapping blocks of ``block`` words, with ``window >= 2 * block - 1``,
   so each window of a document contains a whole block of that document.
2. Probe: every rolling window of ``block`` words of every document is looked up. A window that starts
   twice makes its blocks start twice, so blocks that no second probe meets are out.
   Probes travel as sorted hash arrays, one per partition and batch, equal ones merged with a count.
3. Extend: windows around the surviving blocks are compared by a 64-bit hash of their whole word
   sequence, counted over the table; the hits of a document are merged to maximal repeats and removed.

Hot content is merged inside each batch before it travels, so a passage or copy that holds a third of
all rows costs one entry per batch.

Defined results: a null text counts as empty; texts of fewer than ``window`` words lose nothing; rows
that repeat (same doc_id included) count as different places, so both lose the repeat; rows of one doc_id and equal text
are treated alike; words are kept unchanged and joined by one space; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import written
from .text import Texts, chunks, mix, ragged, span_hash, window_hash

U64 = np.uint64


def _hashes(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, bounds = t.words()
    return span_hash(t.data, starts, ends), bounds


def _windows(h: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows that lie in one document, and their first words."""
    n = np.maximum(np.diff(bounds) - width + 1, 0)
    at = ragged(bounds[:-1], n)
    return window_hash(h, width)[at], at


def _block_starts(bounds: np.ndarray, block: int) -> np.ndarray:
    return ragged(np.zeros(len(bounds) - 1, np.int64), np.diff(bounds) // block) * block + np.repeat(bounds[:-1], np.diff(bounds) // block)


def _parcels(keys: np.ndarray, flags: np.ndarray, n_parts: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Sorted distinct keys by partition, with how often each occurs (1 or 2: more) and whether it is flagged."""
    order = np.argsort(keys)
    keys, flags = keys[order], flags[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    many = np.diff(np.append(at, len(keys))) > 1
    flagged = np.logical_or.reduceat(flags, at) if len(at) else np.zeros(0, bool)
    keys = keys[at]
    # partitions are ranges of the hash, so each is one run of the sorted keys
    cut = np.searchsorted(keys, (np.arange(n_parts + 1, dtype=object) * (1 << 64) // n_parts).clip(max=(1 << 64) - 1).astype(U64))
    cut[-1] = len(keys)
    for p in range(n_parts):
        a, b = cut[p], cut[p + 1]
        if b > a:
            yield p, _delta(keys[a:b]), np.packbits(many[a:b]).tobytes(), np.packbits(flagged[a:b]).tobytes()


def _delta(keys: np.ndarray) -> bytes:
    """Sorted keys as a first key and gaps, each gap's bytes stored plane by plane with leading zero planes left out."""
    gaps = np.diff(keys, prepend=U64(0))
    width = max(1, -(-int(gaps[1:].max(initial=0)).bit_length() // 8))
    planes = gaps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + planes.tobytes()


def _undelta(data: bytes) -> np.ndarray:
    width = data[0]
    first = np.frombuffer(data, "<u8", 1, 1)
    planes = np.frombuffer(data, np.uint8, -1, 9).reshape(width, -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, :width] = planes.T
    with np.errstate(over="ignore"):
        return np.cumsum(np.concatenate([first, gaps.view("<u8").ravel()]).astype(U64))


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _repeated(parcels: Iterator[tuple[bytes, bytes, bytes]]) -> np.ndarray:
    """Keys that occur at least twice over all parcels and are flagged in one."""
    keys, marks = [], []
    for k, m, f in parcels:
        keys.append(_undelta(k))
        marks.append(_bits(m, len(keys[-1])) + 2 * _bits(f, len(keys[-1])).view(np.uint8))
    if not keys:
        return np.empty(0, U64)
    k, m = np.concatenate(keys), np.concatenate(marks)
    keys.clear()
    order = np.argsort(k)
    k, m = k[order], m[order]
    del order
    first = np.ones(len(k), bool)
    np.not_equal(k[1:], k[:-1], out=first[1:])
    at = np.flatnonzero(first)
    seen = np.bitwise_or.reduceat(m, at)
    hit = ((np.diff(at, append=len(k)) > 1) | (seen & 1 > 0)) & (seen & 2 > 0)
    return k[at[hit]]


def _shifted(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys >> U64(64 - bits)


#: Probes carry this many bits; a chance match only makes a document be looked at again.
PROBE_BITS = 48
#: Places gathered before parcels are sent, bytes of text in a written batch, and bytes of text whose probes meet in one part.
PARCEL_KEYS, BATCH_BYTES, PART_BYTES = 1_000_000, 6 << 20, 8 << 20


def _probe_parcels(docs: DataFrame, block: int, n_parts: int) -> DataFrame:
    """The index and the probes: hashes of all rolling block-sized windows, flagged where an indexed block stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        flags: list[np.ndarray] = []

        def send() -> pa.RecordBatch:
            rows = list(_parcels(np.concatenate(keys), np.concatenate(flags), n_parts))
            keys.clear()
            flags.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "keys", "many", "flagged"])

        for b in batches:
            for _, _, t in chunks(b.column(0)):
                h, bounds = _hashes(t)
                k, at = _windows(h, bounds, block)
                if len(k):
                    indexed = np.zeros(len(h) + 1, bool)
                    indexed[_block_starts(bounds, block)] = True
                    keys.append(_shifted(k, PROBE_BITS) << U64(64 - PROBE_BITS))
                    flags.append(indexed[at])
                if sum(map(len, keys)) >= PARCEL_KEYS:
                    yield send()
        if keys:
            yield send()

    return docs.select("text").mapInArrow(run, "part int, keys binary, many binary, flagged binary")


def _repeated_blocks(docs: DataFrame, block: int, n_parts: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        found = _repeated(zip(*(table.column(c).to_pylist() for c in ("keys", "many", "flagged")), strict=True))
        return pa.table({"key": found.view(np.int64)})

    return _probe_parcels(docs, block, n_parts).groupBy("part").applyInArrow(run, "key long")


def _blocks(docs: DataFrame, block: int) -> DataFrame:
    """One row per indexed block: its key, its document and its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, t in chunks(b.column(2)):
                h, bounds = _hashes(t)
                starts = _block_starts(bounds, block)
                w = window_hash(h, block)
                doc = np.searchsorted(bounds, starts, "right") - 1
                key = (_shifted(w[starts], PROBE_BITS) << U64(64 - PROBE_BITS)).view(np.int64)
                rows = pa.array(i + doc)
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0).take(rows), b.column(1).take(rows), pa.array(((starts - bounds[doc]) // block).astype(np.int32))], names=["key", "d", "h", "k"])

    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("d", docs.schema["doc_id"].dataType), T.StructField("h", T.LongType()), T.StructField("k", T.IntegerType())])
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, schema)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _candidates(h: np.ndarray, bounds: np.ndarray, marks: list[list[int]], window: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of the windows that hold a marked block and no unmarked one."""
    n = np.maximum(np.diff(bounds) - window + 1, 0)
    at = ragged(bounds[:-1], n)
    if not len(at):
        return np.empty(0, U64), at
    n_blocks = np.diff(bounds) // block
    first_block = np.cumsum(n_blocks) - n_blocks
    marked = np.zeros(int(n_blocks.sum()) + 1, np.int64)
    for d, k in enumerate(marks):
        marked[first_block[d] + np.asarray(k, np.int64)] = 1
    seen = np.concatenate([[0], np.cumsum(marked[:-1])])
    doc = np.repeat(np.arange(len(n)), n)
    place = at - bounds[doc]
    lo = first_block[doc] + -(-place // block)
    hi = np.minimum(first_block[doc] + (place + window) // block, first_block[doc] + n_blocks[doc])
    keep = seen[hi] - seen[lo] == hi - lo
    at = at[keep]
    return window_hash(h, window)[at], at


def _texts(values: list[str]) -> Texts:
    parts = [v.encode() for v in values]
    return Texts(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64))


def _sorted_out(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Batches: results of documents without a marked block, and texts and marks of those with one."""
    doc_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField(c, T.ArrayType(k)) for c, k in (("done", doc_type), ("n_words", T.LongType()), ("sha", T.StringType()), ("ids", doc_type), ("texts", T.StringType()), ("marks", T.ArrayType(T.IntegerType())))])
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).alias("l")
    both = d.join(marks.alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.d")) & (F.col("l.h") == F.col("r.h")), "left").select("doc_id", "text", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {f.name: [] for f in schema.fields}
        size = 0

        def send() -> pa.RecordBatch:
            nonlocal size
            kinds = pa.struct([pa.field("x", b_schema.field(0).type)])[0].type
            types = {"done": kinds, "n_words": pa.int64(), "sha": pa.string(), "ids": kinds, "texts": pa.string(), "marks": pa.list_(pa.int32())}
            out = pa.RecordBatch.from_arrays([pa.array([rows[c]], pa.list_(types[c])) for c in rows], names=list(rows))
            for v in rows.values():
                v.clear()
            size = 0
            return out

        b_schema = None
        for b in batches:
            b_schema = b.schema
            for i in range(b.num_rows):
                doc_id, text, marked = (b.column(k)[i].as_py() for k in range(3))
                if marked:
                    rows["ids"].append(doc_id)
                    rows["texts"].append(text)
                    rows["marks"].append(marked)
                    size += len(text) * 2
                else:
                    words = (text or "").encode().split()
                    rows["done"].append(doc_id)
                    rows["n_words"].append(len(words))
                    rows["sha"].append(_digest(words))
                    size += 100
                if size >= BATCH_BYTES:
                    yield send()
        if size:
            yield send()

    return both.mapInArrow(run, schema)


def _window_parcels(batches: DataFrame, window: int, block: int, n_parts: int) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                h, bounds = _hashes(_texts(b.column(1)[i].as_py()))
                keys, _ = _candidates(h, bounds, b.column(2)[i].as_py(), window, block)
                rows = [(p, k, m) for p, k, m, _ in _parcels(keys, np.ones(len(keys), bool), n_parts)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(rows), pa.int64()), *[pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)]], names=["batch", "part", "keys", "many"])

    return batches.select("batch", "texts", "marks").mapInArrow(run, "batch long, part int, keys binary, many binary")


def _answers(parcels: DataFrame) -> DataFrame:
    """For each parcel, which of its keys occur twice in the table."""

    def run(table: pa.Table) -> pa.Table:
        keys, many = table.column("keys").to_pylist(), table.column("many").to_pylist()
        ones = [np.packbits(np.ones(8 * len(m), bool)).tobytes() for m in many]
        found = _repeated(zip(keys, many, ones, strict=True))
        bits, counts = [], []
        for k in map(_undelta, keys):
            at = np.searchsorted(found, k).clip(max=max(len(found) - 1, 0))
            hit = found[at] == k if len(found) else np.zeros(len(k), bool)
            bits.append(np.packbits(hit).tobytes())
            counts.append(len(k))
        return pa.table({"batch": table.column("batch"), "part": table.column("part"), "n": pa.array(counts, pa.int32()), "bits": pa.array(bits, pa.binary())})

    return parcels.groupBy("part").applyInArrow(run, "batch long, part int, n int, bits binary")


def _removed(batches: DataFrame, answers: DataFrame, window: int, block: int, doc_field: T.StructField) -> DataFrame:
    parts = answers.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("part", "n", "bits"))).alias("answers"))
    schema = T.StructType([doc_field, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                values = b.column(1)[i].as_py()
                h, bounds = _hashes(_texts(values))
                keys, at = _candidates(h, bounds, b.column(2)[i].as_py(), window, block)
                hit = [_bits(a["bits"], a["n"]) for a in b.column(3)[i].as_py() or []]
                unique, back = np.unique(keys, return_inverse=True)
                hit = np.concatenate(hit) if hit else np.zeros(0, bool)
                assert len(hit) == len(unique), "answers of another batch"
                starts = at[hit[back]] if len(keys) else at
                edge = np.zeros(len(h) + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                n_removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[bounds])
                sha = []
                for k, v in enumerate(values):
                    words = v.encode().split()
                    if n_removed[k]:
                        words = [w for w, g in zip(words, gone[bounds[k] : bounds[k + 1]].tolist(), strict=True) if not g]
                    sha.append(_digest(words))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1).flatten(), pa.array(np.diff(bounds)), pa.array(n_removed), pa.array(sha)], names=schema.names)

    joined = batches.join(parts, "batch", "left").select("ids", "texts", "marks", "answers")
    return joined.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, window: int = 35, block: int = 18) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block: window >= 2 * block - 1")
    # parts grow in number with the input, never in size
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    found = written(_repeated_blocks(docs, block, n_parts), "repeated-blocks")
    marks = _blocks(docs, block).join(found, "key", "left_semi").groupBy("d", "h").agg(F.collect_set("k").alias("marks"))
    batches = written(_sorted_out(docs, marks).withColumn("batch", F.monotonically_increasing_id()), "candidates")
    open_ = batches.where(F.size("ids") > 0).select("batch", "ids", "texts", "marks")
    answers = written(_answers(_window_parcels(open_, window, block, n_parts)), "answers")
    rest = _removed(open_, answers, window, block, docs.schema["doc_id"])
    done = batches.select(F.explode(F.arrays_zip("done", "n_words", "sha")).alias("x")).select(F.col("x.done").alias("doc_id"), "x.n_words", F.lit(0).cast("long").alias("n_removed"), F.col("x.sha").alias("kept_sha256"))
    return done.unionByName(rest)
