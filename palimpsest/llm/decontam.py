"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Words (lower-cased A-Z) are the symbols. The CGK random walk reads a word sequence with a pointer that
moves on or stays by a random bit of (step, word); the symbols it reads, step by step, are the
embedding, and sequences at small edit distance get embeddings at small Hamming distance, because a walk
that an edit has shifted falls into step again. Bit-sampling LSH hashes a few random steps of the
embedding.

Items are embedded at the largest size of a grid (each size a tenth over the last) that they fill, by steps over the
whole walk, twice the size. Walks are repeated, size by size, until the recall that is measured reaches the target: items of
the size get random edits up to the bound (substitutions alone, insertions and deletions alone, both), and
a trial counts as found where some table has the edited window under the item's own key.

Windows of the item's size are probed at every word of every document where a match can start: an item with k edits at most, cut into
k + 1 parts, keeps one part whole, so a start is possible only if some word sequence of that
length that an item holds stands, up to k words away, where the item would have it. This loses nothing. Matching starts are verified
exactly: the least word edit distance between the whole item and the text from there.

A document is contaminated by an item if some window has an edit distance of at most
``floor(max_edits * item words)``. Items of fewer than ``least`` words say little; they are matched whole and without
edits, and reported in a column of their own, ``short_item_ids``, which ``clean`` leaves aside unless told otherwise.

Benchmark items are held in blocks of bounded size; each block is one pass over the documents, written before the next block
is read, so the driver holds one block at a time.

Defined results: null or empty texts and items match nothing; repeated rows each get the result; documents of any
length are searched whole; null item_ids match as null; an empty benchmark leaves every document clean; extra
columns pass through (those named like a result are replaced by it; ``clean`` keeps all).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import written
from .text import Texts, U64, chunks, mix, ragged, span_hash, splitmix, window_hash

PAD = U64(0)
_M = U64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Lsh:
    """Parameters: edit share, target recall, trials that measure it, tables per walk, sampled steps per table, most walks, least item size, step of the grid, block size of the benchmark."""

    max_edits: float = 0.1
    recall: float = 0.99
    trials: int = 300
    tables: int = 4
    sampled: int = 3
    most_walks: int = 64
    least: int = 8
    growth: float = 1.1
    block_bytes: int = 32 << 20
    seed: int = 11

    def size_of(self, words: int) -> int:
        """The largest size of the grid that ``words`` words fill."""
        size = self.least
        while (larger := max(size + 1, int(size * self.growth))) <= words:
            size = larger
        return size


def _symbols(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with one pad after each document, and the bounds of the documents' words in it."""
    starts, ends, bounds = t.words()
    n = np.diff(bounds)
    out = np.full(len(starts) + len(n), PAD, U64)
    first = bounds[:-1] + np.arange(len(n))
    out[ragged(first, n)] = np.maximum(span_hash(t.data, starts, ends, lower=True), U64(1))
    return out, np.stack([first, first + n])


def _steps(size: int, walk: int, p: Lsh) -> list[list[int]]:
    """The sampled steps of each table of a walk, for windows of ``size`` words, out of ``2 * size``."""
    r = splitmix(p.seed * 1_000_003 + size * 1009 + walk, p.tables * p.sampled * 8).astype(object)
    out, k = [], 0
    for _ in range(p.tables):
        got: list[int] = []
        while len(got) < p.sampled:
            j = int(r[k]) % (2 * size)
            k += 1
            if j not in got:
                got.append(j)
        out.append(sorted(got))
    return out


def embed(symbols: np.ndarray, starts: np.ndarray, sizes: list[int], walk: int, p: Lsh) -> Iterator[tuple[int, int, np.ndarray]]:
    """(size, table, key of each start): hashes of the sampled steps of one walk from all ``starts``.

    A window ends after ``size`` words, or where the document ends; beyond that the walk reads padding.
    """
    plan: dict[int, list[tuple[int, int]]] = {}
    for size in sizes:
        for table, steps in enumerate(_steps(size, walk, p)):
            for j in steps:
                plan.setdefault(j, []).append((size, table))
    left = {(size, table): p.sampled for size in sizes for table in range(p.tables)}
    keys = {t: np.zeros(len(starts), U64) for t in left}
    turns = splitmix(p.seed * 7919 + walk, 2 * max(sizes, default=0)) | U64(1)
    q = starts.astype(np.int64)
    for j in range(len(turns)):
        read = symbols[q]
        ahead = q - starts if j in plan else None
        for t in plan.get(j, ()):
            k = keys[t]
            with np.errstate(over="ignore"):
                k ^= np.where(ahead < t[0], read, PAD)
                k *= _M
            k ^= k >> U64(29)
            left[t] -= 1
            if not left[t]:
                yield t[0], t[1], keys.pop(t)
        if not keys:
            break
        with np.errstate(over="ignore"):
            q += ((read * turns[j]) >> U64(63)).view(np.int64)  # padding is 0: a walk stays where the document ends


def edited(words: np.ndarray, k: int, kind: int, r: np.random.Generator) -> np.ndarray:
    """``words`` with ``k`` random edits: substitutions (kind 0), insertions and deletions (1), or all of them (2)."""
    out = words.tolist()
    for _ in range(k):
        act = 0 if kind == 0 else int(r.integers(1, 3)) if kind == 1 else int(r.integers(3))
        at = int(r.integers(len(out)))
        if act == 2:
            del out[at]
        else:
            out[at : at + (act == 0)] = [int(words[r.integers(len(words))]) ^ int(r.integers(1 << 20))]
    return np.array(out, U64)


def _walks(items: list[np.ndarray], size: int, p: Lsh) -> int:
    """Walks after which the measured recall of items of one size, edited up to the bound, is at the target."""
    r = np.random.default_rng(p.seed + size)
    rows, texts = [], []
    for trial in range(p.trials):
        item = items[int(r.integers(len(items)))]
        text = edited(item, int(p.max_edits * len(item)), trial % 3, r)
        after = items[int(r.integers(len(items)))]  # a text goes on behind its window
        rows.append([*item[:size], PAD])
        texts.append([*np.concatenate([text, after, after])[:size], PAD])
    flat = [np.array(x, U64).ravel() for x in (rows, texts)]
    starts = np.arange(p.trials) * (size + 1)
    found = np.zeros(p.trials, bool)
    for walk in range(p.most_walks):
        for (_, _, a), (_, _, b) in zip(*(embed(f, starts, [size], walk, p) for f in flat), strict=True):
            found |= a == b
        if found.mean() >= p.recall:
            return walk + 1
    return p.most_walks


class _Set:
    """Sorted distinct keys behind a bitmap of their first bits."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.unique(keys)
        self.shift = U64(64 - min(26, max(16, (32 * len(self.keys)).bit_length())))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[self.keys >> self.shift] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``keys`` that are in the set, and where in it."""
        at = np.flatnonzero(self.seen[keys >> self.shift])
        where = np.searchsorted(self.keys, keys[at])
        ok = self.keys[where.clip(max=len(self.keys) - 1)] == keys[at] if len(self.keys) else np.zeros(len(at), bool)
        return at[ok], where[ok]


class Index:
    """LSH tables over a block of items."""

    def __init__(self, items: list[tuple[object, str]], p: Lsh) -> None:
        self.p, self.ids, self.words, self.short = p, [], [], {}
        parts = [text.encode() for _, text in items]
        t = Texts(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64))
        symbols, bounds = _symbols(t)
        by_size: dict[int, list[int]] = {}
        brief: dict[int, list[tuple[int, object]]] = {}
        for (item, _), a, b in zip(items, *bounds, strict=True):
            n = int(b - a)
            if n >= p.least:
                by_size.setdefault(p.size_of(n), []).append(len(self.ids))
                self.ids.append(item)
                self.words.append(symbols[a:b])
            elif n:
                brief.setdefault(n, []).append((int(window_hash(symbols[a:b], n)[0]), item))
        for n, rows in brief.items():
            keys = _Set(np.array([k for k, _ in rows], U64))
            self.short[n] = keys, [[item for k, item in rows if k == key] for key in keys.keys.tolist()]
        # the parts that a match keeps whole, and where in items they stand
        self.part = min((len(w) // (int(p.max_edits * len(w)) + 1) for w in self.words), default=1) or 1
        grams = [window_hash(w, self.part) for w in self.words]
        every = np.concatenate(grams) if grams else np.empty(0, U64)
        self.grams = _Set(every)
        place, edits = (np.concatenate([f(w, g) for w, g in zip(self.words, grams, strict=True)]) if grams else np.empty(0, np.int64) for f in (lambda _, g: np.arange(len(g)), lambda w, g: np.full(len(g), int(p.max_edits * len(w)))))
        at = np.searchsorted(self.grams.keys, every)
        self.first, self.last = np.full(len(self.grams.keys), 1 << 40), np.full(len(self.grams.keys), -(1 << 40))
        np.minimum.at(self.first, at, place - edits)
        np.maximum.at(self.last, at, place + edits)
        # walks, size by size
        self.walks = {size: _walks([self.words[m] for m in members], size, p) for size, members in sorted(by_size.items())}
        self.tables: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}
        for size, members in by_size.items():
            rows = np.array([[*self.words[m][:size], PAD] for m in members], U64)
            for walk in range(self.walks[size]):
                for _, table, key in embed(rows.ravel(), np.arange(len(members)) * (size + 1), [size], walk, p):
                    order = np.argsort(key, kind="stable")
                    self.tables[size, walk, table] = key[order], np.array(members)[order]

    def starts(self, symbols: np.ndarray) -> np.ndarray:
        """Words at which a match can start."""
        at, where = self.grams.find(window_hash(symbols, self.part))
        edge = np.zeros(len(symbols) + 1, np.int64)
        np.add.at(edge, (at - self.last[where]).clip(0, len(symbols)), 1)
        np.add.at(edge, (at - self.first[where] + 1).clip(0, len(symbols)), -1)
        return np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (symbols != PAD))

    def search(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, least edits) of every contamination."""
        return self._search(*_symbols(t))

    def _search(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.empty(0, np.int64)
        starts = self.starts(symbols) if self.words and len(symbols) else none
        if not len(starts):
            return none, none, none
        pairs = []
        for walk in range(max(self.walks.values())):
            for size, table, key in embed(symbols, starts, [s for s, n in self.walks.items() if n > walk], walk, self.p):
                keys, members = self.tables[size, walk, table]
                lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                n = hi - lo
                if n.any():
                    pairs.append(members[ragged(lo, n)] * len(symbols) + np.repeat(starts, n))
        if not pairs:
            return none, none, none
        pairs = np.column_stack(np.divmod(np.unique(np.concatenate(pairs)), len(symbols)))
        found = []
        cut = np.flatnonzero(np.diff(pairs[:, 0], prepend=-1, append=-1))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            item = int(pairs[a, 0])
            for lo in range(a, b, 20_000):
                at, edits = self.verify(symbols, pairs[lo : min(b, lo + 20_000), 1], item)
                found.append(np.column_stack([np.searchsorted(bounds[0], at, "right") - 1, np.full(len(at), item), edits]))
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        return tuple(rows[first].T)

    def verify(self, symbols: np.ndarray, at: np.ndarray, item: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts whose text is within the item's edits, with the least edit distance over the text's ends."""
        words = self.words[item]
        n = len(words)
        most = int(self.p.max_edits * n)
        reach = np.arange(n + most)
        # beyond the last symbol, and beyond a pad, there is padding only
        where = at[:, None] + reach
        text = np.where(where < len(symbols), symbols[np.minimum(where, len(symbols) - 1)], PAD)
        text[np.logical_or.accumulate(text == PAD, axis=1)] = PAD
        # each edit changes at most one word of the window, so most of it must be words of the item
        enough = np.isin(text, words).sum(axis=1) >= n - most
        at, text = at[enough], text[enough]
        if not len(at):
            return at, at
        row = np.broadcast_to(np.arange(n + 1), (len(at), n + 1)).copy()
        best = row[:, n].copy()
        ramp = np.arange(n + 1)
        for k in range(n + most):
            word = text[:, k]
            new = row + 1
            np.minimum(new[:, 1:], row[:, :-1] + (words != word[:, None]), out=new[:, 1:])
            new = np.minimum.accumulate(new - ramp, axis=1) + ramp
            new[word == PAD] = n + most + 1
            row = new
            np.minimum(best, row[:, n], out=best)
        ok = best <= most
        return at[ok], best[ok]

    def exact(self, symbols: np.ndarray, bounds: np.ndarray) -> dict[int, set]:
        """For each document with one, the items under ``least`` words that stand in it."""
        out: dict[int, set] = {}
        for n, (keys, ids) in self.short.items():
            at, where = keys.find(window_hash(symbols, n))
            for d, w in set(zip((np.searchsorted(bounds[0], at, "right") - 1).tolist(), where.tolist(), strict=True)):
                out.setdefault(d, set()).update(ids[w])
        return out


def _blocks(benchmark: DataFrame, p: Lsh) -> Iterator[list[tuple[object, str]]]:
    block, size = [], 0
    for r in benchmark.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if size >= p.block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminations(docs: DataFrame, benchmark: DataFrame, p: Lsh = Lsh()) -> DataFrame:
    """All columns of ``docs`` with ``item_ids`` (items that contaminate the text, sorted), ``least_edits`` (null if none) and ``short_item_ids``."""
    item_type = benchmark.schema["item_id"].dataType
    kinds = {"item_ids": T.ArrayType(item_type), "least_edits": T.IntegerType(), "short_item_ids": T.ArrayType(item_type)}
    found = T.StructType([T.StructField(n, k) for n, k in kinds.items()])
    columns = [f for f in docs.schema.fields if f.name not in kinds]

    def one_pass(df: DataFrame, items: list[tuple[object, str]]) -> DataFrame:
        index = Index(items, p)
        ordered = lambda ids: sorted(ids, key=lambda x: (x is not None, x))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                names = b.schema.names
                for i, j, t in chunks(b.column(b.num_columns - 1)):
                    symbols, bounds = _symbols(t)
                    doc, item, edits = index._search(symbols, bounds)
                    cut = np.searchsorted(doc, np.arange(len(t) + 1))
                    before, least, brief = (b.column(names.index(n)).slice(i, j - i).to_pylist() for n in kinds)
                    for d in np.flatnonzero(np.diff(cut)).tolist():
                        before[d] = ordered({index.ids[k] for k in item[cut[d] : cut[d + 1]]} | set(before[d]))
                        low = int(edits[cut[d] : cut[d + 1]].min())
                        least[d] = low if least[d] is None else min(low, least[d])
                    for d, ids in index.exact(symbols, bounds).items():
                        brief[d] = ordered(ids | set(brief[d]))
                    kept = [b.column(k).slice(i, j - i) for k in range(len(columns))]
                    results = [pa.array(v, b.schema.field(n).type) for n, v in zip(kinds, (before, least, brief), strict=True)]
                    yield pa.RecordBatch.from_arrays([*kept, *results], names=names[:-1])

        names = [F.col(f"`{f.name}`") for f in columns]
        return df.select(*names, *kinds, F.col("text").alias("__text")).mapInArrow(run, T.StructType(columns + found.fields))

    none = {n: (F.array() if n != "least_edits" else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()}
    out = docs.select(*[F.col(f"`{f.name}`") for f in columns], *none.values())
    blocks = _blocks(benchmark, p)
    first = next(blocks, None)
    if first is not None:
        out = one_pass(out, first)
    for items in blocks:
        out = one_pass(written(out, "decontaminated"), items)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, p: Lsh = Lsh(), short: bool = False) -> DataFrame:
    """The documents that no benchmark item contaminates, with the columns they came with; with ``short`` no item under ``least`` words either."""
    own = ["text" if c == "text" else f"__own{i}" for i, c in enumerate(docs.columns)]  # so that no column is taken for a result
    found = contaminations(docs.toDF(*own), benchmark, p)
    kept = found.where((F.size("item_ids") == 0) & ((F.size("short_item_ids") == 0) | F.lit(not short)))
    return kept.select(*own).toDF(*docs.columns)
