"""Exact token counts of every prefix of a text, for a sentencepiece BPE model.

No piece of the model has a space mark after another character, so merges never cross the
start of a run of spaces: a text is a sequence of units (spaces, then other characters) that
encode independently. The dynamic program therefore runs on units: the count at a unit's end is the
count at its start plus the unit's own, and within a unit the counts of its prefixes follow the
chain of last tokens (a token extends a prefix if the two last tokens encode to themselves).
The stored program of a text is one signed byte per character, by how much the count of the prefix that ends there differs from that of the
prefix before it (four bytes each, little-endian, in a text where a step needs more); running sums answer truncation and budget questions without encoding again.

Units are worked out once per worker, new ones in alphabetical order, so that each goes on from what it shares with the
one before it; a bounded table, looked up by hash and confirmed byte by byte, keeps their programs. The library's own count of each whole unit is
compared; a unit on which the two differ is encoded prefix by prefix.

Defined results: a null text counts as empty and has 0 tokens; a text of spaces only has the
tokens of its spaces; very long units and texts are counted whole; repeated rows each get a row; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from .text import SpanIndex, Texts, chunks, ragged

#: Units, and characters of their programs, kept per worker (about 16 bytes and one); the table starts afresh beyond it.
MAX_UNITS, MAX_CHARS = 2_000_000, 64_000_000
#: Steps from -BYTE to BYTE - 1 are one byte; half of that for a text's first, which two steps are added up in.
BYTE = 64
_MARK = "▁".encode()


class PrefixCounter:
    """Counts for one model file."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece crosses the start of a word; units would not be independent")
        spec = sentencepiece_model_pb2.ModelProto.FromString(self.model.serialized_model_proto())
        spec.normalizer_spec.add_dummy_prefix = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        every = [self.model.id_to_piece(i) for i in range(self.model.vocab_size()) if i != self.model.unk_id()]
        self.pieces = {p for p, got in zip(every, self.plain.encode(every, out_type=str), strict=True) if got == [p]}
        # lengths of the pieces that end with a pair of characters, the longest first
        lengths: dict[str, set[int]] = {}
        for p in self.pieces:
            if len(p) > 1:
                lengths.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {tail: (*sorted(n, reverse=True), 1) for tail, n in lengths.items()}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.index = SpanIndex()
        self.begin, self.size, self.values, self.flat, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.int8), 0

    def units(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the units of all documents, whether each is its document's first, and unit bounds by document."""
        d, off = t.data, t.offsets
        space = d == 32
        start = space.copy()
        if len(d):
            start[1:] &= ~space[:-1]
        first = off[:-1][np.diff(off) > 0]
        start[first] = True
        # a space that follows a document's end starts a unit there only, which ``first`` has marked
        starts = np.flatnonzero(start)
        bounds = np.searchsorted(starts, off)
        ends = np.append(starts[1:], len(d)) if len(starts) else starts
        lead = np.zeros(len(starts), bool)
        lead[np.searchsorted(starts, first)] = True
        return starts, ends, lead, bounds

    def _entries(self, t: Texts) -> tuple[np.ndarray, ...]:
        """Unit ends, whether each is its document's first, unit bounds by document, and the table entry of each unit."""
        starts, ends, lead, bounds = self.units(t)
        # the mark of the first space (or of the prefix that the model adds) is added by encoding
        inner = np.where(lead, starts, starts + 1)
        if len(self.index) > MAX_UNITS or self.n > MAX_CHARS:
            self._clear()
        entry, new = self.index.numbers(t.data, inner, ends)
        if new:
            self._add([u.decode() for u in new])
        return ends, lead, bounds, entry

    def _add(self, units: list[str]) -> None:
        known = [len(x) if u else 1 for u, x in zip(units, self.model.encode(units, num_threads=1), strict=True)]
        programs: list[list[int]] = [[]] * len(units)
        state: tuple[str, list[int], list[str | None]] = ("", [0], [None])
        for i in sorted(range(len(units)), key=units.__getitem__):
            state = self._extended(state, "▁" + units[i].replace(" ", "▁"))
            programs[i] = state[1][1:]
            if programs[i][-1] != known[i]:
                programs[i] = [len(x) if x else 1 for x in self.model.encode([units[i][:k] for k in range(len(units[i]) + 1)])]
        size = np.fromiter(map(len, programs), np.int64, len(programs))
        flat = np.fromiter((x for y in programs for x in y), np.int64, int(size.sum()))
        steps = np.diff(flat, prepend=0)
        begin = np.cumsum(size) - size
        steps[begin[1:]] = flat[begin[1:]]
        if len(steps) and self.flat.dtype != np.int32 and not -BYTE <= steps.min() <= steps.max() < BYTE:
            self.flat = self.flat.astype(np.int32)
        if self.n + len(steps) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.n], np.zeros(max(len(self.flat), len(steps)), self.flat.dtype)])
        self.flat[self.n : self.n + len(steps)] = steps
        self.begin, self.size, self.values = np.concatenate([self.begin, self.n + begin]), np.concatenate([self.size, size]), np.concatenate([self.values, np.array(known, np.int64)])
        self.n += len(steps)

    def counts(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit ends (bytes), cumulative token counts at them within their document, and unit bounds by document."""
        ends, _, bounds, entry = self._entries(t)
        total = np.concatenate([[0], np.cumsum(self.values[entry])])
        return ends, total[1:] - np.repeat(total[bounds[:-1]], np.diff(bounds)), bounds

    def program(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Steps of the count from character to character of all documents, and their character bounds."""
        _, lead, bounds, entry = self._entries(t)
        # a unit that opens a document has the model's mark, which is no character of the text: its step is carried into the next
        begin, size = self.begin[entry] + lead, self.size[entry] - lead
        steps = self.flat[ragged(begin, size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        opening = lead & (size > 0)
        steps[ends[:-1][opening]] += self.flat[self.begin[entry][opening]]
        return steps, ends[bounds]

    def _extended(self, state: tuple[str, list[int], list[str | None]], unit: str) -> tuple[str, list[int], list[str | None]]:
        """Counts and last tokens of all prefixes of a unit, going on from the part that ``state`` shares with it."""
        before, count, last = state
        n = 0
        for a, b in zip(before, unit, strict=False):
            if a != b:
                break
            n += 1
        count, last = count[: n + 1], last[: n + 1]  # None: nothing that could merge stands before
        pieces, pairs, lengths = self.pieces, self._pairs, self.lengths
        for end in range(n + 1, len(unit) + 1):
            for k in lengths.get(unit[end - 2 : end], (1,)) if end > 1 else (1,):
                start = end - k
                if start >= 0 and (piece := unit[start:end]) in pieces:
                    ahead = last[start]
                    good = True if ahead is None else pairs.get((ahead, piece))
                    if good is None:
                        if len(pairs) > 1 << 20:
                            pairs.clear()
                        good = pairs[ahead, piece] = self.plain.encode(ahead + piece, out_type=str) == [ahead, piece]
                    if good:
                        count.append(count[start] + 1)
                        last.append(piece)
                        break
            else:  # a character outside the vocabulary is its bytes, and merges with nothing
                count.append(count[end - 1] + len(unit[end - 1].encode()))
                last.append(None)
        return unit, count, last

    def within(self, unit: str) -> list[int]:
        """Token counts of all prefixes of a unit (with its marks), by the chain of last tokens."""
        return self._extended(("", [0], [None]), unit.replace(" ", "▁"))[1][1:]

    def prefixes(self, text: str) -> list[int]:
        """Token counts of ``text[:1]``, ``text[:2]``, ... ."""
        out: list[int] = []
        base, i, n = 0, 0, len(text)
        text = text.replace("▁", " ")
        while i < n:
            j = i
            while j < n and text[j] == " ":
                j += 1
            while j < n and text[j] != " ":
                j += 1
            got = self.within(text[i:j] if i else " " + text[i:j])
            got = got if i else got[1:]
            out += [base + x for x in got]
            base = out[-1]
            i = j
        return out


@lru_cache(4)
def counter(path: str) -> PrefixCounter:
    """The worker's counter for a model file."""
    return PrefixCounter(path)


def unmarked(t: Texts) -> Texts:
    """The model treats its space mark as a space; so do the units."""
    if _MARK not in t.data.tobytes():
        return t
    parts = [t.bytes_of(i).replace(_MARK, b" ") for i in range(len(t))]
    return Texts(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))


def stored(steps: np.ndarray) -> bytes:
    """One byte a step, or four where one is too small."""
    if steps.dtype != np.int8 and len(steps) and not -128 <= steps.min() <= steps.max() < 128:
        return steps.astype("<i4").tobytes()
    return steps.astype(np.int8).tobytes()


def steps_of(program: bytes, n_chars: int) -> np.ndarray:
    """The steps of a stored program of a text of ``n_chars`` characters."""
    return np.frombuffer(program, np.int8 if len(program) == n_chars else "<i4")


def prefix_counts(docs: DataFrame, path: str, keep: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_chars, n_tokens and, if ``keep``, ``program``: the stored steps of the count, one signed byte per character."""
    program_field = [T.StructField("program", T.BinaryType())] if keep else []
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_chars", "n_tokens")], *program_field])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = counter(path)
        for b in batches:
            for i, j, t in chunks(b.column(1)):
                sizes = np.diff(t.offsets)
                steps, bounds = program.program(unmarked(t))
                total = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
                columns = [b.column(0).slice(i, j - i), pa.array(sizes), pa.array(np.diff(bounds)), pa.array(total[bounds[1:]] - total[bounds[:-1]])]
                if keep:
                    columns.append(pa.array([stored(steps[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def answers(programs: DataFrame, budget: int) -> DataFrame:
    """``programs`` without the program, with ``fits``: characters of the longest prefix of at most ``budget`` tokens, from the stored counts alone."""
    schema = T.StructType([*[f for f in programs.schema.fields if f.name != "program"], T.StructField("fits", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fits = []
            for program, n_chars in zip(b.column("program").to_pylist(), b.column("n_chars").to_pylist(), strict=True):
                within = np.flatnonzero(np.cumsum(steps_of(program, n_chars), dtype=np.int64) <= budget)
                fits.append(int(within[-1]) + 1 if len(within) else 0)  # counts can fall as a text grows: the last, not the first excess
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in schema.names[:-1]], pa.array(fits, pa.int64())], names=schema.names)

    return programs.select(*schema.names[:-1], "program").mapInArrow(run, schema)


def longest_within(budget: Column | int) -> Column:
    """From a stored program (columns ``program`` and ``n_chars``): characters of the longest prefix with at most ``budget`` tokens."""
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    wide = F.octet_length("program") > F.col("n_chars")
    number = lambda h: F.conv(h, 16, 10).cast("long")
    byte = lambda h: F.when(number(h) > 127, number(h) - 256).otherwise(number(h))
    four = lambda h: F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    word = lambda h: F.when(number(four(h)) > 0x7FFFFFFF, number(four(h)) - (1 << 32)).otherwise(number(four(h)))
    cut = lambda n: F.regexp_extract_all(F.hex("program"), F.lit("." * n), F.lit(0))
    steps = F.when(wide, F.transform(cut(8), word)).otherwise(F.transform(cut(2), byte))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("best"))
    step = lambda a, x: F.struct((a.i + 1).alias("i"), (a.n + x).alias("n"), F.when(a.n + x <= budget, a.i + 1).otherwise(a.best).alias("best"))
    return F.aggregate(steps, start, step, lambda a: a.best)
