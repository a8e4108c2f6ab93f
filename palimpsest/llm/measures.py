"""Per-document text measurements, computed on whole Arrow batches with numpy."""

from __future__ import annotations

import numpy as np

from .text import Texts, U64, mix, span_hash, splitmix, window_hash

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_SALT = splitmix(0x5EED, 1)[0]


def _per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _in_doc(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that are equal only for equal keys of one document."""
    with np.errstate(over="ignore"):
        return mix(keys ^ (doc.astype(U64) * _SALT))


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by key, whether each ordered row is its group's first, and each ordered row's group size."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(first)
    return order, first, np.repeat(np.diff(np.append(at, len(s))), np.diff(np.append(at, len(s))))


def measure(t: Texts) -> dict[str, np.ndarray]:
    """Counts of each document of ``t`` (int64); an empty text has 0 everywhere."""
    d, off, n = t.data, t.offsets, len(t)
    starts, ends, bounds = t.words()
    n_words = np.diff(bounds)
    doc = np.repeat(np.arange(n), n_words)
    solid = ~((d == 32) | ((d >= 9) & (d <= 13)))
    lead = (d & 0xC0) != 0x80
    out = {"n_words": n_words.astype(np.int64), "n_bytes": np.diff(off).astype(np.int64)}
    out["word_chars"] = _per_doc(solid & lead, off)
    out["n_symbols"] = _per_doc(_SYMBOLS[d], off)
    out["n_bangs"] = _per_doc(d == ord("!"), off)
    out["n_pipes"] = _per_doc(d == ord("|"), off)
    out["n_digits"] = _per_doc((d >= 48) & (d <= 57), off)
    out["n_upper"] = _per_doc((d >= 65) & (d <= 90), off)
    out["n_lower"] = _per_doc((d >= 97) & (d <= 122), off)
    out["n_high"] = _per_doc((d >= 0xC0), off)
    out["n_stops"] = _per_doc((d == ord(".")) | (d == ord(",")), off)
    # lines
    cut = np.flatnonzero(d == 10)
    line_starts = np.sort(np.concatenate([off[:-1], cut + 1]))
    line_doc = np.concatenate([np.arange(n), np.searchsorted(off, cut, "right") - 1])
    line_doc = np.sort(line_doc)
    line_ends = np.empty_like(line_starts)
    if n:
        line_ends[:-1] = line_starts[1:] - 1
        line_ends[-1] = off[-1]
        last = np.searchsorted(line_doc, np.arange(n), "right") - 1
        line_ends[last] = off[1:]
    seen = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])
    full = seen[np.maximum(line_ends, line_starts)] > seen[line_starts] if n else np.zeros(0, bool)
    line_starts, line_ends, line_doc = line_starts[full], line_ends[full], line_doc[full]
    order, first, _ = _grouped(_in_doc(span_hash(d, line_starts, line_ends), line_doc))
    out["n_lines"] = np.bincount(line_doc, minlength=n).astype(np.int64)
    out["n_dup_lines"] = np.bincount(line_doc[order[~first]], minlength=n).astype(np.int64)
    # words
    h = span_hash(d, starts, ends)
    order, first, _ = _grouped(_in_doc(h, doc))
    out["n_unique"] = np.bincount(doc[order[first]], minlength=n).astype(np.int64)
    out["n_capital"] = np.bincount(doc[(d[starts] >= 65) & (d[starts] <= 90)] if len(starts) else doc, minlength=n).astype(np.int64)
    longest = np.zeros(n, np.int64)
    if len(starts):
        some = n_words > 0
        longest[some] = np.maximum.reduceat(ends - starts, bounds[:-1][some])
    out["longest_word"] = longest
    covered = np.zeros(len(starts), bool)
    w = window_hash(h, 3)
    if len(w):
        at = np.flatnonzero(doc[: len(w)] == doc[2:])
        order, _, size = _grouped(_in_doc(w[at], doc[at]))
        twice = at[order[size >= 2]]
        for k in range(3):
            covered[twice + k] = True
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n).astype(np.int64)
    return out
