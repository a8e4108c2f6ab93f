"""Word splitting and hashing on bytes."""

import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from palimpsest.llm import measures, minhash_forest, packing, prefix_tokens, substring_dedup, text
from palimpsest.llm.text import SpanIndex, chunks, sequence_hash, span_hash, window_hash

DOCS = [None, "", "a", "  a b\n", "ß x\x0by", "a b c a b c a b c", " ", "x"]


@pytest.mark.parametrize("limit", [1, 50, 10**6])
def test_words_and_hashes(limit):
    random.seed(1)
    docs = DOCS + ["".join(random.choice("ab \n\té") for _ in range(random.randrange(60))) for _ in range(300)]
    seen, got = {}, []
    for _, _, t in chunks(pa.array(docs), limit):
        starts, ends, bounds = t.words()
        h = span_hash(t.data, starts, ends)
        for k in range(len(t)):
            words = [t.data[a:b].tobytes().decode() for a, b in zip(starts[bounds[k] : bounds[k + 1]], ends[bounds[k] : bounds[k + 1]], strict=True)]
            got.append(words)
            for w, x in zip(words, h[bounds[k] : bounds[k + 1]], strict=True):
                assert seen.setdefault(w, x) == x
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", d or "") for d in docs]
    assert len(set(seen.values())) == len(seen)


def test_windows_of_equal_words_agree():
    x = window_hash(np.array([1, 2, 3, 1, 2, 3], np.uint64), 3)
    assert x[0] == x[3] and len(set(x.tolist())) == 3
    assert not len(window_hash(np.array([1], np.uint64), 2))


def thue_morse(n, pair="ab"):
    """A word and its complement, which any polynomial hash modulo a power of two confuses."""
    word = "".join(pair[i.bit_count() & 1] for i in range(n))
    return word, word.translate(str.maketrans(pair, pair[::-1]))


def texts(*values):
    return next(chunks(pa.array(values), 1 << 30))[2]


@pytest.mark.parametrize("n", [64, 1024, 4096])
@pytest.mark.parametrize("pair", ["ab", "th", "01"])
def test_no_family_of_words_shares_a_hash(n, pair):
    a, b = thue_morse(n, pair)
    t = texts(a, b, a)
    starts, ends, _ = t.words()
    for lower in (False, True):
        h = span_hash(t.data, starts, ends, lower=lower)
        assert h[0] == h[2] != h[1]
    assert measures.measure(texts(f"{a}\n{b}"))["n_dup_lines"].tolist() == [0]
    values, _ = minhash_forest.shingle_sets(texts(f"A one two {a}", f"A one two {b}"), 4)
    assert len(set(values.tolist())) == 2
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    ids, bounds = words.ids(texts(a, b))
    assert [ids[x : y - 1].tolist() for x, y in zip(bounds[:-1], bounds[1:], strict=True)] == [words.tokenizer.encode(w, add_special_tokens=False).ids for w in (a, b)]
    counter = prefix_tokens.PrefixCounter(public_tokenizers.path("piece_bpe_32k.model"))
    ends, counts, bounds = counter.counts(texts(a, b))
    assert counts.tolist() == [len(counter.model.encode(w)) for w in (a, b)]
    # sequences of word hashes: the same pattern of two words
    x = np.array([1 + (i.bit_count() & 1) for i in range(n)], np.uint64)
    assert window_hash(x, n)[0] != window_hash(3 - x, n)[0] and len(set(sequence_hash(np.concatenate([x, 3 - x]), np.array([0, n, 2 * n])).tolist())) == 2


def test_windows_that_differ_in_a_confusable_word_stay(spark):
    a, b = thue_morse(1024)
    rest = " ".join(f"w{i}" for i in range(34))
    got = substring_dedup.remove_repeats(spark.createDataFrame([(1, f"{rest} {a}"), (2, f"{rest} {b}"), (3, f"{rest} {a}")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 35), (2, 0), (3, 35)]


@pytest.mark.parametrize("limit", [40, 10**6])
def test_spans_that_share_a_hash_keep_their_own_numbers(monkeypatch, limit):
    r = random.Random(4)
    monkeypatch.setattr(text, "span_hash", lambda data, starts, ends: (ends - starts).astype(np.uint64) % 3)
    index, seen = SpanIndex(), []
    words = ["".join(r.choice("abé") for _ in range(r.randrange(1, 9))) for _ in range(200)] + ["x" * 70, "x" * 69 + "y", "x" * 70]
    docs = [" ".join(r.choices(words, k=9)) for _ in range(60)] + [" ".join(words)]
    for i, j, t in chunks(pa.array(docs), limit):
        starts, ends, _ = t.words()
        numbers, new = index.numbers(t.data, starts, ends)
        seen += [w.decode() for w in new]
        assert [seen[n] for n in numbers] == " ".join(docs[i:j]).split()
    assert len(set(seen)) == len(seen) == len(index)


def test_a_step_beyond_one_byte_is_stored_in_four(monkeypatch):
    counter = prefix_tokens.PrefixCounter(public_tokenizers.path("piece_bpe_32k.model"))
    values = ["the cat", "日本 x", ""]
    want = [np.cumsum(counter.program(texts(v))[0], dtype=int).tolist() for v in values]
    monkeypatch.setattr(prefix_tokens, "BYTE", 1)
    wide = prefix_tokens.PrefixCounter(public_tokenizers.path("piece_bpe_32k.model"))
    steps, bounds = wide.program(texts(*values))
    assert steps.dtype == np.int32
    parts = [steps[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert [np.cumsum(prefix_tokens.steps_of(prefix_tokens.stored(x), len(v))).tolist() for x, v in zip(parts, values, strict=True)] == want
    big = np.array([300, -2, 70_000], np.int32)
    assert len(prefix_tokens.stored(big)) == 12 and prefix_tokens.steps_of(prefix_tokens.stored(big), 3).tolist() == big.tolist()
