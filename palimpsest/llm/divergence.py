"""Source divergence audit: how far the sources of a language are apart in their terms, and which terms set each one apart.

Every source of a language, and the language itself, gives each of the language's V kept terms a smoothed share in billionths; the
divergence of two shares p, q is ``f = floor((p - q)^2 / (p + q))``.

An inverted index holds, for each kept term, the postings (source, share) of the sources that use it. A pair of sources starts at its
baseline, V times the f of the two shares of a term that neither uses. Postings correct that, and only where the correction is not zero: a posting of the
one source corrects the term as if the other had none of it (f against the other's least share), a posting of the other likewise, and a term that
both use gets the rest. Sums are integers of 64 bits, so the result does not depend on the order.

Postings meet by (language, bucket of terms, two blocks of sources): a task holds at most ``BUCKET`` terms of about ``2 * BLOCK`` sources, whatever
the size of a source or term, and returns one partial sum for each pair of its sources, with copies of a value worked out once. f is symmetric, so a pair is
summed once. Which terms and sources there are is counted over all documents: every task adds up its texts first, so a source or term
that holds a third of all rows is a row for each task.

``audit`` ranks the terms of a group by windows with a bound on the rank, which Spark applies before rows are dealt.

Defined results: null text, lang and source count as empty strings; a group without kept terms has pairs (0 each if V is 0) and no terms; rows that
repeat are counted each; texts of any length are counted whole, in parts; doc_id is not used; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Terms in a bucket and sources in a block: a task meets the postings of one bucket from two blocks.
BUCKET, BLOCK = 512, 128
#: Bytes of a text that are read at a time, and distinct (group, term) entries that a task gathers before it sends them.
STEP, ENTRIES = 1 << 20, 400_000
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_GAP = re.compile(rb"[^A-Za-z\x80-\xff]")


def _parts(text: bytes) -> Iterator[bytes]:
    """``text`` in steps that end between terms."""
    a = 0
    while a < len(text):
        gap = _GAP.search(text, a + STEP) if a + STEP < len(text) else None
        b = gap.start() if gap else len(text)
        yield text[a:b]
        a = b


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); a row without a term marks that the group occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def send() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in groups.items():
                terms = [None, *n]
                size = len(terms)
                names = pa.array([None if t is None else t.decode() for t in terms], pa.string())
                counts = [pa.array([0, *(c[t] for t in n)], pa.int64()) for c in (n, d)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), names, *counts], names=["lang", "source", "term", "n", "docs"])
            groups.clear()

        held = 0
        for b in batches:
            for text, lang, source in zip(*(b.column(i) for i in range(3)), strict=True):
                n, d = groups.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                value = text.as_buffer()
                seen: set[bytes] = set()
                for part in _parts(memoryview(value).tobytes() if value else b""):
                    found = _TERM.findall(part.translate(_LOWER))
                    n.update(found)
                    seen.update(found)
                held -= len(d)
                d.update(seen)
                held += len(d) + 1
                if held > ENTRIES:
                    yield from send()
                    held = 0
        yield from send()

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    each = docs.select(empty("text"), empty("lang"), empty("source")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, whole: Column, v: Column) -> Column:
    """Smoothed share in billionths; decimals, as the product can pass 64 bits."""
    up, down = (n + 2).cast("decimal(20,0)"), (whole + 2 * v).cast("decimal(20,0)")
    billion = F.lit("1000000000").cast("decimal(10,0)")
    return F.call_function("div", up * billion, down) + 1


def index(docs: DataFrame, least_docs: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The kept terms (lang, term, n, number in the lang), the groups (lang, source, v, whole, zero: the share of an unused term) and the postings (lang, source, term, n, p)."""
    counts = written(term_counts(docs), "term-counts")
    terms = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    terms = written(terms, "terms")
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_whole"))
    kept = counts.where("term IS NOT NULL").join(terms.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n")
    kept = written(kept, "kept-counts")
    groups = counts.where("term IS NULL").select("lang", "source").join(langs, "lang", "left").join(kept.groupBy("lang", "source").agg(F.sum("n").alias("whole")), ["lang", "source"], "left").fillna(0)
    groups = written(groups.withColumn("zero", F.when(F.col("v") > 0, _share(F.lit(0), F.col("whole"), F.col("v"))).otherwise(0)), "groups")
    postings = kept.join(groups.select("lang", "source", "whole", "v", "zero"), ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("whole"), F.col("v")))
    return terms, groups, postings


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _pair_sums(source: np.ndarray, block: np.ndarray, term: np.ndarray, p: np.ndarray, zero: np.ndarray, blocks: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corrections of the pairs between two blocks (or in one): numbers of the sources, and sums.

    ``source``, ``term`` and ``p`` are the postings; ``block`` and ``zero`` belong to the numbered sources.
    """
    order = np.lexsort((term, source))
    source, term, p = source[order], term[order], p[order]
    bounds = np.searchsorted(source, np.arange(len(zero) + 1))
    left, right = np.flatnonzero(block == blocks[0]), np.flatnonzero(block == blocks[1])
    n_terms = int(term.max(initial=-1)) + 1

    def alone(a: int, others: np.ndarray) -> np.ndarray:
        """Corrections of a's postings as if the others had none of its terms; equal shares once."""
        values, times = np.unique(p[bounds[a] : bounds[a + 1]], return_counts=True)
        q = zero[others]
        change = divergence(values[:, None], q[None, :]) - divergence(zero[a], q)[None, :]
        return (change * times[:, None]).sum(0)

    # the postings of the right block, source after source
    at = np.concatenate([np.arange(bounds[b], bounds[b + 1]) for b in right] or [np.empty(0, np.int64)])
    ends = np.cumsum(bounds[right + 1] - bounds[right])
    r_term, r_p, r_zero = term[at], p[at], zero[source[at]]
    out = np.zeros((len(left), len(right)), np.int64)
    for i, a in enumerate(left):
        mine = np.zeros(n_terms, np.int64)
        mine[term[bounds[a] : bounds[a + 1]]] = p[bounds[a] : bounds[a + 1]]
        both = np.flatnonzero(mine[r_term] > 0)
        x, y, least = mine[r_term[both]], r_p[both], r_zero[both]
        change = divergence(x, y) - divergence(x, least) - divergence(zero[a], y) + divergence(zero[a], least)
        total = np.concatenate([[0], np.cumsum(change)])[np.searchsorted(both, np.concatenate([[0], ends]))]
        out[i] = np.diff(total) + alone(a, right)
    for j, b in enumerate(right):
        out[:, j] += alone(b, left)
    x, y = np.repeat(left, len(right)), np.tile(right, len(left))
    keep = x < y if blocks[0] == blocks[1] else np.ones(len(x), bool)
    return x[keep], y[keep], out.ravel()[keep]


def pairs(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, source, item (another source), value: the divergence of every pair of sources of a language, both ways."""
    sizes = groups.groupBy("lang").agg(F.count("*").alias("n_sources"))
    n_blocks = F.ceil(F.col("n_sources") / BLOCK)
    n_buckets = F.greatest(F.ceil(F.col("v") / BUCKET), F.lit(1))
    known = groups.join(sizes, "lang").select("lang", "source", "v", "zero", n_blocks.alias("n_blocks"), n_buckets.alias("n_buckets"))
    block = F.pmod(F.xxhash64(F.lit("block"), "source"), F.col("n_blocks")).cast("int")
    known = known.withColumn("block", block)
    used = postings.select("lang", "source", "term", "p").join(known, ["lang", "source"])
    bucket = F.pmod(F.xxhash64(F.lit("bucket"), "term"), F.col("n_buckets")).cast("int")
    # a source is told to every bucket, so that a task knows the sources that use none of its terms
    told = known.withColumn("bucket", F.explode(F.expr("sequence(0, CAST(n_buckets AS INT) - 1)"))).select("lang", "source", "block", "n_blocks", "v", "zero", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("p"), "bucket")
    rows = used.withColumn("bucket", bucket).select(*told.columns).unionByName(told)
    # to every other block; ``one`` <= ``two``
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, CAST(n_blocks AS INT) - 1)")))
    rows = rows.select("lang", "bucket", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "source", "block", "v", "zero", "term", "p")

    def run(table: pa.Table) -> pa.Table:
        marks = table.filter(pc.is_null(table.column("term")))
        names = marks.column("source").combine_chunks()
        use = table.filter(pc.is_valid(table.column("term")))
        source = pc.index_in(use.column("source"), value_set=names).to_numpy()
        term = use.column("term").combine_chunks().dictionary_encode()
        term = np.asarray(term.indices if isinstance(term, pa.DictionaryArray) else term.combine_chunks().indices, np.int64)
        one, two, bucket, lang = (table.column(c)[0].as_py() for c in ("one", "two", "bucket", "lang"))
        zero, block = marks.column("zero").to_numpy(), marks.column("block").to_numpy()
        a, b, value = _pair_sums(source, block, term, use.column("p").to_numpy(), zero, (one, two))
        if bucket == 0 and (v := marks.column("v")[0].as_py()):
            value = value + v * divergence(zero[a], zero[b])
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "value": pa.array(value, pa.int64())})

    sums = rows.groupBy("lang", "bucket", "one", "two").applyInArrow(run, "lang string, a string, b string, value long")
    summed = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return summed.select("lang", "value", ways.alias("x")).select("lang", "x.source", "x.item", "value")


def term_scores(terms: DataFrame, groups: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, source, item (a term that the source uses more than its language), value."""
    whole = groups.groupBy("lang").agg(F.max("v").alias("v"), F.max("lang_whole").alias("lang_whole"))
    shares = terms.join(whole, "lang").select("lang", "term", _share(F.col("n"), F.col("lang_whole"), F.col("v")).alias("q"))
    both = postings.where("n > 0").select("lang", "source", "term", "p").join(shares, ["lang", "term"]).where("p > q")
    return both.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))


def audit(docs: DataFrame, least_docs: int = 10, top_terms: int = 10) -> DataFrame:
    """lang, source, part ('pair': other sources; 'term': terms that set the source apart), item, value, rank."""
    terms, groups, postings = index(docs, least_docs)
    postings = written(postings.select("lang", "source", "term", "n", "p"), "postings")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    # whole texts of terms and sources are compared by their bytes
    far = pairs(groups, postings).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    top = term_scores(terms, groups, postings).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    return far.unionByName(top.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
