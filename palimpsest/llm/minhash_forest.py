"""Near-duplicate groups through an LSH forest with exact confirmation.

1. Every text becomes its set of distinct word shingles; equal sets are one class from here on.
2. Each class gets ``trees * depth`` minhash values. A tree is a sorted order of the classes by its
   signature, so neighbours are those with the longest common prefixes. The depth adapts to the region: where at most ``sparse``
   classes agree on all values but the last, all of them are neighbours; elsewhere those that agree on all ``depth``.
   Neighbours whose one-bit sketches differ too much for the threshold are no candidates. A region of more than ``window`` classes
   that agree to the full depth is taken whole, without a look at sketches.
3. Candidates form coarse groups. Inside a group all links are confirmed on full sets by exact intersection counts.
   A group is ordered by set size and cut into blocks; blocks are first confirmed with their successor. Classes
   that are not in the group's largest component by then are cut into blocks again and confirmed with every block that they could have a
   link with (set sizes alone exclude some). A block is bounded in classes and in shingles, so no task holds more than two blocks of either, a dense group costs
   as much as it has members, and every pair is either compared or known to be in one component.
   A task returns a spanning forest of its links, never all pairs.
4. Connected components of the confirmed links give the result.

A pair at the threshold is missed with probability (1 - t**depth)**trees, 3.9e-7 with 28 trees of depth 4 at 0.8, plus ``loss``
(1e-9), the exact binomial tail that sets how many of the sketch's bits must agree; no size of a region or group adds to it.

Defined results: a text without words, or null, has an empty set, no links and itself as component; rows
that repeat (also with one doc_id) are rows of one class; a null doc_id is never a component's name
unless the whole component has none; ties go to the smallest doc_id; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .store import written
from .text import Texts, chunks, mix, ragged, sequence_hash, span_hash, splitmix, window_hash

U64 = np.uint64
_SEED2 = U64(0x2545F4914F6CDD1D)


@lru_cache
def least_agreeing(bits: int, percent: int, loss: float) -> int:
    """The largest k such that two sets at the threshold agree in fewer than k of ``bits`` one-bit minhashes with probability ``loss`` at most."""
    p, tail, k = (1 + percent / 100) / 2, 0.0, 0
    while (tail := tail + comb(bits, k) * p**k * (1 - p) ** (bits - k)) <= loss:
        k += 1
    return k


@dataclass(frozen=True)
class Forest:
    """Parameters: similarity in percent, words per shingle, trees (at most 64) and depth (at most 4), chance that a sketch loses a link, sizes."""

    percent: int = 80
    shingle: int = 4
    trees: int = 28
    depth: int = 4
    loss: float = 1e-9
    #: Classes in a block, and shingles: a class of more than ``shingles / block`` takes the room of several. A task holds two blocks.
    block: int = 1024
    shingles: int = 1 << 22
    #: Classes of a region up to which it is searched one value less deep, and from which it is taken whole.
    sparse: int = 32
    window: int = 1024

    @property
    def agree(self) -> int:
        """Least number of agreeing one-bit minhashes of a candidate."""
        return least_agreeing(self.trees * self.depth, self.percent, self.loss)


def shingle_sets(t: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after another, and their bounds."""
    starts, ends, bounds = t.words()
    words = span_hash(t.data, starts, ends, lower=True)
    n_words = np.diff(bounds)
    n = np.maximum(n_words - width + 1, 0)
    at = ragged(bounds[:-1], n)
    values = window_hash(words, width)[at]
    doc = np.repeat(np.arange(len(n)), n)
    short = np.flatnonzero((n_words > 0) & (n == 0))
    if len(short):
        whole = sequence_hash(words, bounds)[short]
        values, doc = np.concatenate([values, whole]), np.concatenate([doc, short])
    order = np.argsort(values)
    if len(n) < 1 << 16:  # a radix sort
        order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]
    else:
        order = order[np.argsort(doc[order], kind="stable")]
    values, doc = values[order], doc[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[new], doc[new]
    return values, np.searchsorted(doc, np.arange(len(n) + 1))


def minhashes(values: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """``count`` minhash values (32 bits, as uint64) of each non-empty set; two from each 64-bit product."""
    starts = bounds[:-1]
    half = -(-count // 2)
    a, b = splitmix(0xA11CE, half) | U64(1), splitmix(0xB0B, half)
    out = np.empty((len(starts), 2 * half), U64)
    with np.errstate(over="ignore"):
        for k in range(half):
            x = (values ^ b[k]) * a[k]
            x ^= x >> U64(32)
            x *= U64(0xBF58476D1CE4E5B9)
            x ^= x >> U64(29)
            x *= U64(0x94D049BB133111EB)
            x ^= x >> U64(32)
            out[:, 2 * k] = np.minimum.reduceat(x, starts) >> U64(32)
            low = (x << U64(32)) | (x >> U64(32))
            out[:, 2 * k + 1] = np.minimum.reduceat(low, starts) >> U64(32)
    return out[:, :count]


def _signed(docs: DataFrame, p: Forest) -> DataFrame:
    """doc_id, set size, two hashes of the set, and the packed signature of every row."""
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("h", "n_shingles", "a", "b")], T.StructField("signature", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, t in chunks(b.column(2)):
                values, bounds = shingle_sets(t, p.shingle)
                size = np.diff(bounds)
                full = size > 0
                some = np.concatenate([bounds[:-1][full], bounds[-1:]])
                a, c = np.zeros(len(t), U64), np.zeros(len(t), U64)
                signature = np.full(len(t), None, object)
                if full.any():
                    a[full], c[full] = sequence_hash(values, some), sequence_hash(mix(values ^ _SEED2), some)
                    packed = minhashes(values, some, p.trees * p.depth).astype("<u4")
                    signature[full] = [r.tobytes() for r in packed]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(size), pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(signature, pa.binary())], names=schema.names)

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, schema)


#: Bits of each value in a sort key.
_BITS = 14


def _orders(classes: DataFrame, p: Forest) -> DataFrame:
    """One row per class and tree: the key, which sorts by tree and then by signature, and the one-bit sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                s = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u4").reshape(part.num_rows, -1).astype(U64)
                n = len(s)
                bits = np.zeros((n, 128), np.uint8)
                bits[:, : s.shape[1]] = s & U64(1)
                sketch = np.packbits(bits, axis=1).view(np.int64)
                tree = mix(s).reshape(n, p.trees, p.depth) & U64((1 << _BITS) - 1)  # minima are small numbers: take well-mixed bits
                key = np.broadcast_to(np.arange(p.trees, dtype=U64), (n, p.trees)).copy()
                for k in range(p.depth):
                    key = (key << U64(_BITS)) | tree[:, :, k]
                cid = np.repeat(part.column(0).to_numpy(), p.trees)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64).ravel(), cid, np.repeat(sketch[:, 0], p.trees), np.repeat(sketch[:, 1], p.trees))], names=["key", "cid", "s0", "s1"])

    return classes.select("cid", "signature").mapInArrow(run, "key long, cid long, s0 long, s1 long")


def _forest(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph on 0..n-1 with edges (u, v), as (node, root) pairs, node != root."""
    root = np.arange(n)
    while len(u):
        ru, rv = root[u], root[v]
        keep = ru != rv
        if not keep.any():
            break
        u, v, ru, rv = u[keep], v[keep], ru[keep], rv[keep]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while (root[root] != root).any():
            root = root[root]
    node = np.flatnonzero(root != np.arange(n))
    return node, root[node]


def _neighbours(sketch: np.ndarray, p: Forest) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a window whose sketches agree enough, as a spanning forest."""
    n, spare = len(sketch), 128 - p.trees * p.depth
    us, vs = [], []
    for i in range(n - 1):
        same = 128 - np.bitwise_count(sketch[i + 1 :] ^ sketch[i]).sum(axis=1) - spare
        j = np.flatnonzero(same >= p.agree)
        if len(j):
            us.append(np.full(len(j), i))
            vs.append(i + 1 + j)
    if not us:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return _forest(n, np.concatenate(us), np.concatenate(vs))


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs of equal keys."""
    at = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    return at, np.diff(np.append(at, len(key)))


def _candidates(orders: DataFrame, p: Forest) -> DataFrame:
    """Candidate edges (u, v) between classes: neighbours in the sorted orders, at the depth that the region asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the last region, which may go on
        edges: list[np.ndarray] = []
        # keys and classes of the partition's first and last run, which may go on in other partitions
        border: list[tuple[int, list[int]]] = []

        def note(rows: np.ndarray) -> None:
            at, size = _runs(rows[:, 0])
            for a, m in {(int(at[0]), int(size[0])), (int(at[-1]), int(size[-1]))} if len(at) > 1 else [(0, len(rows))]:
                key, cids = int(rows[a, 0]), rows[a : a + m, 1].tolist()
                if border and border[-1][0] == key:
                    cids = border.pop()[1] + cids
                elif len(border) == 2:
                    border.pop()
                border.append((key, cids if len(cids) <= p.window else cids[:1]))  # a longer run is taken whole anyway

        def compare(rows: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
            pair = at[size == 2]  # most regions with neighbours are pairs
            if len(pair):
                same = 128 - np.bitwise_count((rows[pair, 2:] ^ rows[pair + 1, 2:]).view(U64)).sum(axis=1) - (128 - p.trees * p.depth)
                ok = pair[same >= p.agree]
                edges.append(np.column_stack([rows[ok, 1], rows[ok + 1, 1]]))
            for a, m in zip(at[size > 2], size[size > 2], strict=True):
                if m > p.window:  # as a whole
                    edges.append(np.column_stack([rows[a + 1 : a + m, 1], np.full(m - 1, rows[a, 1])]))
                else:
                    u, v = _neighbours(rows[a : a + m, 2:].view(U64), p)
                    edges.append(np.column_stack([rows[a + u, 1], rows[a + v, 1]]))

        def work(rows: np.ndarray) -> None:
            """Rows (key, cid, s0, s1) of whole regions that agree on all values but the last."""
            shallow = rows[:, 0] >> _BITS
            at, size = _runs(shallow)
            wide = size <= p.sparse
            compare(rows, at[wide], size[wide])
            for a, m in zip(at[~wide], size[~wide], strict=True):
                inner, inner_size = _runs(rows[a : a + m, 0])
                compare(rows, a + inner, inner_size)

        def send() -> pa.RecordBatch:
            e = np.concatenate(edges) if edges else np.empty((0, 2), np.int64)
            edges.clear()
            name, at = np.unique(e, return_inverse=True)
            at = at.reshape(-1, 2)
            node, root = _forest(len(name), at[:, 0], at[:, 1])
            e = np.column_stack([name[node], name[root]])
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1]), pa.nulls(len(e), pa.int64())], names=["u", "v", "key"])

        for b in batches:
            rows = np.column_stack([b.column(k).to_numpy() for k in range(4)])
            if not len(rows):
                continue
            note(rows)
            if held:
                rows = np.concatenate([*held, rows])
                held.clear()
            at, _ = _runs(rows[:, 0] >> _BITS)
            if at[-1]:
                work(rows[: at[-1]])
            tail = rows[at[-1] :]
            if len(tail) > p.sparse + p.window:  # a region of any length is worked off as it comes, a last run of any length around its first row
                inner, _ = _runs(tail[:, 0])
                done, tail = tail[: inner[-1]], tail[inner[-1] :]
                if len(done):
                    compare(done, *_runs(done[:, 0]))
                if len(tail) > 2 * p.window:
                    edges.append(np.column_stack([tail[1:, 1], np.full(len(tail) - 1, tail[0, 1])]))
                    tail = tail[: p.window + 1]
            held.append(tail.copy())
            if sum(map(len, edges)) > 200_000:
                yield send()
        if held:
            work(np.concatenate(held))
            yield send()
            u, key = np.array([x for k, cids in border for x in cids]), np.array([k for k, cids in border for _ in cids])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.full(len(u), TaskContext.get().partitionId())), pa.array(key)], names=["u", "v", "key"])

    order = ["key", "cid"]
    ordered = orders.repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(ordered.mapInArrow(run, "u long, v long, key long"), "neighbours")
    # a run that crosses a border is taken whole; of a border run there are at most ``window`` rows
    crossed = found.where("key IS NOT NULL").groupBy("key").agg(F.min("u").alias("m"), (F.min("v") < F.max("v")).alias("crossed")).where("crossed")
    borders = found.where("key IS NOT NULL").join(crossed, "key").where("u != m").select("u", F.col("m").alias("v"))
    return found.where("key IS NULL").select("u", "v").union(borders).distinct()


def _pairs_within(values: np.ndarray, bounds: np.ndarray, rows: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs (i < j, i < rows or j >= 0) of sets with 100 * intersection >= percent * union, by exact counts."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(values, kind="stable")
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    at = np.flatnonzero(new)
    df = np.diff(np.append(at, len(v)))
    term = np.cumsum(new) - 1
    shared = df[term] > 1
    o, term = o[shared], term[shared]
    if not len(o):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    _, term = np.unique(term, return_inverse=True)
    both = np.zeros((n, n), np.float32)
    width = max(256, min(4096, 4_000_000 // n))
    for lo in range(0, int(term[-1]) + 1, width):
        a, b = np.searchsorted(term, [lo, lo + width])
        m = np.zeros((n, width), np.float32)
        m[o[a:b], term[a:b] - lo] = 1
        both += m @ m.T
    union = size[:, None] + size[None, :] - both
    hit = 100 * both.astype(np.float64) >= percent * union
    i, j = np.nonzero(np.triu(hit, 1))
    return i, j


def _sets(docs: DataFrame, members: DataFrame, p: Forest) -> DataFrame:
    """cid and ``s`` (sorted shingle hashes) of every member of a coarse group (cid, and the row that stands for it: rep, rep_h); as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for b in batches:
            fresh = [k for k, c in enumerate(b.column(0).to_pylist()) if not (c in sent or sent.add(c))]  # a repeated row meets its class again
            b = b.take(pa.array(fresh, pa.int64()))
            for i, j, t in chunks(b.column(1)):
                values, bounds = shingle_sets(t, p.shingle)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([values[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["cid", "s"])

    d = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).alias("l")
    with_text = d.join(members.hint("merge").alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.rep")) & (F.col("l.h") == F.col("r.rep_h"))).select("cid", "text")
    return written(with_text.mapInArrow(run, "cid long, s binary"), "sets")


def _confirmed(sets: DataFrame, meets: DataFrame, p: Forest) -> DataFrame:
    """Links (u, v) between classes, confirmed on full sets; ``meets``: cid, coarse group, and the pairs of blocks it is in."""

    def confirm(table: pa.Table) -> pa.Table:
        cid, first = np.unique(table.column("cid").to_numpy(), return_index=True)
        parts = table.column("s").take(pa.array(first)).to_pylist()
        bounds = np.concatenate([[0], np.cumsum([len(x) // 8 for x in parts])])
        i, j = _pairs_within(np.frombuffer(b"".join(parts), U64), bounds, len(parts), p.percent)
        node, root = _forest(len(cid), i, j)
        return pa.table({"u": cid[node], "v": cid[root]})

    dealt = sets.join(meets, "cid").select("cid", "root", F.explode("meets").alias("pair"), "s")
    return dealt.groupBy("root", "pair").applyInArrow(confirm, "u long, v long")


def _placed(sized: DataFrame, p: Forest, name: str) -> DataFrame:
    """The members of each ``root`` ordered by set size and cut into blocks: ``block``, and ``blocks``, how many; as a written table."""
    # exact counts per (group, size), then places inside a size by hash; a group has as many sizes as its largest set
    room = F.greatest(F.ceil(F.col("n_shingles") * p.block / p.shingles), F.lit(1))
    per_size = sized.groupBy("root", "n_shingles").agg(F.count("*").alias("m")).withColumn("room", room)
    total = per_size.groupBy("root").agg(F.sum(F.col("m") * F.col("room")).alias("n"))
    before = per_size.withColumn("before", F.expr("coalesce(sum(m * room) over (partition by root order by n_shingles rows between unbounded preceding and 1 preceding), 0)"))
    joined = sized.join(before, ["root", "n_shingles"]).join(total, "root")
    block = F.floor((F.col("before") + F.pmod(F.xxhash64("cid"), F.col("m")) * F.col("room")) / p.block).cast("int")
    return written(joined.select(*sized.columns, block.alias("block"), F.ceil(F.col("n") / p.block).cast("int").alias("blocks")), name)


def _chained(placed: DataFrame) -> DataFrame:
    """Each block meets its successor."""
    b, last = F.col("block"), F.col("blocks") - 1
    name = lambda x, y: F.concat_ws("-", x, y)
    meets = F.when(last == 0, F.array(name(b, b))).otherwise(F.filter(F.array(F.when(b > 0, name(b - 1, b)), F.when(b < last, name(b, b + 1))), lambda x: x.isNotNull()))
    return placed.select("cid", "root", meets.alias("meets"))


def _remaining(placed: DataFrame, links: DataFrame, p: Forest) -> DataFrame:
    """Pairs of blocks that can still hold a link of two components, for groups of more than two blocks.

    The members of a group's largest component need not be compared with one another; all others meet every block.
    """
    many = placed.where("blocks > 2").select("root", "cid", "n_shingles")
    known = components(links, "first-links").select(F.col("node").alias("cid"), F.col("root").alias("part"))
    parted = many.join(known, "cid", "left").withColumn("part", F.coalesce("part", "cid"))
    largest = parted.groupBy("root", "part").agg(F.count("*").alias("n")).groupBy("root").agg(F.max(F.struct("n", "part")).getField("part").alias("main"))
    # groups are told apart by the sign of their number: the main component's members, and the rest
    told = parted.join(largest, "root").select(F.when(F.col("part") == F.col("main"), -1 - F.col("root")).otherwise(F.col("root")).alias("root"), "cid", "n_shingles")
    again = _placed(told, p, "blocks-again").withColumn("main", F.col("root") < 0).withColumn("root", F.when(F.col("root") < 0, -1 - F.col("root")).otherwise(F.col("root")))
    spans = again.groupBy("root", "main", "block").agg(F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"))
    x, y = spans.where("NOT main").alias("x"), spans.alias("y")
    fits = (100 * F.col("x.hi") >= p.percent * F.col("y.lo")) & (100 * F.col("y.hi") >= p.percent * F.col("x.lo"))
    meet = x.join(y, F.col("x.root") == F.col("y.root")).where(fits & (F.col("y.main") | (F.col("x.block") <= F.col("y.block"))))
    name = F.concat_ws("-", "x.block", F.when(F.col("y.main"), "m").otherwise("r"), "y.block")
    unit = lambda a: F.struct(F.col(f"{a}.main").alias("main"), F.col(f"{a}.block").alias("block"))
    meets = meet.select(F.col("x.root").alias("root"), F.explode(F.array(unit("x"), unit("y"))).alias("u"), name.alias("pair")).groupBy("root", F.col("u.main").alias("main"), F.col("u.block").alias("block")).agg(F.collect_set("pair").alias("meets"))
    return again.join(meets, ["root", "main", "block"]).select("cid", "root", "meets")


def _links(docs: DataFrame, groups: DataFrame, classes: DataFrame, p: Forest) -> DataFrame:
    """Links between classes that connect all that have a link, in any coarse group."""
    sized = written(groups.join(classes.select(F.col("cid").alias("node"), "rep", "rep_h", "n_shingles"), "node").select("root", F.col("node").alias("cid"), "rep", "rep_h", "n_shingles"), "coarse")
    sets = _sets(docs, sized.select("cid", "rep", "rep_h"), p)
    placed = _placed(sized.select("root", "cid", "n_shingles"), p, "blocks")
    links = written(_confirmed(sets, _chained(placed), p), "links")
    if placed.where("blocks > 2").isEmpty():
        return links
    return written(links.union(_confirmed(sets, _remaining(placed, links, p), p)), "links")


def _grouped(docs: DataFrame, p: Forest) -> DataFrame:
    """doc_id, h (of the text), n_shingles, group (null without words) and component_id of every row."""
    signed = written(_signed(docs, p), "signatures")
    rep = F.min(F.struct("doc_id", "h"))
    classes = signed.where("n_shingles > 0").groupBy("a", "b").agg(F.min("doc_id").alias("low"), rep.alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = classes.select("a", "b", "low", F.col("rep.doc_id").alias("rep"), F.col("rep.h").alias("rep_h"), "n_shingles", "signature")
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    groups = components(_candidates(_orders(classes, p), p), "coarse-groups")
    links = _links(docs, groups, classes, p)
    linked = components(links, "groups").join(classes.select(F.col("cid").alias("node"), "low"), "node")
    names = linked.join(linked.groupBy("root").agg(F.min("low").alias("component")), "root").select(F.col("node").alias("cid"), "root", "component")
    named = classes.join(names, "cid", "left").select("a", "b", F.coalesce("root", "cid").alias("group"), F.coalesce("component", "low").alias("component"))
    rows = signed.select("doc_id", "h", "n_shingles", "a", "b").join(named, ["a", "b"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return rows.select("doc_id", "h", "n_shingles", "group", component.alias("component_id"))


def near_duplicates(docs: DataFrame, p: Forest = Forest()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    return _grouped(docs, p).select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def one_of_each(docs: DataFrame, p: Forest = Forest()) -> DataFrame:
    """One row of each group, with the columns it came with; texts without words all stay.

    The row with the least (doc_id, hash of the text) stays, a null doc_id only where the group has no other; of rows equal in
    both, the one with the least hash of all columns.
    """
    key = F.struct("doc_id", "h")
    alone = F.when(F.col("n_shingles") == 0, key).alias("alone")
    least = _grouped(docs, p).groupBy("group", alone).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("k"))
    kept = least.select(F.struct("k.doc_id", "k.h").alias("__key"), F.col("alone").isNotNull().alias("__all"))
    own = [f"__own{i}" for i in range(len(docs.columns))]  # so that no column is taken for one of these
    at = {c: F.col(o) for o, c in zip(own, docs.columns, strict=True)}
    keyed = docs.toDF(*own).withColumn("__key", F.struct(at["doc_id"].alias("doc_id"), F.xxhash64(at["text"]).alias("h")))
    place = F.row_number().over(Window.partitionBy("__key").orderBy(F.xxhash64(*own)))
    return keyed.join(kept, "__key").withColumn("__place", place).where("__all OR __place = 1").select(*own).toDF(*docs.columns)
