"""Reproducible shuffle into shards by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..n-1 in the order of (doc_id, crc32 of the text, hash of the text). A keyed
generalised Feistel network permutes the grid of ``a * b >= n`` cells (a = ceil(sqrt(n))); a value
outside 0..n-1 walks its cycle until it is inside. Shard and slot follow by arithmetic, so the
place of a row number can be computed, and inverted, without any table.

Law ``rows``: shard = p mod shards, slot = p div shards; shard sizes differ by one at most.

Defined results: a null text counts as empty (size 1, crc32 0); rows equal in doc_id and text are
interchangeable and get different places; a null doc_id sorts first; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

PRIME, SMALL_PRIME, ROUNDS = 2_147_483_647, 65_521, 8


def round_keys(key: str) -> list[tuple[int, int, int, int, int]]:
    """Five constants for each round, from the key."""
    out = []
    for i in range(ROUNDS):
        d = hashlib.sha256(f"{key}/{i}".encode()).digest()
        c = [int.from_bytes(d[4 * j : 4 * j + 4], "big") for j in range(5)]
        out.append((c[0] % (PRIME - 1) + 1, c[1] % PRIME, c[2] % (SMALL_PRIME - 1) + 1, c[3] % SMALL_PRIME, c[4] % PRIME))
    return out


def grid(n: int) -> tuple[int, int]:
    """Sides of the permuted grid for ``n`` rows; it has fewer than sqrt(n) + 1 cells too many."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permuted(v: str, a: int, b: int, key: str) -> str:
    """SQL of one pass of the network over ``v``."""
    keys = ", ".join("struct(" + ", ".join(f"{x}L AS k{i}" for i, x in enumerate(k)) + ")" for k in round_keys(key))
    f = f"((((s.y * k.k0 + k.k1) % {PRIME}L) * ((s.y * k.k2 + k.k3) % {SMALL_PRIME}L) + k.k4) % {PRIME}L)"
    return (
        f"aggregate(array({keys}), named_struct('x', {v} % {a}L, 'y', {v} div {a}L, 'm', {a}L, 'n', {b}L), "
        f"(s, k) -> named_struct('x', s.y, 'y', (s.x + {f}) % s.m, 'm', s.n, 'n', s.m), s -> s.x + s.y * {a}L)"
    )


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, size, text_crc32 and the global row number of each row, and the number of rows."""
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("tie"))
    order = ["doc_id", "text_crc32", "h", "tie"]
    spread = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    here = F.monotonically_increasing_id()
    rows = written(spread.select("doc_id", "size", "text_crc32", F.shiftright(here, 33).alias("part"), here.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "numbered")
    # one count per partition
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before, "part long, before long")
    return rows.join(F.broadcast(offsets), "part").select("doc_id", "size", "text_crc32", (F.col("before") + F.col("place")).alias("row")), total


def shards(docs: DataFrame, n_shards: int = 8, key: str = "shards-v1") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    rows, n = numbered(docs)
    a, b = grid(n)
    once = rows.withColumn("p", F.expr(permuted("row", a, b, key)))
    # the fewer than sqrt(n) + 1 cells outside walk in at most as many steps as there are of them; walks of over 64 do not occur
    if outside := a * b - n:
        walk = f"aggregate(sequence(0, {min(outside, 64)}), id, (v, i) -> CASE WHEN v >= {n}L THEN {permuted('v', a, b, key)} ELSE v END)"
        table = rows.sparkSession.range(n, a * b).select(F.col("id").alias("p"), F.expr(walk).alias("q"))
        # cells whose whole cycle lies outside are never walked from inside
        inside = F.coalesce(F.when(F.col("p") < n, F.col("p")), F.col("q"))
        once = once.join(F.broadcast(table.where(F.col("q") < n)), "p", "left")
        once = once.withColumn("p", F.coalesce(inside, F.raise_error(F.lit("cycle walk too long; use another key")).cast("long")))
    return once.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("p") % n_shards).cast("int").alias("shard"), F.expr(f"p div {n_shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
