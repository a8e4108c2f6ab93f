"""Mixing sources to target weights: fixed-length blocks of words, dealt to output shards by multinomial draws.

1. The rows of a source stand one after another on a line of words, in the order of a keyed hash; the line is cut into blocks of ``block``
   words. Only the last block of a source may be shorter.
2. Every source has a target: its weight's share of ``percent`` of all words, but at most ``most`` times its own words; what a source cannot
   take is shared again by weight. One pass over the sources in the order of limit / weight gives this share directly: a source reaches its limit
   if that is no more than its weight's part of what the sources before it have left.
3. The output is a sequence of slots of one block each, ``shard_blocks`` to a shard. Every slot draws a ticket, and a source owns as many tickets as
   blocks of its target, so a shard's counts are a multinomial draw. A source keeps as many of its draws, any of them, as its target has blocks;
   the others become slots of the sources that drew too few. So shards vary, but each source's words are its target, rounded.
4. The k-th slot of a source takes block ``permutation(k mod n)`` of pass ``k div n``: a keyed Feistel network with cycle walking over the
   indexes of the source's full blocks, another one for each pass; the short block comes last in a pass. The last slot of a source is cut where its
   target ends. Blocks and slots are joined by (source, index).

A document's words are thus taken as often as the passes that reach their block: at most ``most`` times.

Every step is a DataFrame: rows that are equal are counted before anything is dealt, positions are running sums over ranges, a
source's tickets and blocks are spread in pieces of ``SPREAD``, and no source's rows meet in one task.

Defined results: a null or empty text has size 0 and is never taken; a null source is one source, after all others; rows that
repeat are taken separately; a null doc_id is a value like any other; an empty table, or one without a word, gives targets of 0 and no slot;
extra columns are ignored. A rerun gives the same mix, however the input is split into files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .feistel_shards import PRIME, SMALL_PRIME, round_keys
from .running import running
from .store import written

_WORD = r"[^\x20\x09-\x0D]+"
#: Numbers of a range that one row spreads into.
SPREAD = 4096
#: Steps of a cycle walk; it leaves the index range about once in sqrt(n) steps.
WALK = 64


@dataclass(frozen=True)
class Mix:
    """What to mix: ``weights`` go round the sources by code point, null last; targets share ``percent`` of all words."""

    weights: tuple[int, ...] = (5, 2, 1)
    percent: int = 150
    most: int = 2
    block: int = 512
    shard_blocks: int = 1024
    key: str = "mix-v1"

    def __post_init__(self) -> None:
        if not self.weights or min(self.weights) < 1 or not 0 < self.percent <= 100 * self.most or min(self.block, self.shard_blocks) < 1:
            raise ValueError("weights, block and shard_blocks must be positive, and percent at most 100 * most")


def permuted(v: str, n: str, tweak: str, key: str) -> str:
    """SQL of a permutation of 0..n-1, one for each ``tweak`` (0 to 2**31 - 1); null if a walk is longer than ``WALK``."""
    keys = ", ".join("struct(" + ", ".join(f"{x}L AS k{i}" for i, x in enumerate(k)) + ")" for k in round_keys(key))
    a = f"(CAST(floor(sqrt({n} - 1)) AS BIGINT) + 1)"
    b = f"(({n} + {a} - 1) div {a})"
    f = f"((((((s.y + {tweak}) % {PRIME}L) * k.k0 + k.k1) % {PRIME}L) * ((s.y * k.k2 + k.k3) % {SMALL_PRIME}L) + k.k4) % {PRIME}L)"
    once = lambda x: (
        f"aggregate(array({keys}), named_struct('x', {x} % {a}, 'y', {x} div {a}, 'm', {a}, 'n', {b}), "
        f"(s, k) -> named_struct('x', s.y, 'y', (s.x + {f}) % s.m, 'm', s.n, 'n', s.m), s -> s.x + s.y * {a})"
    )
    return f"aggregate(sequence(1, {WALK}), {once(v)}, (p, i) -> CASE WHEN p >= {n} THEN {once('p')} ELSE p END, p -> CASE WHEN p < {n} THEN p END)"


def _spread(ranges: DataFrame, start: str, count: str, number: str) -> DataFrame:
    """A row for each number of the ranges [start, start + count), in pieces, so that no task writes a whole large range."""
    pieces = ranges.where(f"{count} > 0").withColumn("__piece", F.explode(F.expr(f"sequence(0L, {count} - 1, {SPREAD}L)")))
    # a piece's length depends on where it stands in its range
    rows = pieces.repartition(F.xxhash64(start, "__piece"))
    return rows.withColumn(number, F.explode(F.expr(f"sequence({start} + __piece, {start} + least(__piece + {SPREAD}, {count}) - 1)"))).drop("__piece")


def _rows(docs: DataFrame, m: Mix) -> DataFrame:
    """doc_id, source, text_hash, size, copies and a keyed hash, one row for all equal rows."""
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", "source", F.xxhash64(text).alias("text_hash"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("size"))
    counted = narrow.groupBy("doc_id", "source", "text_hash", "size").agg(F.count("*").alias("copies"))
    return written(counted.withColumn("h", F.xxhash64(F.lit(m.key), "doc_id", "text_hash")), "mix-rows")


def targets(rows: DataFrame, m: Mix = Mix()) -> DataFrame:
    """A row for each source of ``rows``: its words, weight, target, and what positions, slots and tickets need."""
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    by_name = [F.col("source").isNull(), F.col("source")]
    sources = running(sizes, by_name, {"rank": F.lit(1), "line": F.col("source_size")}, "mix-sources")
    weight = F.get(F.array(*map(F.lit, m.weights)), (F.col("rank") % len(m.weights)).cast("int")).cast("long")
    sources = written(sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * m.most), "mix-weights")
    whole = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weights")).first()
    # in hundredths of a word: what the sources before a source leave, and the weights that share it
    level = running(sources, [F.col("most") / F.col("weight"), F.col("rank")], {"most_before": F.col("most"), "weight_before": F.col("weight")}, "mix-levels")
    left, share = F.lit(m.percent * whole["words"]) - 100 * F.col("most_before"), F.lit(whole["weights"]) - F.col("weight_before")
    open_ = level.select("rank", "most", "weight", left.alias("left"), share.alias("share")).where(100 * F.col("most") * F.col("share") > F.col("weight") * F.col("left"))
    first = open_.agg(F.min_by(F.struct("left", "share"), F.struct(F.col("most") / F.col("weight"), "rank")).alias("x")).first()["x"]
    part = F.col("most").cast("double")
    if first:
        part = F.least(part, F.col("weight") * F.lit(first["left"]) / (100.0 * first["share"]))
    tail = F.col("source_size") % m.block
    full = F.expr(f"source_size div {m.block}")
    quota = F.least(F.col("most"), F.round("target").cast("long"))
    rest = F.when(F.col("source_size") > 0, F.col("quota") % F.col("source_size")).otherwise(0)
    passes = F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(0)
    sources = sources.withColumn("target", part).withColumn("quota", quota).withColumn("full", full).withColumn("tail", tail)
    sources = sources.withColumn("blocks", F.col("full") + (F.col("tail") > 0).cast("long"))
    sources = sources.withColumn("slots", (passes * F.col("blocks") + F.ceil(rest / F.lit(m.block))).cast("long"))
    return written(running(sources, [F.col("rank")], {"ticket": F.col("slots")}, "mix-tickets"), "mix-targets")


def draws(sources: DataFrame, m: Mix = Mix()) -> DataFrame:
    """id (of the slot in the output), rank, k: every slot is the k-th of that source."""
    n_slots = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first()["n"]
    spark = sources.sparkSession
    drawn = spark.range(n_slots).select("id", F.expr(f"pmod(xxhash64('{m.key}', 'draw', id), {max(n_slots, 1)}L)").alias("ticket"))
    owners = _spread(sources.select("rank", F.col("ticket").alias("from"), "slots"), "`from`", "slots", "ticket").select("rank", "ticket")
    # a source numbers its draws in an order of their own, so that those it keeps are any of them
    ordered = lambda what: [F.xxhash64(F.lit(m.key), F.lit(what), F.col("id")), F.col("id")]
    placed = running(drawn.join(owners, "ticket").select("id", "rank"), [F.col("rank"), *ordered("keep")], {"before": F.lit(1)}, "mix-draws")
    counts = placed.groupBy("rank").agg(F.count("*").alias("drawn"))
    per_source = sources.select("rank", "slots").join(counts, "rank", "left").fillna(0, "drawn")
    per_source = running(per_source, [F.col("rank")], {"base": F.col("drawn"), "from": F.greatest(F.col("slots") - F.col("drawn"), F.lit(0))}, "mix-drawn")
    placed = placed.join(per_source.select("rank", "slots", "base"), "rank").select("id", "rank", (F.col("before") - F.col("base")).alias("k"), "slots")
    placed = written(placed, "mix-placed")
    # draws beyond a source's target become those of the sources that drew too few
    spare = running(placed.where("k >= slots").select("id"), ordered("spare"), {"place": F.lit(1)}, "mix-spare")
    short = per_source.where("slots > drawn").select("rank", "drawn", "from", (F.col("slots") - F.col("drawn")).alias("lack"))
    given = _spread(short, "`from`", "lack", "place").select("rank", (F.col("drawn") + F.col("place") - F.col("from")).alias("k"), "place")
    return placed.where("k < slots").select("id", "rank", "k").union(spare.join(given, "place").select("id", "rank", "k"))


def shard_counts(sources: DataFrame, m: Mix = Mix()) -> DataFrame:
    """shard, rank, n: the blocks of each source in each output shard."""
    return draws(sources, m).groupBy(F.expr(f"id div {m.shard_blocks}").alias("shard"), "rank").agg(F.count("*").alias("n"))


def slots(sources: DataFrame, m: Mix = Mix()) -> DataFrame:
    """shard, slot, rank (of the source), block, words: what every slot of the output takes, the first ``words`` words of that block."""
    of = sources.select("rank", "source_size", "quota", "full", "tail", "blocks")
    at = draws(sources, m).join(of, "rank").withColumn("pass", F.expr("k div blocks")).withColumn("r", F.col("k") % F.col("blocks"))
    at = at.withColumn("tweak", F.xxhash64(F.lit(m.key), "rank", "pass").bitwiseAND(F.lit(PRIME - 1)))
    index = F.when(F.col("r") < F.col("full"), F.expr(permuted("r", "full", "tweak", m.key))).otherwise(F.col("r"))
    index = F.coalesce(index, F.raise_error(F.lit("cycle walk too long; use another key")).cast("long"))
    length = F.when(F.col("r") < F.col("full"), F.lit(m.block)).otherwise(F.col("tail"))
    words = F.least(length, F.col("quota") - F.col("pass") * F.col("source_size") - F.col("r") * m.block)
    return written(at.select(F.expr(f"id div {m.shard_blocks}").alias("shard"), (F.col("id") % m.shard_blocks).alias("slot"), "rank", index.alias("block"), words.alias("words")), "mix-slots")


def _pieces(rows: DataFrame, sources: DataFrame, m: Mix) -> DataFrame:
    """The rows (each copy) with their parts by block: ``block``, ``at`` (first word's place in the block), ``length`` and ``skip`` (words of the row before it).

    A row without words has one part without a block.
    """
    placed = running(rows.withColumn("all", F.col("size") * F.col("copies")), [F.col("source").isNull(), F.col("source"), F.col("h"), F.col("doc_id"), F.col("text_hash")], {"before": F.col("all")}, "mix-lines")
    of = sources.select(F.col("source").alias("name"), "rank", "line", "source_size", "target")
    copies = placed.join(of, F.col("source").eqNullSafe(F.col("name"))).withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    copies = copies.withColumn("start", F.col("before") - F.col("line") + F.col("copy") * F.col("size"))
    part = F.explode_outer(F.expr(f"CASE WHEN size > 0 THEN sequence(start div {m.block}, (start + size - 1) div {m.block}) END"))
    parts = copies.select("doc_id", "text_hash", "copy", "size", "source_size", "target", "rank", "start", part.alias("block"))
    first = F.greatest(F.col("start"), F.col("block") * m.block)
    last = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * m.block)
    return parts.withColumns({"at": first - F.col("block") * m.block, "length": last - first, "skip": first - F.col("start")})


def _overlap() -> Column:
    """Words of a part that its block's slot takes; none where no slot has the block."""
    return F.when(F.col("words") > F.col("at"), F.least(F.col("words") - F.col("at"), F.col("length"))).otherwise(0)


def taken(docs: DataFrame, m: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row: the words of it that the mix takes, repeats counted."""
    rows = _rows(docs, m)
    sources = targets(rows, m)
    parts, mixed = _pieces(rows, sources, m), slots(sources, m)
    each = parts.join(mixed.select("rank", "block", "words"), ["rank", "block"], "left")
    row = ["doc_id", "text_hash", "copy", "rank", "start", "size", "source_size", "target"]
    out = each.groupBy(*row).agg(F.sum(_overlap()).cast("long").alias("taken"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def mixture(docs: DataFrame, m: Mix = Mix()) -> DataFrame:
    """shard, slot, source, n_words, text of every slot: the mix itself, words joined by one space."""
    rows = _rows(docs, m)
    sources = targets(rows, m)
    mixed = slots(sources, m)
    parts = _pieces(rows, sources, m).where("block IS NOT NULL").select("doc_id", "text_hash", "rank", "block", "at", "length", "skip")
    parts = written(parts, "mix-parts")
    wanted = parts.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("skip", "length")).alias("cuts"))
    texts = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).dropDuplicates(["doc_id", "text_hash"]).alias("l")
    joined = texts.join(wanted.alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_hash") == F.col("r.text_hash")))
    words = F.regexp_extract_all(F.col("l.text"), F.lit(_WORD), F.lit(0))
    # the words are found once, and each part is a row of its own before anything is dealt
    cut = F.get(F.transform(F.array(words), lambda w: F.transform("cuts", lambda c: F.struct(c["skip"].alias("skip"), c["length"].alias("length"), F.array_join(F.slice(w, (c["skip"] + 1).cast("int"), c["length"].cast("int")), " ").alias("part")))), F.lit(0))
    cuts = joined.select(F.col("l.doc_id").alias("doc_id"), F.col("l.text_hash").alias("text_hash"), F.explode(cut).alias("c")).select("doc_id", "text_hash", "c.*").alias("c")
    p = parts.alias("p")
    same = F.col("p.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("p.text_hash") == F.col("c.text_hash")) & (F.col("p.skip") == F.col("c.skip")) & (F.col("p.length") == F.col("c.length"))
    filled = p.join(cuts, same).groupBy("rank", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), " ").alias("whole"))
    out = mixed.join(filled, ["rank", "block"]).join(sources.select("rank", "source"), "rank")
    text = F.array_join(F.slice(F.split("whole", " "), 1, F.col("words").cast("int")), " ")
    return out.select("shard", "slot", "source", F.col("words").alias("n_words"), text.alias("text"))
