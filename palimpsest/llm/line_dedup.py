"""Removal of repeated line runs through a suffix array over line ids, built by prefix doubling.

Every non-blank line gets an id (a rank in the order of its 128-bit hash). A suffix is the line sequence from one line to its document's end.

1. Prefix doubling ranks suffixes by their first 1, 2, 4, ... lines: the rank at the doubled depth is the order of the pair (own rank, rank of the
   suffix that starts where the known prefix ends). Suffixes whose rank is unique can begin no longer repeated run and leave, so the
   rounds end at the longest repeat of the table.
2. Equal ranks at a depth are an interval of longest common prefixes of at least that depth. The intervals in between are found from the deepest depth down:
   the suffixes of an interval are told apart by the next 2^k lines. Those that agree form an interval 2^k lines deeper, with the earliest of them as its source;
   the earliest itself stays in the outer interval, to be told apart by fewer lines, as it may agree with an earlier suffix there. After the last
   step every suffix is in the deepest interval in which it is not the earliest: its depth is the longest run that stood before,
   and the interval's earliest suffix is where.
3. A suffix that continues the run of the one before it (one line less) is part of that run; the others start maximal runs. Their lines are deleted.

With ``min_words``, a run of fewer than ``min_lines`` lines is a repeat too where its lines have that many words together (words as in ``text``:
what stands between white space).

Groups are reduced by map-side aggregates (a minimum and a maximum position, one row per interval), so a line
that holds a third of all rows is never gathered; an interval adds one row, its source; the joins that carry ranks back are plain
equi-joins, which adaptive execution can split.

Defined results: lines without a non-blank character are kept and do not interrupt a run; a null
text stays null and has no lines; documents are ordered by (doc_id, hash of the text), null doc_ids
first, and rows equal in both are one document: they lose the same lines; overlapping repeats within a
document keep the first lines; a text whose lines all go is empty; extra columns pass through,
clashing names included; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

_D, _H = "__dedup_doc", "__dedup_hash"
_WORD = r"[^\x20\x09-\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often a lambda in it uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(lines: Column) -> Column:
    return F.sequence(F.lit(0), F.size(lines) - 1)


def _solid(lines: Column) -> Column:
    """Positions of the non-blank lines."""
    return F.filter(_places(lines), lambda i: lines[i].rlike(r"\S"))


def _place(c: str = "") -> Column:
    return F.struct(F.col(f"{c}{_D}").alias(_D), F.col(f"{c}{_H}").alias(_H), F.col(f"{c}seq").alias("seq"))


def _ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Places with ``keys`` replaced by an order-preserving rank ``r``, only of ranks that at least two places share; ``first``: the earliest of them."""
    groups = rows.groupBy(*keys).agg(F.min(_place()).alias("first"), F.max(_place()).alias("last")).where("first < last").drop("last")
    ranks = written(groups.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()), f"ranks-{name}")
    return written(rows.join(ranks, keys).select(_D, _H, "seq", F.col("rank").alias("r"), "first"), f"suffixes-{name}")


def line_ids(docs: DataFrame, text: str = "text") -> DataFrame:
    """The non-blank lines: document key, ``seq``, two hashes ``a`` and ``b``. Rows equal in doc_id and text are one document."""
    lines = F.filter(F.split(F.col(f"`{text}`"), "\n", -1), lambda x: x.rlike(r"\S"))
    each = docs.select(F.col("doc_id").alias(_D), F.xxhash64(f"`{text}`").alias(_H), F.posexplode(lines).alias("seq", "line"))
    return each.select(_D, _H, "seq", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")).distinct()


def suffix_ranks(docs: DataFrame, text: str = "text") -> list[DataFrame]:
    """Ranks of all suffixes that share their first 1, 2, 4, ... lines with another: document key, ``seq``, ``r``, ``first``."""
    ids = written(line_ids(docs, text), "line-ids")
    levels: list[DataFrame] = []
    rows = _ranked(ids, ["a", "b"], "1")
    while not rows.isEmpty():
        levels.append(rows)
        depth = 1 << (len(levels) - 1)
        ahead = Window.partitionBy(_D, _H).orderBy("seq").rangeBetween(depth, depth)
        pairs = rows.select(_D, _H, "seq", "r").withColumn("r2", F.max("r").over(ahead)).where(F.col("r2").isNotNull())
        rows = _ranked(written(pairs, f"pairs-{2 * depth}"), ["r", "r2"], str(2 * depth))
    return levels


def longest_repeats(docs: DataFrame, least: int = 1, text: str = "text") -> DataFrame:
    """Document key, ``seq``, ``n``, ``first``: every place whose run of ``n`` lines stands earlier too, at ``first``, while no longer one does; ``n`` is at least ``least``."""
    levels = suffix_ranks(docs, text)
    kind = docs.select(F.col("doc_id").alias(_D), F.xxhash64(f"`{text}`").alias(_H), F.lit(0).alias("seq"), F.lit(0).alias("n")).withColumn("first", _place()).limit(0)
    alive = kind
    place = ["seq", "first", "n"]
    for k in reversed(range(len(levels))):
        level, step = levels[k], 1 << k
        # tell the suffixes of each interval apart by their next lines
        ahead = level.select(F.col(_D).alias("d2"), F.col(_H).alias("h2"), F.col("seq").alias("s2"), "r")
        here = alive.alias("x").join(ahead, F.col(f"x.{_D}").eqNullSafe(F.col("d2")) & (F.col(f"x.{_H}") == F.col("h2")) & (F.col("x.seq") + F.col("x.n") == F.col("s2")), "left").select(_D, _H, *place, "r")
        here = written(here, f"told-{step}") if k < len(levels) - 1 else here
        deeper = here.where("r IS NOT NULL").groupBy("first", "n", "r").agg(F.min(_place()).alias("source"), F.max(_place()).alias("last")).where("source < last").drop("last")
        deeper = written(deeper, f"deeper-{step}")  # so that the join below is dealt for itself, and can be split
        found = here.join(deeper, ["first", "n", "r"], "left")
        moves = F.coalesce(F.col("source") < _place(), F.lit(False))
        old = found.select(_D, _H, "seq", F.when(moves, F.col("source")).otherwise(F.col("first")).alias("first"), F.when(moves, F.col("n") + step).otherwise(F.col("n")).alias("n"))
        of = lambda c, n: [F.col(f"{c}.{_D}").alias(_D), F.col(f"{c}.{_H}").alias(_H), F.col(f"{c}.seq").alias("seq"), F.col(c).alias("first"), n.alias("n")]
        parts = [old, deeper.select(*of("source", F.col("n") + step))]
        if 2 * step > least:  # a run that begins at this depth can still grow to twice of it, less one
            begun = alive.where(_place() != F.col("first")).select(F.col(_D).alias("d2"), F.col(_H).alias("h2"), F.col("seq").alias("s2"))
            new = level.where(F.col("first") < _place()).join(begun, F.col(_D).eqNullSafe(F.col("d2")) & (F.col(_H) == F.col("h2")) & (F.col("seq") == F.col("s2")), "left_anti")
            new = new.select(_D, _H, "seq", "first", F.lit(step).alias("n"))
            parts += [new, new.select("first").distinct().select(*of("first", F.lit(step)))]
        alive = parts[0]
        for part in parts[1:]:
            alive = alive.unionByName(part)
        alive = written(alive, f"intervals-{step}")
    return alive.where((_place() != F.col("first")) & (F.col("n") >= least))


def _runs(docs: DataFrame, min_lines: int, text: str, min_words: int | None = None) -> DataFrame:
    """``longest_repeats`` that are long enough and do not continue the run of the place before."""
    found = longest_repeats(docs, min_lines if min_words is None else 1, text)
    # the place before has a run one line longer where this one continues it
    before = F.max("n").over(Window.partitionBy(_D, _H).orderBy("seq").rangeBetween(-1, -1))
    runs = found.withColumn("before", before).where("before IS NULL OR before <= n").drop("before")
    if min_words is None:
        return runs
    lines = F.filter(F.split(F.col(f"`{text}`"), "\n", -1), lambda x: x.rlike(r"\S"))
    short = written(runs, "runs")
    wanted = short.where(F.col("n") < min_lines).select(_D, _H, F.explode(F.sequence("seq", F.col("seq") + F.col("n") - 1)).alias("at"), "seq")
    each = docs.select(F.col("doc_id").alias("d2"), F.xxhash64(f"`{text}`").alias("h2"), F.posexplode(lines).alias("s2", "line")).select("d2", "h2", "s2", F.regexp_count("line", F.lit(_WORD)).alias("own"))
    each = each.groupBy("d2", "h2", "s2").agg(F.max("own").alias("own"))
    words = wanted.join(each, F.col(_D).eqNullSafe(F.col("d2")) & (F.col(_H) == F.col("h2")) & (F.col("at") == F.col("s2"))).groupBy(_D, _H, "seq").agg(F.sum("own").alias("words"))
    long_ = words.where(F.col("words") >= min_words).select(F.col(_D).alias("d2"), F.col(_H).alias("h2"), F.col("seq").alias("s2"))
    enough = short.where(F.col("n") < min_lines).join(long_, F.col(_D).eqNullSafe(F.col("d2")) & (F.col(_H) == F.col("h2")) & (F.col("seq") == F.col("s2")), "left_semi")
    return short.where(F.col("n") >= min_lines).unionByName(enough)


def maximal_runs(docs: DataFrame, min_lines: int = 3, text: str = "text") -> DataFrame:
    """doc_id, start, lines, source_id, source_start: every maximal run of a document that stands earlier, with the place where it stands first (non-blank lines, from 0)."""
    runs = _runs(docs, min_lines, text)
    return runs.select(F.col(_D).alias("doc_id"), F.col("seq").alias("start"), F.col("n").alias("lines"), F.col("first").getField(_D).alias("source_id"), F.col("first").getField("seq").alias("source_start"))


def dedup_lines(docs: DataFrame, min_lines: int = 3, text: str = "text", counts: bool = False, min_words: int | None = None) -> DataFrame:
    """``docs`` with later copies of line runs (of ``min_lines`` lines, or of ``min_words`` words) deleted from ``text``; with ``counts`` also ``n_lines``, ``n_removed`` and ``longest_run`` (lines of its longest maximal run)."""
    hits = _runs(docs, min_lines, text, min_words)
    gone = hits.select(_D, _H, F.col("n").alias("run_lines"), F.explode(F.sequence("seq", F.col("seq") + F.col("n") - 1)).alias("seq"))
    gone = gone.groupBy(_D, _H).agg(F.collect_set("seq").alias("__gone"), F.max("run_lines").alias("__longest"))
    own = [f"__own{i}" for i in range(len(docs.columns))]  # so that no column is taken for one of these
    at, key = F.col(f"l.{own[docs.columns.index(text)]}"), F.col(f"l.{own[docs.columns.index('doc_id')]}")
    left = docs.toDF(*own).alias("l").join(gone.alias("g"), key.eqNullSafe(F.col(f"g.{_D}")) & (F.xxhash64(at) == F.col(f"g.{_H}")), "left")
    lines = F.split(at, "\n", -1)
    kept = _let(lines, lambda ls: _let(_solid(ls), lambda solid: F.array_join(F.transform(F.array_except(_places(ls), F.transform("__gone", lambda s: solid[s])), lambda i: ls[i]), "\n")))
    new: Column = F.when(F.col("__gone").isNull(), at).otherwise(kept)
    columns = [new.alias(c) if c == text else F.col(f"l.{o}").alias(c) for o, c in zip(own, docs.columns, strict=True)]
    if counts:
        n_lines = F.size(F.filter(lines, lambda x: x.rlike(r"\S")))
        columns += [F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("__longest", F.lit(0)).cast("long").alias("longest_run")]
    return left.select(*columns)
