"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps all measurements and one failure
bit per rule; versioned policies (bit masks) are applied to the stored bits afterwards, and
ablations are bitwise aggregations of the ledger, so trying a policy never rereads a text.

Defined results: a null or empty text has zero counts and fails ``few_words``; repeated rows
and repeated doc_ids each get their own ledger row; extra columns (any name but those of the
ledger, which replace equal-named ones) pass through; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .measures import measure
from .text import chunks

Measures = dict[str, np.ndarray]


@dataclass(frozen=True)
class Rule:
    """A named check; ``fails`` is evaluated on the measurements of many documents at once."""

    name: str
    fails: Callable[[Measures], np.ndarray]


#: Bit i of the ledger is rule i. Rules are only ever appended, so old ledgers stay readable.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda m: m["n_words"] < 50),
    Rule("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule("symbols", lambda m: 100 * m["n_symbols"] > 10 * m["n_words"]),
    Rule("duplicate_lines", lambda m: 100 * m["n_dup_lines"] > 30 * m["n_lines"]),
    Rule("shouting", lambda m: m["n_upper"] > m["n_lower"]),
    Rule("exclamations", lambda m: 100 * m["n_bangs"] > 10 * m["n_words"]),
    Rule("long_words", lambda m: m["word_chars"] > 15 * m["n_words"]),
)
#: Policy version -> names of the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(r.name for r in RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_upper", "n_lower")


def mask_of(policy: str) -> int:
    """The bit mask of a policy version."""
    names = [r.name for r in RULES]
    return sum(1 << names.index(x) for x in POLICIES[policy])


def ledger(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """All columns of ``docs`` (the text only if asked for) with measurements and ``failure_bits``."""
    names = [c for c in docs.columns if c not in (*MEASURES, "failure_bits") and (keep_text or c != text)]
    extra = [T.StructField(c, T.LongType(), False) for c in (*MEASURES, "failure_bits")]
    schema = T.StructType([f for f in docs.schema.fields if f.name in names] + extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, t in chunks(b.column(b.num_columns - 1)):
                m = measure(t)
                bits = sum(r.fails(m).astype(np.int64) << k for k, r in enumerate(RULES))
                columns = [b.column(k).slice(i, j - i) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(m[x]) for x in MEASURES] + [pa.array(bits)], names=schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


def rejected(policy: str, bits: Column | str = "failure_bits") -> Column:
    """Whether a policy version rejects a ledger row."""
    return (F.col(bits) if isinstance(bits, str) else bits).bitwiseAND(F.lit(mask_of(policy))) != 0


def ablation(book: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rows it fails, rows only it rejects, rows kept without it.

    The rows are first counted by bit pattern (at most 2**rules of them), so the rest is tiny.
    """
    mask = mask_of(policy)
    patterns = book.groupBy(F.col("failure_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rows = [(r.name, 1 << k) for k, r in enumerate(RULES) if mask >> k & 1]
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in rows])
    each = patterns.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return each.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0)("failed"),
        count(F.col("bits") == F.col("bit"))("only_this"),
        count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0)("kept_without"),
    )


def keep(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """The documents that a policy keeps, with the columns they came with."""
    own = [f"__own{i}" for i in range(len(docs.columns))]  # so that no column is taken for a measurement
    book = ledger(docs.toDF(*own), own[docs.columns.index(text)], keep_text=True)
    return book.where(~rejected(policy)).select(*own).toDF(*docs.columns)
