"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, divergence, feistel_shards, line_dedup, minhash_forest, mixing, packing, pii_surrogates, prefix_tokens, quality_gam, quality_rules, resampling, substring_dedup
from .store import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = _table(spark, sf_dir, "documents")
    return quality_gam.score(docs, quality_gam.train(docs, _table(spark, sf_dir, "labels")))


def op2_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document, the benchmark items that it contains up to the edit bound."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contaminations(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "least_edits", "short_item_ids")


def op3_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its exact repeats of 35 words or more."""
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of every document, and the verdict of policy v1."""
    book = quality_rules.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return book.select(*columns, quality_rules.rejected("base").alias("base_failed"), (~quality_rules.rejected("v1")).alias("kept"), "failure_bits")


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return feistel_shards.shards(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    return pii_surrogates.replace_entities(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def op7_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, whether 4096 tokens hold it, and how many characters they hold, from the stored prefix counts."""
    docs = _table(spark, sf_dir, "documents")
    program = written(prefix_tokens.prefix_counts(docs, public_tokenizers.path("piece_bpe_32k.model")), "prefix-program")
    counts = prefix_tokens.answers(program, 4096)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "n_chars", "fits")


def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later copies of runs of three lines or more."""
    clean = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return clean.select("doc_id", "n_lines", "n_removed", "longest_run", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and offset of every piece of every document."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return minhash_forest.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_mixed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix of all sources takes."""
    return mixing.taken(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every pair of sources of a language, and the terms that set each source apart."""
    return divergence.audit(_table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance score of every document towards the benchmark's texts, and the ranks of those drawn."""
    return resampling.resample(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_gam, op2_cgk_decontamination, op3_fixed_block_anchors, op4_rule_ledger, op5_feistel_shards, op6_pii_surrogates, op7_prefix_tokens, op8_line_runs, op9_best_fit_packing, op10_minhash_forest, op11_mixed_blocks, op12_divergence_audit, op13_target_resampling)
}

_WORD = r"[^\x20\x09-\x0D]+"


def _feistel_sql(key: str = "shards-v1", passes: int = 4) -> str:
    """The network unrolled, one common table per round; at the sizes of a check no walk needs more than ``passes``."""
    prime, small = feistel_shards.PRIME, feistel_shards.SMALL_PRIME
    tables = [
        "d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS t FROM documents)",
        "crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS steps)",
        "n AS (SELECT count(*) AS n, CAST(floor(sqrt(greatest(count(*) - 1, 0))) AS BIGINT) + 1 AS a FROM documents)",
        "p0 AS (SELECT doc_id, size, t, n, a, (n + a - 1) // a AS b, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM d, n)",
    ]
    for i in range(passes):
        last = f"p{i}"
        tables.append(f"r{i}_0 AS (SELECT *, p % a AS x, p // a AS y, a AS m, b AS k FROM {last})")
        for r, (c0, c1, c2, c3, c4) in enumerate(feistel_shards.round_keys(key)):
            f = f"((((y * {c0} + {c1}) % {prime}) * ((y * {c2} + {c3}) % {small}) + {c4}) % {prime})"
            tables.append(f"r{i}_{r + 1} AS (SELECT * EXCLUDE (x, y, m, k), y AS x, (x + {f}) % m AS y, k AS m, m AS k FROM r{i}_{r})")
        done = "p" if i else "-1"
        walked = f"CASE WHEN {i} > 0 AND p < n THEN {done} ELSE x + y * a END"
        tables.append(f"p{i + 1} AS (SELECT doc_id, size, t, n, a, b, {walked} AS p FROM r{i}_{feistel_shards.ROUNDS})")
    return "WITH " + ",\n".join(tables) + f"\nSELECT doc_id, CAST(size AS BIGINT) AS size, xor(list_reduce([4294967295] || [CAST('0x' || h AS BIGINT) FOR h IN regexp_extract_all(hex(encode(t)), '..')], lambda c, x: xor(steps[xor(c, x) % 256 + 1], c // 256)), 4294967295) AS text_crc32, 'rows' AS law, CAST(p % 8 AS INTEGER) AS shard, p // 8 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p{passes}, crc"


ORACLE_SQL: dict[str, str] = {"op5_feistel_shards": _feistel_sql()}
ORACLE_SQL["op4_rule_ledger"] = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
k AS (SELECT doc_id, i, words[i : i + 2] AS gram FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM k) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
      length(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id LEFT JOIN l ON w.doc_id = l.doc_id),
b AS (SELECT *, CAST((n_words < 50) AS BIGINT) + 2 * CAST((100 * n_repeat_words > 50 * n_words) AS BIGINT) + 4 * CAST((100 * n_symbols > 10 * n_words) AS BIGINT)
      + 8 * CAST((100 * n_dup_lines > 30 * n_lines) AS BIGINT) + 16 * CAST((n_upper > n_lower) AS BIGINT) + 32 * CAST((100 * n_bangs > 10 * n_words) AS BIGINT)
      + 64 * CAST((word_chars > 15 * n_words) AS BIGINT) AS failure_bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failure_bits & 3 != 0 AS base_failed, failure_bits = 0 AS kept, CAST(failure_bits AS BIGINT) AS failure_bits FROM b"""
ORACLE_SQL["op3_fixed_block_anchors"] = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 34], ' ')) AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY gram) AS n FROM g) WHERE n > 1),
x AS (SELECT doc_id, p, word FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w)),
d AS (SELECT DISTINCT doc_id, i + j AS p FROM r, (SELECT unnest(range(35)) AS j)),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) FILTER (d.p IS NULL) AS kept, count(d.p) AS n_removed FROM x LEFT JOIN d ON x.doc_id = d.doc_id AND x.p = d.p GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id"""
ORACLE_SQL["op8_line_runs"] = r"""
WITH s AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM s),
q AS (SELECT doc_id, line, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
r AS (SELECT doc_id, seq, [line, lead(line, 1) OVER d, lead(line, 2) OVER d] AS run, lead(line, 2) OVER d AS third FROM q WINDOW d AS (PARTITION BY doc_id ORDER BY seq)),
o AS (SELECT doc_id, seq, run, dense_rank() OVER (ORDER BY run) AS k, row_number() OVER (ORDER BY doc_id, seq) AS place FROM r WHERE third IS NOT NULL),
f AS (SELECT a.doc_id, a.seq, b.doc_id AS d0, b.seq AS s0 FROM o a JOIN o b ON a.k = b.k AND b.place < a.place),
i AS (SELECT doc_id, d0, s0 - seq AS way, seq - row_number() OVER (PARTITION BY doc_id, d0, s0 - seq ORDER BY seq) AS island FROM f),
x AS (SELECT doc_id, max(n) + 2 AS longest_run FROM (SELECT doc_id, count(*) AS n FROM i GROUP BY doc_id, d0, way, island) GROUP BY doc_id),
g AS (SELECT DISTINCT doc_id, seq + j AS seq FROM f, (SELECT unnest([0, 1, 2]) AS j)),
k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.seq IS NULL) AS kept, count(q.seq) AS n_lines, count(g.seq) AS n_removed
      FROM l LEFT JOIN q ON l.doc_id = q.doc_id AND l.pos = q.pos LEFT JOIN g ON q.doc_id = g.doc_id AND q.seq = g.seq GROUP BY l.doc_id)
SELECT s.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(longest_run, 0) AS BIGINT) AS longest_run, sha256(coalesce(kept, '')) AS kept_sha256 FROM s LEFT JOIN k ON s.doc_id = k.doc_id LEFT JOIN x ON s.doc_id = x.doc_id"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL["op12_divergence_audit"] = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
c AS (SELECT id, lang, source, term, count(*) AS n FROM (SELECT id, lang, source, unnest(words) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS ln FROM c GROUP BY lang, term HAVING count(*) >= 10),
l AS (SELECT lang, count(*) AS v, sum(ln) AS lw FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT lang, source, term, sum(n) AS n FROM c SEMI JOIN k USING (lang, term) GROUP BY ALL),
gw AS (SELECT lang, source, sum(n) AS w FROM gn GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(gn.n, 0) AS n, 1 + (1000000000 * (coalesce(gn.n, 0) + 2)) // (coalesce(gw.w, 0) + 2 * l.v) AS p, 1 + (1000000000 * (k.ln + 2)) // (l.lw + 2 * l.v) AS q
      FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN gw ON gw.lang = g.lang AND gw.source = g.source LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source AND gn.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
x AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM x WHERE part = 'pair' OR rank <= 10"""
ORACLE_SQL["op13_target_resampling"] = rf"""
WITH a AS (SELECT row_number() OVER () AS id, doc_id, text, true AS have FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, false FROM benchmark),
w AS (SELECT id, doc_id, have, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM a),
u AS (SELECT id, have, unnest(words) AS word FROM w),
crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS steps),
b AS (SELECT word, xor(list_reduce([4294967295] || [CAST('0x' || h AS BIGINT) FOR h IN regexp_extract_all(hex(encode(word)), '..')], lambda c, x: xor(steps[xor(c, x) % 256 + 1], c // 256)), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT word FROM u), crc),
f AS (SELECT id, have, bucket, count(*) AS n FROM u JOIN b USING (word) GROUP BY ALL),
t AS (SELECT bucket, coalesce(sum(n) FILTER (have), 0) AS s, coalesce(sum(n) FILTER (NOT have), 0) AS t FROM f GROUP BY bucket),
z AS (SELECT coalesce(sum(s), 0) AS sa, coalesce(sum(t), 0) AS ta FROM t),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sa + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(ta + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM t, z),
k AS (SELECT id, sum(n) AS n_features, sum(n * gain) AS weight FROM f JOIN g USING (bucket) WHERE have GROUP BY id),
x AS (SELECT w.id, w.doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
      CAST('0x' || substr(sha256('2024:' || coalesce(CAST(w.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN k ON w.id = k.id WHERE have),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM y)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN n_words >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM r"""
