"""The training-data operators applied to the test tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackfold.llm import (
    bitmask_codes,
    block_rotation,
    divergence_rules,
    exact_copies,
    extendible_shards,
    hamming_tables,
    hmm_score,
    lang_centroids,
    piece_lattice,
    prefix_join,
    source_mix,
    span_dedup,
    token_frames,
)
from trackfold.llm.base import documents
from trackfold.session import scratch_path


def id_remainder(modulus: int) -> Column:
    """CRC-32 of the id as text, by the modulus; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_score.score_documents(documents(spark, sf_dir), id_remainder(5) == 1)


def op2_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.piece_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op3_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    index = token_frames.write_tokens(documents(spark, sf_dir), scratch_path(spark, "tokens"), tokenizer)
    return token_frames.token_digests(index, tokenizer)


def op4_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.without_repeats(documents(spark, sf_dir))


def op5_lang_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_centroids.predict(documents(spark, sf_dir), id_remainder(4) == 2)


def op6_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards.extendible_shards(documents(spark, sf_dir))


def op7_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies.exact_copies(documents(spark, sf_dir))


def op8_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join.similar_documents(documents(spark, sf_dir))


def op9_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_rules.quality(documents(spark, sf_dir)).drop("mark").withColumns(
        {n: F.round(n, 6) for n in ("char_distance", "word_distance")})


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.taken_words(*source_mix.source_mix(documents(spark, sf_dir)))


def op11_block_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_rotation.digests(documents(spark, sf_dir))


def op12_hamming_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_tables.similar_prints(documents(spark, sf_dir))


def op13_bitmask_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitmask_codes.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_hmm_score, op2_piece_lattice, op3_token_frames, op4_span_dedup, op5_lang_centroids, op6_extendible_shards,
        op7_exact_copies, op8_prefix_join, op9_divergence_rules, op10_source_mix, op11_block_rotation, op12_hamming_tables,
        op13_bitmask_codes)
}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

GAP = r"[\x20\x09-\x0D]"
JS = """(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END
    + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END) / 2"""


def _quality_sql() -> str:
    rules = divergence_rules
    counted = ", ".join(f"strlen(regexp_replace(txt, '[^{regex[1:-2]}]', '', 'g')) AS {name}" for name, regex in (
        (n, r.replace("'", "''")) for n, r in rules.CLASSES.items()))
    named = " + ".join(rules.CLASSES)
    sums = ", ".join(f"sum({n}) AS {n}" for n in rules.SHARES)
    chars = " + ".join(JS.format(p=f"(c.{n} / c.bytes)", q=f"(r.{n} / r.bytes)") for n in rules.SHARES)
    return f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS txt, {WORDS} AS w FROM documents),
c AS (
  SELECT *, bytes - chars AS wide, chars - word_chars AS blanks, word_chars - ({named}) AS rest FROM (
    SELECT doc_id, lang, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, strlen(txt) AS bytes,
           length(txt) AS chars, {counted} FROM t)),
line AS (SELECT doc_id, unnest(string_split(txt, chr(10))) AS line FROM t),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM line
        WHERE regexp_matches(line, '[^' || substr('{GAP}', 2)) GROUP BY doc_id),
place AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t),
gram AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS times FROM place),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM gram, (SELECT unnest([0, 1, 2]) AS k)
        WHERE times > 1 GROUP BY doc_id),
plain AS (
  SELECT doc_id, lang, list_filter(string_split_regex(' ' || translate(txt, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') || ' ', '{rules.APART}'), lambda x: x <> '') AS pw FROM t),
word AS (SELECT doc_id, lang, len(pw) AS n_plain, unnest(pw) AS word FROM plain),
known AS (SELECT lang, word, count(*) AS n FROM word WHERE lang IS NOT NULL GROUP BY lang, word),
langs AS (SELECT lang FROM known GROUP BY lang HAVING sum(n) >= {rules.MIN_SHARE} * (SELECT sum(n) FROM known)),
top AS (SELECT lang, word, n / sum(n) OVER (PARTITION BY lang) AS share FROM known
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {rules.COMMON}),
ref AS (SELECT lang, sum(share) AS all_share FROM top JOIN langs USING (lang) GROUP BY lang),
own AS (SELECT doc_id, word, any_value(n_plain) AS n_plain, count(*) AS n FROM word GROUP BY doc_id, word),
seen AS (
  SELECT doc_id, top.lang, sum({JS.format(p='(n / n_plain)', q='share')} - share / 2) AS seen, sum(n / n_plain) AS p
  FROM own JOIN top USING (word) GROUP BY doc_id, top.lang),
wd AS (
  SELECT doc_id, min(sqrt(least(greatest(seen + all_share / 2 + {JS.format(p='greatest(1 - p, 0)', q='(1 - all_share)')}, 0), 1))
    / sqrt(all_share / 2 + {JS.format(p='1.0', q='(1 - all_share)')})) AS near
  FROM seen JOIN ref USING (lang) GROUP BY doc_id),
shares AS (SELECT lang, sum(bytes) AS bytes, {sums} FROM c JOIN langs USING (lang) GROUP BY lang),
cd AS (SELECT doc_id, min(sqrt(least(greatest({chars}, 0), 1))) AS char_distance FROM c CROSS JOIN shares r GROUP BY doc_id),
v AS (
  SELECT c.doc_id, n_words, word_chars, symbols AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         CASE WHEN bytes >= {rules.MIN_CHARS} AND judged THEN char_distance END AS char_distance,
         CASE WHEN n_words >= {rules.MIN_WORDS} AND judged THEN least(coalesce(near, 1), 1) END AS word_distance
  FROM c LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN cd USING (doc_id)
  LEFT JOIN wd USING (doc_id)
  LEFT JOIN (SELECT doc_id, lang IS NULL OR lang IN (FROM langs) AS judged FROM documents) USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(char_distance <= {rules.MAX_CHAR_DISTANCE}, true)
         AND coalesce(word_distance <= {rules.MAX_WORD_DISTANCE}, true) AS kept,
       round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM v)"""


def _codes_sql() -> str:
    """Assignment and move of the codebooks, written out round by round."""
    rules = bitmask_codes
    sql = f"""
WITH raw AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({rules.SCALE} * x::DOUBLE)) AS v FROM raw),
part AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * len(v) // {rules.PARTS} + 1:(p + 1) * len(v) // {rules.PARTS}] AS x
  FROM cut, (SELECT unnest(range({rules.PARTS})) AS p)),
book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM part
  QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {rules.ENTRIES})"""
    for n in range(rules.ROUNDS + 1):
        sql += f""",
near{n} AS MATERIALIZED (
  SELECT vec_id, label, p, any_value(x) AS x,
         min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'e': e}}) AS best
  FROM part JOIN book{n} USING (p) GROUP BY vec_id, label, p)"""
        if n < rules.ROUNDS:
            sql += f""",
mean{n} AS (
  SELECT p, e, list(m ORDER BY i) AS c FROM (
    SELECT p, best.e AS e, i, floor(sum(x[i]) / count(*)) AS m FROM near{n}, (SELECT unnest(range(1, 4097)) AS i)
    WHERE i <= len(x) GROUP BY ALL) GROUP BY p, e),
book{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean{n}.c, book{n}.c) AS c FROM book{n} LEFT JOIN mean{n} USING (p, e))"""
    last = rules.ROUNDS
    return sql + f""",
code AS (
  SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error
  FROM near{last} GROUP BY vec_id, label),
sha AS (
  SELECT sha256(string_agg(array_to_string(list_transform(c, lambda v: v::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256
  FROM book{last})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM code, sha"""


ORACLES: dict[str, str] = {
    "op13_bitmask_codes": _codes_sql(),
    "op11_block_rotation": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS txt, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
         sha256('7:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
d AS (
  SELECT *, len(lines)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN txt = '' OR contains(txt, '<P>') OR contains(txt, '<S>') OR contains(txt, '<M>') THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT *, array_to_string(lines[1:a], '') AS pre, array_to_string(lines[a + 1:b], '') AS mid,
         array_to_string(lines[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN txt WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(txt) AS restored_sha256
FROM p""",
    "op9_divergence_rules": _quality_sql(),
    "op6_extendible_shards": f"""
WITH bits AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
         lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT), 32, '0') AS h
  FROM documents),
deep AS (SELECT *, unnest(range(0, 33)) AS d FROM bits),
bucket AS (SELECT d, substr(h, 1, d) AS shard, sum(bytes) AS shard_bytes, count(*) AS shard_docs FROM deep GROUP BY 1, 2),
fit AS (
  SELECT doc_id, bytes, h, min(deep.d) AS depth
  FROM deep JOIN bucket ON bucket.d = deep.d AND bucket.shard = substr(h, 1, deep.d)
  WHERE shard_bytes <= {extendible_shards.MAX_BYTES} OR shard_docs = 1
  GROUP BY doc_id, bytes, h)
SELECT doc_id, bytes, shard, depth, shard_bytes::BIGINT AS shard_bytes, shard_docs
FROM fit JOIN bucket ON d = depth AND shard = substr(h, 1, depth)""",
    "op7_exact_copies": f"""
WITH t AS (SELECT doc_id, {LOWERED} AS txt FROM documents),
g AS (SELECT txt, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY txt)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(txt) AS text_sha256
FROM t JOIN g USING (txt)""",
    "op10_source_mix": f"""
WITH sized AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size,
         md5('{source_mix.SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY source),
lev AS (
  SELECT *, 3 * source_size AS most,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER o AS nth
  FROM src WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
one AS (SELECT arg_min(level, nth) AS level FROM lev WHERE most > level * weight),
goal AS (
  SELECT source, source_size,
         CASE WHEN weight * one.level < most THEN weight * one.level ELSE most::DOUBLE END AS target
  FROM lev LEFT JOIN one ON true),
plan AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS passes FROM goal),
run AS (
  SELECT sized.*, source_size, target, passes,
         coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized JOIN plan ON plan.source IS NOT DISTINCT FROM sized.source)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN before + size / 2 <= target - passes * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run""",
}
