"""The registered queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, fingerprints, language_id, license_scan, mixing, quality_model, quality_rules, simhash, token_counts, token_files
from .common import crc32_mod, new_folder, table

#: Held-out rows: crc32 of the key's digits, modulo the first, is the second.
LANG_FOLD = (5, 0)
QUALITY_FOLD = (4, 2)


def _held_out(fold: tuple[int, int]):
    return F.coalesce(crc32_mod(F.col("doc_id"), fold[0]) == fold[1], F.lit(False))


def fit_language(documents: DataFrame) -> language_id.Model:
    """Learns from the rows that aren't held out."""
    return language_id.fit(documents.where(~_held_out(LANG_FOLD)))


def fit_quality(documents: DataFrame, labels: DataFrame) -> quality_model.Model:
    """Learns from the labelled rows that aren't held out."""
    marks = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("label")).where("label is not null")
    rows = documents.where(~_held_out(QUALITY_FOLD)).where("text is not null").select("doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n_bytes"))
    return quality_model.learn(documents, rows.join(marks, F.col("doc_id") == F.col("label_id")).select("h", "label", "n_bytes"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = language_id.predict(documents, fit_language(documents))
    return found.select("doc_id", _held_out(LANG_FOLD).alias("held_out"), "lang_pred", "score")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = quality_model.predict(documents, fit_quality(documents, table(spark, sf_dir, "labels")))
    return found.select("doc_id", _held_out(QUALITY_FOLD).alias("held_out"), "score", "predicted")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.store(table(spark, sf_dir, "documents"), new_folder(spark, "ledger"))
    base = quality_rules.apply_policy(rows, "base", "passes_base")
    return quality_rules.apply_policy(base, "v2").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("passes_base")).alias("base_failed"), "kept", "failed"
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_neighbours(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(spark, folder)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_language_id, op2_quality_classifier, op3_byte_bpe, op4_quality_rules, op5_fingerprints,
        op6_token_files, op7_license_scan, op8_token_counts, op9_simhash, op10_source_mix, pipeline,
    )
    return {f.__name__: f for f in own}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_sql() -> str:
    def normal(x: str) -> str:
        x = f"regexp_replace(lower(coalesce({x}, '')), '\\r\\n?', chr(10), 'g')"
        x = f"regexp_replace({x}, {_quoted(license_scan._COPYRIGHT_LINE)}, ' ', 'g')"
        x = f"' ' || trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
        for one, *others in license_scan.SPELLINGS:
            for other in others:
                x = f"replace({x}, ' {other} ', ' {one} ')"
        return f"sha256(trim({x}))"

    known = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, texts in license_scan.KNOWN.items() for text in texts)
    return f"""
WITH k AS (SELECT min(license) AS license, {normal('text')} AS digest FROM (VALUES {known}) v(license, text) GROUP BY 2),
d AS (SELECT doc_id, {normal('text')} AS digest FROM documents)
SELECT d.doc_id, d.digest, k.license IS NOT NULL AS is_license, k.license FROM d LEFT JOIN k ON d.digest = k.digest
"""


_RULES_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
m AS (
  SELECT doc_id, t, w, len(w) AS n_words, length(t) - length(regexp_replace(t, '\\p{Lu}', '', 'g')) AS n_upper,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d),
g AS (SELECT doc_id, unnest(range(1, n_words - 1)) AS i, w FROM m WHERE n_words >= 3),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM k WHERE c > 1) GROUP BY 1),
r AS (SELECT m.doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, n_upper,
    coalesce(p.n, 0) AS n_repeat_words FROM m LEFT JOIN p ON m.doc_id = p.doc_id),
b AS (SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN n_repeat_words * 100 > n_words * 50 THEN 2 ELSE 0 END
    + CASE WHEN n_symbols * 10 > n_words * 3 THEN 4 ELSE 0 END + CASE WHEN n_dup_lines * 10 > n_lines * 3 THEN 8 ELSE 0 END
    + CASE WHEN word_chars < n_words * 2 THEN 16 ELSE 0 END + CASE WHEN word_chars > n_words * 20 THEN 32 ELSE 0 END
    + CASE WHEN n_upper * 10 > word_chars * 4 THEN 64 ELSE 0 END AS failed FROM r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failed % 4 <> 0 AS base_failed, failed = 0 AS kept,
  CAST(failed AS BIGINT) AS failed
FROM b
"""

_MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS place FROM d GROUP BY source),
w AS (SELECT *, place % 3 + 1 AS weight, source_size / (place % 3 + 1) AS by_weight FROM s),
c AS (SELECT *, (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS left_weight,
    (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0))::BIGINT AS left_size
  FROM w WINDOW b AS (ORDER BY by_weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT by_weight, place, left_size, left_weight FROM c WHERE NOT left_size * weight >= 3 * source_size * left_weight ORDER BY by_weight, place LIMIT 1),
t AS (SELECT c.source, c.source_size,
    CASE WHEN f.place IS NULL OR (c.by_weight, c.place) < (f.by_weight, f.place) THEN CAST(3 * c.source_size AS DOUBLE)
      ELSE CAST(f.left_size * c.weight AS DOUBLE) / f.left_weight END AS target FROM c LEFT JOIN f ON true),
x AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
y AS (SELECT *, target - whole * source_size AS rest FROM x),
z AS (SELECT *, CASE WHEN source_size > 0 THEN rest / source_size ELSE 0.0::DOUBLE END AS inclusion FROM y),
r AS (SELECT d.doc_id, d.size, z.*, (d.u + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS v FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source),
q AS (SELECT *, CASE WHEN inclusion > 0 THEN (v / (1 - v)) / (inclusion / (1 - inclusion)) END AS rank FROM r),
a AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until FROM q WHERE rank IS NOT NULL),
e AS (SELECT source, max(CASE WHEN until <= rest THEN until ELSE 0 END) AS filled, any_value(rest) AS rest FROM a GROUP BY source),
o AS (SELECT a.source, arg_min(a.doc_id, (abs(a.size - (e.rest - e.filled)), a.rank, a.size, a.doc_id)) AS doc_id
  FROM a JOIN e ON a.source IS NOT DISTINCT FROM e.source
  WHERE a.until > a.rest AND a.size > 0 AND abs(a.size - (e.rest - e.filled)) < e.rest - e.filled GROUP BY a.source)
SELECT q.doc_id, CAST(q.size AS BIGINT) AS size, q.source_size, q.target,
  CAST(q.size * (q.whole + CASE WHEN a.until <= a.rest OR o.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM q LEFT JOIN a ON q.doc_id = a.doc_id LEFT JOIN o ON q.doc_id = o.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """What SQL can express; the others are tested against brute force."""
    return {"op4_quality_rules": _RULES_SQL, "op7_license_scan": _license_sql(), "op10_source_mix": _MIX_SQL}
