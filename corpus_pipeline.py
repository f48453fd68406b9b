"""A training corpus from raw documents, in five stages.

Each stage works on all that the one before kept. All but the last return the columns of
documents; the last returns the digests of what it encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantspark.llm import byte_bpe, language_id, mixing, near, quality_model, simhash
from plantspark.llm.common import discard, fresh, table, written
from plantspark.llm.queries import fit_language, fit_quality


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letters, or hardly an n-gram of any language) go."""
    return language_id.accept(docs, fit_language(docs))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict as good go."""
    return quality_model.accept(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def drop_linked_fingerprints(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints, as ``op9`` finds them, the row of least doc_id stays, once."""
    one, two = fresh("one", docs.columns), fresh("two", docs.columns)
    h1, h2 = near.row_hashes(docs)
    rows = docs.withColumns({one: h1, two: h2})
    return _only(rows, simhash.first_rows(rows, (one, two)), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with a Jaccard similarity of 0.8 or more of their five-word shingles the row of least doc_id stays, once.

    No stage of the pipeline, whose near duplicates are those of ``op9``.
    """
    one, two = fresh("one", docs.columns), fresh("two", docs.columns)
    h1, h2 = near.row_hashes(docs)
    return _only(docs.withColumns({one: h1, two: h2}), near.first_rows(docs).toDF(one, two), docs.columns)


def _only(rows: DataFrame, first: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose two hashes, which are columns of the same names in both tables, are in ``first``, once each."""
    one, two = first.columns
    three, four = fresh("three", rows.columns), fresh("four", rows.columns)
    # The rows that stay grow with the corpus, so they are never broadcast.
    stays = first.toDF(three, four).hint("merge")
    return rows.join(stays, (F.col(one) == F.col(three)) & (F.col(two) == F.col(four)), "left_semi").dropDuplicates([one, two]).select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; equal rows are told apart by nothing and come as often as they are taken together."""
    one, two = fresh("one", docs.columns), fresh("two", docs.columns)
    three, four, copies = (fresh(x, docs.columns) for x in ("three", "four", "copies"))
    h1, h2 = near.row_hashes(docs)
    rows = docs.withColumns({one: h1, two: h2})
    taken = mixing.mix(rows, carry=(one, two)).where("copies > 0").groupBy(F.col(one).alias(three), F.col(two).alias(four)).agg(F.sum("copies").cast("int").alias(copies))
    rows = rows.dropDuplicates([one, two]).join(taken.hint("merge"), (F.col(one) == F.col(three)) & (F.col(two) == F.col(four)))
    return rows.withColumn(one, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, as digests, and the digest of the text decoded from them."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", classify_quality),
    ("SimHash near-dedup", drop_linked_fingerprints),
    ("mixing to target weights", mix_sources),
    ("byte-level BPE", encode),
]

#: Trained models, SimHash links and BPE ids are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), "pipeline")
        if k:
            discard(before)
    return docs
