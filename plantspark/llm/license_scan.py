"""Canonical digest lookup of whole texts that are a known licence (DataFrame functions only).

A text is normalised: lower case, copyright and rights-reserved lines out, titles and links
kept as words, equivalent spellings mapped to one, everything but letters and digits turned
into single blanks. Its SHA-256 is joined to the digests of known licence texts, normalised
by the same expressions. The known side has one row per digest, and there are as many as
``license_texts`` has texts (a fixed, small number), so it is broadcast.

Null and empty texts have the digest of no words and match nothing. Repeated rows each get
their own answer. Columns of the input besides key and text are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import whole_text
from .license_texts import KNOWN, whole_texts

#: Equivalent spellings, each mapped to the first of its line.
SPELLINGS = (
    ("license", "licence"),
    ("licensed", "licenced"),
    ("licenses", "licences"),
    ("sublicense", "sub license", "sublicence", "sub licence"),
    ("merchantability", "merchantibility"),
    ("noninfringement", "non infringement"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("judgment", "judgement"),
    ("organization", "organisation"),
    ("and", "und"),
)

_COPYRIGHT_LINE = "(?m)^[^\\S\\n]*(?:[#*/;%.\\-]+[^\\S\\n]*)*(?:(?:portions )?copyright (?:\\(c\\)|©|[0-9]{4}).*|\\(c\\) .*|© ?.*|all rights reserved\\.?)$"


def normalise(text: Column) -> Column:
    """The text's canonical words, separated by single blanks."""
    low = F.regexp_replace(F.lower(whole_text(text)), "\\r\\n?", "\n")
    plain = F.trim(F.regexp_replace(F.regexp_replace(low, _COPYRIGHT_LINE, " "), "[^\\p{L}\\p{N}]+", " "))
    padded = F.concat(F.lit(" "), plain, F.lit(" "))
    for one, *others in SPELLINGS:
        padded = reduce(lambda x, other: F.replace(x, F.lit(f" {other} "), F.lit(f" {one} ")), others, padded)
    return F.trim(padded)


def digest(text: Column) -> Column:
    return F.sha2(normalise(text).cast("binary"), 256)


def known_digests(spark: SparkSession) -> DataFrame:
    """(license, license_digest) of the known texts."""
    rows = [(name, text) for name, texts in KNOWN.items() for text in texts] + whole_texts()
    known = spark.createDataFrame(rows, "license string, text string").select("license", digest(F.col("text")).alias("license_digest"))
    return known.groupBy("license_digest").agg(F.min("license").alias("license"))


def scan(documents: DataFrame, known: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, digest, is_license, license (null if the text is no known licence)."""
    spark = documents.sparkSession
    rows = documents.select(F.col(key), digest(F.col(text)).alias("digest"))
    listed = F.broadcast(known_digests(spark)) if known is None else known
    return rows.join(listed, F.col("digest") == F.col("license_digest"), "left").select(
        key, "digest", F.col("license").isNotNull().alias("is_license"), "license"
    )
