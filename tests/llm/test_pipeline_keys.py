"""Rows without a key, or with one that others have, through stages 3 and 4."""

from collections import Counter

import corpus_pipeline
from plantspark.llm import mixing

from .conftest import prose


def test_null_and_repeated_keys_lose_nothing(spark):
    rows = [(k % 5 or None, prose(k, 40), "ab"[k % 2]) for k in range(40)]
    docs = spark.createDataFrame(rows + rows[:7], "doc_id long, text string, source string").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert Counter(map(tuple, kept)) == Counter(rows)

    exact = Counter()
    for r in mixing.mix(docs.withColumn("whole", docs["text"]), carry=("whole",)).collect():
        exact[r["doc_id"], r["whole"]] += r["copies"]
    mixed = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    assert mixed == +exact
