"""Stage 3 of the pipeline takes its groups from the operator of op9, and loses no row for its key."""

from collections import Counter

import corpus_pipeline
from plantspark.llm import simhash

from .conftest import prose


def test_stage_follows_the_links_of_the_operator(spark):
    # Texts, near copies of them, some within three bits and some not, and an exact copy.
    texts = [prose(k, 60) for k in range(12)] + [prose(k, 60) + " tail" for k in range(12)] + [prose(3, 60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    prints = [simhash.simhash(t) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 3:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    _, stage = corpus_pipeline.STAGES[2]
    kept = sorted(r["doc_id"] for r in stage(spark, docs, "").collect())
    assert kept == sorted(set(root)) and 12 < len(kept) < len(texts)
    # The exact likeness of word sets gives other groups.
    assert kept != sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())


def test_stage_keeps_rows_of_null_and_repeated_keys(spark):
    rows = [(k % 5 or None, prose(k, 40), "ab"[k % 2]) for k in range(40)]
    copies = [(None, prose(7, 40), "c"), (-1, prose(8, 40), "c")]
    docs = spark.createDataFrame(rows + rows[:7] + copies, "doc_id long, text string, source string").repartition(3)
    _, stage = corpus_pipeline.STAGES[2]
    kept = Counter(map(tuple, stage(spark, docs, "").collect()))
    # A null key is last and a lesser one first among copies.
    assert kept == Counter([r for k, r in enumerate(rows) if k != 8] + [copies[1]])
