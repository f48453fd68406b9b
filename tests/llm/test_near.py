"""Near duplicates of the pipeline against brute force over all pairs."""

import random

import corpus_pipeline
from plantspark.llm import near

from .conftest import WORDS


def brute_groups(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if not a | b or 10 * len(a & b) >= 8 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return root


def test_near_dedup_equals_brute_force(spark, monkeypatch):
    r = random.Random(7)
    texts = [None, "", "one two", "One  two", "x"]
    for _ in range(12):
        base = [r.choice(WORDS) + str(r.randrange(50)) for _ in range(r.randrange(30, 300))]
        for _ in range(6):
            own = list(base)
            for _ in range(r.randrange(0, max(2, len(own) // 20))):
                own[r.randrange(len(own))] = "changed"
            texts.append(" ".join(own))
    root = brute_groups(texts)
    assert 20 < len(set(root)) < len(texts) - 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for cells, rounds, likeliest in ((near.CELLS, near.ROUNDS, near.LIKELIEST), (near.BLOCK, 1, 1)):
        for name, value in (("CELLS", cells), ("ROUNDS", rounds), ("LIKELIEST", likeliest)):
            monkeypatch.setattr(near, name, value)
        kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
        assert sorted(x["doc_id"] for x in kept) == sorted(set(root))
