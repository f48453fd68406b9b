"""Folds of byte-level BPE: cheap expressions only, equal ids when a task forgets its pieces."""

import base64
import hashlib
import random
import struct

import public_tokenizers

from plantspark.llm import byte_bpe

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def library():
    import tiktoken

    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_a_merge_has_no_dear_expression(odd):
    """array_position ends by an exception, once for each merge: about a third of the time of a fold."""
    plan = byte_bpe.encode_documents(odd, MULTI, PATTERN)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_min" in plan and "aggregate" in plan
    assert "array_position" not in plan and "concat(" not in plan


def test_invented_words_equal_library(spark, monkeypatch):
    """Pieces in no dictionary, a task that forgets its pieces again and again, ties, code points of any length."""
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 60)
    monkeypatch.setattr(byte_bpe, "DICTIONARY_PIECES", 40)
    r = random.Random(7)
    syllables = ["an", "the", "er", "ung", "ción", "ß", "ê", "日本", "😀", "aa", "q", "zz", "'", "\x00", "  ", "12"]
    texts = [" ".join("".join(r.choices(syllables, k=r.randint(1, 7))) for _ in range(r.randint(0, 60))) for _ in range(150)]
    texts += ["a" * k for k in (1, 2, 3, 127, 1000)] + ["abab" * 40, "é" * 99, "", "\n", " x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    enc = library()
    found = {x["doc_id"]: x for x in byte_bpe.round_trip(docs, MULTI, PATTERN).collect()}
    assert len(found) == len(texts)
    for k, text in enumerate(texts):
        ids = enc.encode_ordinary(text)
        assert found[k]["n_tokens"] == len(ids)
        assert found[k]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert found[k]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
