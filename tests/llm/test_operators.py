import hashlib
import re
import struct
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plantspark.llm import byte_bpe, fingerprints, language_id, license_scan, mixing, quality_model, quality_rules, simhash, token_counts, token_files
from plantspark.llm.common import new_folder

from .conftest import SCHEMA, prose

WORD = re.compile("[^\x20\x09-\x0d]+")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def by_text(rows, odd_rows, key="doc_id"):
    """(row, text) pairs; repeated rows have equal answers, so any order of them will do."""
    texts = {r[0]: r[1] for r in odd_rows}
    assert Counter(r[key] for r in rows) == Counter(r[0] for r in odd_rows)
    return [(r, texts[r[key]]) for r in rows]


def test_bpe_equals_library(odd, odd_rows):
    import base64

    import tiktoken

    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = byte_bpe.round_trip(odd, MULTI, public_tokenizers.PATTERN).collect()
    for r, text in by_text(found, odd_rows):
        ids = enc.encode_ordinary(text or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_decodes_its_ids(odd, odd_rows, empty):
    made = byte_bpe.encode_documents(odd, MULTI, public_tokenizers.PATTERN)
    for r, text in by_text(byte_bpe.decode_documents(made, MULTI).collect(), odd_rows):
        assert bytes(r["bytes"]).decode() == (text or "")
    assert byte_bpe.round_trip(empty, MULTI, public_tokenizers.PATTERN).collect() == []


def brute_rules(text):
    text = text or ""
    w = WORD.findall(text)
    windows = list(zip(w, w[1:], w[2:]))
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rules_equal_brute_force(odd, odd_rows, empty):
    rows = quality_rules.ledger(odd).collect()
    for r, text in by_text(rows, odd_rows):
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_rules(text)
        assert bool(r["failed"] & 1) == (r["n_words"] < 50)
    assert quality_rules.ledger(empty).collect() == []
    counts = {r["rule"]: r for r in quality_rules.ablation(quality_rules.ledger(odd), "v1").collect()}
    assert counts["few_words"]["n_failed"] == sum(r["failed"] & 1 for r in rows)
    assert counts["few_words"]["n_only"] == sum(r["failed"] & quality_rules.policy_mask("v1") == 1 for r in rows)
    assert all(r["n_documents"] == 0 for r in quality_rules.ablation(quality_rules.ledger(empty), "v1").collect())


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a", "a b c d a b c x b c d", "a b", "x y z x y", "a b a b a b a"])
def test_repeated_words(spark, text):
    found = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert quality_rules.measures(found).first()["n_repeat_words"] == brute_rules(text)[-1]


def shingles(text):
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def test_fingerprints_against_exact_likeness(spark):
    texts = [prose(7 + k // 2, 400) if k % 2 else prose(7 + k // 2, 400)[: 400 * 3] + " " + prose(50 + k, 200) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = sorted(fingerprints.with_neighbours(docs).collect())
    off = []
    for k, r in enumerate(rows):
        text, after = texts[k], texts[(k + 1) % len(texts)]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (k, len(text), hashlib.sha256(edited.encode()).hexdigest())
        for value, other in ((r["near_edited"], edited), (r["near_next"], after)):
            a, b = shingles(text), shingles(other)
            off.append(value - len(a & b) / len(a | b))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06 and max(map(abs, off)) < 0.2


def test_fingerprints_of_odd_rows(odd, odd_rows, empty):
    rows = fingerprints.with_neighbours(odd).collect()
    prints = {}
    for r, text in by_text(rows, odd_rows):
        assert len(r["fingerprint"]) == fingerprints.BINS * fingerprints.BITS // 4
        assert prints.setdefault(text or "", r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert prints[prose(1, 80)] != prints[prose(2, 300)]
    assert set(prints[""]) == {"-"}
    assert fingerprints.with_neighbours(empty).collect() == []


def test_ranges_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(k * 3, prose(k, 30)) for k in range(50)], "doc_id long, text string").repartition(4)
    one = sorted(fingerprints.with_neighbours(docs).collect())
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 4)
    assert sorted(fingerprints.with_neighbours(docs).collect()) == one


def brute_components(prints):
    keys = sorted(k for k in prints if k is not None)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def brute_simhash(text):
    import xxhash

    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_of_odd_rows(odd, odd_rows, empty):
    rows = by_text(simhash.near_duplicates(odd).collect(), odd_rows)
    exact = brute_components({r[0]: brute_simhash(r[1]) for r in odd_rows if r[0] is not None})
    for r, text in rows:
        assert r["fingerprint"] == f"{brute_simhash(text):016x}"
        if r["doc_id"] is not None:
            assert r["component_id"] == exact[r["doc_id"]]
    assert simhash.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("block", [4096, 3])
def test_links_lose_nothing(spark, block):
    r = np.random.default_rng(5)
    values = [0]
    for centre in r.integers(0, 1 << 62, 25).tolist():
        for _ in range(12):
            for b in r.integers(0, 64, int(r.integers(0, 5))).tolist():
                centre ^= 1 << b
            values.append(centre)
    signed = [int(np.uint64(x).view(np.int64)) for x in set(values)]
    prints = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(prints, block)).collect()}
    exact = brute_components({x: x & (1 << 64) - 1 for x in signed})
    assert {x: found.get(x, x) for x in signed} == exact


def test_language_held_out(spark):
    lists = {"aa": "the of and house water tree", "bb": "der und haus wasser baum nicht", "cc": "le maison eau arbre et pas"}
    r = np.random.default_rng(3)
    rows = [(k, " ".join(r.choice(v.split(), 40)), lang) for k, (lang, v) in enumerate(list(lists.items()) * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs.where("doc_id % 2 = 0"))
    found = language_id.predict(docs.where("doc_id % 2 = 1"), model).collect()
    assert all(r["lang_pred"] == rows[r["doc_id"]][2] and 0.5 < r["score"] <= 1 for r in found)


def test_language_of_odd_rows(odd, odd_rows, empty):
    model = language_id.fit(odd)
    for r, text in by_text(language_id.predict(odd, model).collect(), odd_rows):
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text or "")))
    none = language_id.fit(empty)
    assert {r["lang_pred"] for r in language_id.predict(odd, none).collect()} == {"und"}
    assert language_id.accept(empty, model).collect() == []
    assert language_id.accept(odd, model, least=0.0).columns == odd.columns


def test_language_pieces_hold_every_gram(monkeypatch):
    text = prose(4, 400)
    whole = np.sort(np.concatenate([language_id.grams(p) for p in language_id.pieces(text)]))
    monkeypatch.setattr(language_id, "PIECE", 37)
    cut = np.sort(np.concatenate([language_id.grams(p) for p in language_id.pieces(text)]))
    assert np.array_equal(whole, cut)


def test_sliced_filter_has_no_false_negatives():
    values = np.random.default_rng(1).integers(0, 1 << 40, 500).astype(np.uint64)
    table = np.zeros(language_id.SLOTS, np.uint8)
    for s in language_id.slots(values):
        table[s] |= 2
    masks = np.full(len(values), 255, np.uint8)
    for s in language_id.slots(values):
        masks &= table[s]
    assert (masks == 2).all()


def test_quality_held_out(spark):
    rows = [(k, prose(k, 60) if k % 2 else " ".join(x + "***" for x in prose(k, 60).split()), k % 2) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality_model.fit(docs.where("doc_id < 120"))
    found = quality_model.predict(docs.where("doc_id >= 120"), model).collect()
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in found]) > 0.95


def test_quality_of_odd_rows(odd, odd_rows, empty):
    rows = odd.withColumn("label", (F.col("doc_id") % 2).cast("int"))
    model = quality_model.fit(rows)
    seen = {}
    for r, text in by_text(quality_model.predict(odd, model).collect(), odd_rows):
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
        assert seen.setdefault(text or "", r["score"]) == r["score"]
    assert quality_model.predict(empty, model).collect() == []
    assert quality_model.fit(empty.withColumn("label", F.lit(1))).score(b"x") == 0.5
    assert quality_model.accept(odd, model, least=0.0).count() == len(odd_rows)


def test_quality_chunks_cover_the_text(monkeypatch):
    model = quality_model.train([b"good text here " * 5, b"*** bad *** " * 5], [1, 0])
    data = prose(8, 500).encode()
    whole = model.pooled(data)
    monkeypatch.setattr(quality_model, "CHUNK", 64)
    assert np.allclose(model.pooled(data), whole)


def test_token_files_round_trip(spark, odd, odd_rows, empty, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = new_folder(spark, "test")
    token_files.write(odd, folder, path)
    rows = sorted(token_files.read(spark, folder).collect(), key=lambda r: r["start"])
    library, at = Tokenizer.from_file(path), 0
    texts = {r[0]: r[1] for r in odd_rows}
    assert [r["doc_id"] for r in rows] == sorted((r[0] for r in odd_rows), key=lambda k: (k is not None, k or 0))
    for r in rows:
        ids = np.array([*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    folder = new_folder(spark, "test")
    token_files.write(empty, folder, path)
    assert token_files.read(spark, folder).collect() == []


def test_documents_over_several_blocks(spark, tmp_path):
    # Small blocks need a patched module in the workers, so blocks are made by hand here.
    ids = np.random.default_rng(2).integers(0, 50_000, 1000).astype("<u4").tobytes()
    assert token_files.from_planes(token_files.to_planes(ids)) == ids
    crc = 0
    for a, b in pairwise([0, 4, 400, 404, 4000]):
        part = zlib.crc32(ids[a:b])
        crc = token_files.joined_crc32(crc, part, b - a) if a else part
    assert crc == zlib.crc32(ids)


def test_license_scan(spark, odd, odd_rows, empty):
    mit = license_scan.KNOWN["MIT"][0]
    texts = [
        mit, "The MIT License (MIT)\n\nCopyright (c) 2019 Some One\n\n" + mit.upper().replace(",", " ;"), mit.replace("sublicense", "sub-license"),
        mit + " more", "# Copyright 2001 Me\n" + license_scan.KNOWN["ISC"][0], "Released under the MIT License.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["license"] for r in license_scan.scan(docs).collect()}
    assert found == {0: "MIT", 1: "MIT", 2: "MIT", 3: None, 4: "ISC", 5: "MIT"}
    assert not any(r["is_license"] for r, _ in by_text(license_scan.scan(odd).collect(), odd_rows))
    assert license_scan.scan(empty).collect() == []


def test_token_counts(odd, odd_rows, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for r, text in by_text(token_counts.token_counts(odd, path).collect(), odd_rows):
        n = len(library.encode(text or ""))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((text or "").encode()), n > 4096)
    assert token_counts.token_counts(empty, path).collect() == []


@pytest.mark.parametrize(("chunk", "overlap"), [(100, 4), (333, 10), (1000, 50), (5000, 8)])
def test_resynchronised_counts(chunk, overlap):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert token_counts.stable(path)
    for text in (prose(3, 3000), "x" * 4000 + " " + prose(4, 50), " ".join("ab  c日本" for _ in range(900)), "  " * 3000, "▁a▁ b" * 800):
        assert token_counts.count_long(text, path, chunk, overlap) == len(library.encode(text))


def test_mix_meets_targets(spark):
    r = np.random.default_rng(4)
    rows = [(k, " ".join(["w"] * int(r.integers(1, 60))), "abcdef"[min(5, k % 11)]) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = mixing.mix(docs).collect()
    total, sizes, taken, target = 0, Counter(), Counter(), {}
    for x in found:
        assert x["taken"] <= 3 * x["size"] and x["taken"] == x["copies"] * x["size"]
        total += x["size"]
        sizes[x["source"]] += x["size"]
        taken[x["source"]] += x["taken"]
        target[x["source"]] = x["target"]
    left, open_, weight = float(total), set(sizes), {s: 1 + i % 3 for i, s in enumerate(sorted(sizes))}
    exact = {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        capped = {s for s in open_ if share[s] > 3 * sizes[s]}
        exact |= share
        if not capped:
            break
        for s in capped:
            exact[s] = 3.0 * sizes[s]
            left -= exact[s]
        open_ -= capped
    for s in sizes:
        assert target[s] == pytest.approx(exact[s])
        assert abs(taken[s] - target[s]) <= 60
    assert sorted(found) == sorted(mixing.mix(docs.repartition(2)).collect())


def test_mix_of_odd_rows(odd, odd_rows, empty):
    rows = mixing.mix(odd).collect()
    for r, text in by_text(rows, odd_rows):
        assert r["size"] == len(WORD.findall(text or "")) and 0 <= r["taken"] <= 3 * r["size"]
    assert sum(r["target"] / list(x["source"] for x in rows).count(r["source"]) for r in rows) == pytest.approx(sum(r["size"] for r in rows))
    assert mixing.mix(empty).collect() == []
    assert {r["taken"] for r in mixing.mix(odd.withColumn("text", F.lit(None).cast("string"))).collect()} == {0}


def test_schema_of_fixture():
    assert "fingerprint" in SCHEMA  # the odd rows hold columns that clash with results


@pytest.mark.parametrize("text", ["a b\nc", "x,y. z", "don't 's,'ll", "wow!! #1 a,,b ,c", "a  b", " a", "a\n", "a\tb c", "é_ü, ß-x; (q)", "1,000.50 %", "a\x1c b", "", "thnd*** is&&& x,###"])
def test_parts_keep_the_matches(text):
    import regex

    from plantspark.llm.common import SPLIT_PATTERN, parts

    assert SPLIT_PATTERN == public_tokenizers.PATTERN
    found, whole = parts(text), regex.findall(SPLIT_PATTERN, text)
    assert found is None or [m for p in found for m in regex.findall(SPLIT_PATTERN, p)] == whole


def test_parts_of_random_texts():
    import regex

    from plantspark.llm.common import SPLIT_PATTERN, parts

    r, seen = np.random.default_rng(6), 0
    for _ in range(4000):
        text = "".join(r.choice(list("aé1,.!'_# \n\t"), int(r.integers(1, 12)), p=[0.3, 0.05, 0.05, 0.1, 0.1, 0.05, 0.05, 0.02, 0.05, 0.16, 0.05, 0.02]))
        if found := parts(text):
            seen += 1
            assert [m for p in found for m in regex.findall(SPLIT_PATTERN, p)] == regex.findall(SPLIT_PATTERN, text), text
    assert seen > 500
