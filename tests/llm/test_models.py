"""The two models against brute force over sets and windows, and the bounds of what they learn from."""

import numpy as np

from plantspark.llm import language_id, quality_model, quality_rules
from plantspark.llm.common import new_folder

from .conftest import prose


def test_filters_hold_shared_grams_of_every_language():
    texts = {f"l{k:03}": prose(k, 200) for k in range(70)}
    sets = {name: np.unique(language_id.grams(language_id.normalise(t))) for name, t in texts.items()}
    model = language_id.sliced(sets, tuple(sorted(sets)))
    assert len(model.tables) == 2
    for name in ("l000", "l063", "l064", "l069"):
        own = language_id.grams(language_id.normalise(texts[name]))
        hits, total = model.counts(texts[name])
        assert total == len(own)
        for k, other in enumerate(model.languages):
            exact = np.isin(own, sets[other]).sum()
            assert exact <= hits[k] <= exact + 0.02 * total
        assert model.languages[int(np.argmax(hits))] == name


def test_shared_words_are_in_all_filters(spark):
    rows = [(k, "common words here " + x, lang) for k, (lang, x) in enumerate([("aa", "alpha beta"), ("bb", "gamma delta"), ("cc", "epsilon zeta")] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    hits, total = model.counts("common words")
    assert (hits >= total - 2).all()
    assert [language_id.Model.predict(model, x)[0] for x in ("alpha beta", "gamma delta", "epsilon zeta")] == ["aa", "bb", "cc"]


def test_seventy_languages(spark):
    rows = [(k, prose(k // 2, 30) + f" own{k // 2}word" * 30, f"l{k // 2:03}") for k in range(140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    found = language_id.predict(docs, language_id.fit(docs)).collect()
    assert np.mean([r["lang_pred"] == rows[r["doc_id"]][2] for r in found]) > 0.9


def test_convolution_against_brute_force(monkeypatch):
    model = quality_model.train([b"good text here " * 5, b"*** bad *** " * 5], [1, 0])
    for data in (b"", b"abc", prose(3, 40).encode(), prose(4, 90).encode()):
        padded = data + b"\0" * (max(quality_model.WIDTH - len(data), -(len(data) - quality_model.WIDTH) % quality_model.STRIDE))
        windows = [padded[a : a + quality_model.WIDTH] for a in range(0, len(padded) - quality_model.WIDTH + 1, quality_model.STRIDE)]
        sums = np.array([[sum(model.filters[k][w[k]][f] for k in range(quality_model.WIDTH)) for f in range(quality_model.FILTERS)] for w in windows])
        for chunk in (1 << 16, 32):
            monkeypatch.setattr(quality_model, "CHUNK", chunk)
            assert np.allclose(model.pooled(data), sums.max(axis=0), atol=1e-5)
            best, under = model.strongest(data)
            assert np.allclose(best, sums.max(axis=0), atol=1e-5)
            for f in range(quality_model.FILTERS):
                assert np.isclose(sum(model.filters[k][under[f, k]][f] for k in range(quality_model.WIDTH)), best[f], atol=1e-5)


def test_sample_is_bounded_under_repeated_texts(spark, monkeypatch):
    monkeypatch.setattr(quality_model, "ROWS", 20)
    texts = [prose(k, 20) for k in range(60)]
    rows = [(texts[0], 1)] * 3000 + [(texts[1], 0)] * 3000 + [(t, k % 2) for k, t in enumerate(texts)] + [(None, 1), ("x", None), ("y", 7)]
    docs = spark.createDataFrame(rows, "text string, label int").repartition(4)
    known = docs.where("text is not null").selectExpr("xxhash64(text) AS h", "label", "octet_length(text) AS n_bytes")
    chosen = quality_model.choose(known)
    assert len(chosen) == len(set(chosen)) == 40 and {k for _, k in chosen} == {0, 1}
    seen = []
    monkeypatch.setattr(quality_model, "train", lambda texts, labels: seen.append((texts, labels)))
    quality_model.fit(docs)
    assert len(seen[0][0]) == 40
    monkeypatch.setattr(quality_model, "ROWS", 1)
    quality_model.fit(docs.where("text is null or length(text) > 50"))
    assert sorted(seen[1][1]) == [0, 1]
    monkeypatch.setattr(quality_model, "TRAIN_BYTES", 200)
    quality_model.fit(docs)
    assert all(sum(len(t) for t, k in zip(*seen[2]) if k == label) <= 200 for label in (0, 1))


def test_stored_ledger_and_ablations(spark, odd, empty):
    folder = new_folder(spark, "ledger")
    rows = quality_rules.store(odd, folder).collect()
    assert sorted(map(str, rows)) == sorted(map(str, quality_rules.ledger(odd).collect()))
    found = spark.read.parquet(f"{folder}/ablations").collect()
    for version, rules in quality_rules.POLICIES.items():
        mask = quality_rules.policy_mask(version)
        exact = {
            (quality_rules.RULE_NAMES[k], len(rows), sum(r["failed"] >> k & 1 for r in rows), sum(r["failed"] & mask == 1 << k for r in rows)) for k in rules
        }
        assert {(r["rule"], r["n_documents"], r["n_failed"], r["n_only"]) for r in found if r["policy"] == version} == exact
    assert quality_rules.store(empty, new_folder(spark, "ledger")).collect() == []
