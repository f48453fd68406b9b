import corpus_pipeline
from plantspark.llm import language_id, mixing, quality_model, simhash
from plantspark.llm.queries import fit_language, fit_quality, oracle_sql, queries

SMALL = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert len(corpus_pipeline.STAGES) == 5
    assert set(oracle_sql()) <= set(queries())
    assert {"pipeline"} | {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in queries()}


def test_stages_against_operators(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    (_, language), (_, quality), (_, near), (_, mixed), (_, encoded) = corpus_pipeline.STAGES

    one = language(spark, docs, SMALL)
    model = fit_language(docs)
    good = {r["doc_id"] for r in language_id.predict(docs, model).collect() if r["lang_pred"] != "und" and r["score"] >= language_id.LEAST_SCORE}
    assert {r["doc_id"] for r in one.collect()} == good and one.columns == docs.columns

    two = quality(spark, one, SMALL)
    kept = {r["doc_id"] for r in quality_model.predict(one, fit_quality(one, labels)).collect() if r["predicted"]}
    assert {r["doc_id"] for r in two.collect()} == kept and two.columns == docs.columns

    three = near(spark, two, SMALL).cache()
    firsts = {r["component_id"] for r in simhash.near_duplicates(two).collect()}
    assert sorted(r["doc_id"] for r in three.collect()) == sorted(firsts)

    four = mixed(spark, three, SMALL).cache()
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(three).collect()}
    counts = {r["doc_id"]: r["count"] for r in four.groupBy("doc_id").count().collect()}
    assert counts == {k: n for k, n in copies.items() if n} and four.columns == docs.columns

    five = encoded(spark, four, SMALL).collect()
    assert len(five) == four.count() == corpus_pipeline.run(spark, SMALL).count()


def test_stages_with_odd_rows(spark, odd, empty):
    odd = odd.withColumn("n_chars", odd["doc_id"])
    for rows in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, rows, SMALL).collect()
