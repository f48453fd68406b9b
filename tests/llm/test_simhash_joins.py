"""Joins of op9 grow with the documents on both sides: none is broadcast through the driver."""

from plantspark.llm import simhash

from .conftest import prose


def test_no_join_is_broadcast(spark):
    docs = spark.createDataFrame([(k, prose(k % 7, 40 + k % 3)) for k in range(30)], "doc_id long, text string")
    found = simhash.near_duplicates(docs)
    prints = simhash.fingerprints(docs).select("fingerprint")
    for df in (found, simhash.links(prints)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
