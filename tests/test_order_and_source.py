"""Isolated nodes by their source, and the order of near distances."""

from plantspark.operators import graphs, retrieval


def test_injected_nodes_stay(spark):
    rows = [(1, "", 0.1, "ocr_injected"), (2, "", 0.1, "yolov5"), (3, "", 0.1, None), (4, "V-1", 0.1, "yolov5"), (5, "", 0.9, None), (6, "", 0.1, None), (7, "", 0.1, None)]
    nodes = spark.createDataFrame(rows, "node_id long, isa_tag string, confidence double, source string")
    edges = spark.createDataFrame([(6, 7)], "src long, dst long")
    assert sorted(r["node_id"] for r in graphs.prune_isolated(nodes, edges).collect()) == [1, 4, 5, 6, 7]


def test_nearest_comes_before_a_lesser_key(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0004]), (2, [1.0, 0.0002]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    found = retrieval.search(vectors, [1.0, 0.0], 1).collect()
    assert [(r["vec_id"], r["distance"]) for r in found] == [(2, 0.0)]
