"""Queries over the graph of all line items, against brute force."""

import pytest

from plantspark.plans import catalogue

#: l_orderkey, l_linenumber, l_partkey, l_suppkey: only the first is line 1 of an order that 16 divides.
ITEMS = [(16, 1, 10, 1), (16, 2, 71, 3), (3, 1, 500, 6), (5, 1, 300, 1), (7, 4, 101, 1), (8, 2, 1900, 3), (9, 3, 8, 1), (9, 1, 3, 1982)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("items"))
    spark.createDataFrame(ITEMS, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{path}/lineitem.parquet")
    return path


def links():
    pairs = [(a, (a * 7 + s) % 2000) for _, _, a, s in ITEMS]
    return sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]})


def groups(edges):
    root = {x: x for e in edges for x in e}
    for a, b in edges:
        low, high = sorted((root[a], root[b]))
        root = {k: low if v == high else v for k, v in root.items()}
    return root


def test_all_edges_make_the_graph(spark, folder):
    run = lambda name: catalogue.queries()[name](spark, folder).collect()
    edges, root = links(), groups(links())
    assert len(edges) > 5 and max(list(root.values()).count(x) for x in root.values()) >= 4
    assert {r["node_id"]: r["component"] for r in run("components")} == root
    assert {r["node_id"]: r["degree"] for r in run("degree")} == {x: sum(x in e for e in edges) for x in root}
    s = run("graph_summary")[0]
    assert (s["nodes"], s["edges"], s["components"]) == (len(root), len(edges), len(set(root.values())))
    found, new = set(), {b for a, b in edges if a % 50 == 1}
    while new:
        found, new = found | new, {b for a, b in edges if a in new} - found - new
    assert {r["node_id"] for r in run("reachability")} == found


def test_components_of_the_test_tables(spark):
    found = {r["node_id"]: r["component"] for r in catalogue.queries()["components"](spark, "/root/testdata/sf0.001").collect()}
    edges = [tuple(r) for r in catalogue.queries()["highlight"](spark, "/root/testdata/sf0.001").select("src", "dst").collect()]
    assert len(edges) > 1000 and found == groups(edges)
