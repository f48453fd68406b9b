"""Simple paths up to the reference's cutoff, against brute force."""

from types import SimpleNamespace

from plantspark.plans import catalogue


def brute(edges, path, target, most):
    if path[-1] == target:
        return {"-".join(map(str, path))}
    near = {b for a, b in edges + [(b, a) for a, b in edges] if a == path[-1] and b not in path}
    return set().union(*(brute(edges, [*path, b], target, most) for b in near)) if len(path) <= most else set()


def test_paths_of_up_to_ten_edges(spark):
    for n in (10, 11, 12):
        edges = [(k, k + 1) for k in range(n - 1)] + [(0, n - 1), (2, 5)]
        catalogue._load()
        fx = SimpleNamespace(routes=spark.createDataFrame(edges, "src long, dst long"), route_ends=spark.createDataFrame([(0, n - 1)], "source long, target long"))
        found = {r["path"] for r in catalogue._QUERIES["paths_cutoff"](fx).collect()}
        assert found == brute(edges, [0], n - 1, 10)
        assert any(x.count("-") > 6 for x in found)
        assert any(x.count("-") == n - 1 for x in found) == (n <= 11)
