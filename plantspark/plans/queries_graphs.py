"""Queries over plant graphs and their exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dims import SYMBOL_TYPES, sql_case
from ..operators import exports, graphs, requests
from .catalogue import register
from .fixtures import Fixtures

_BOTH = "b AS (SELECT src AS a, dst AS b FROM fx_edges UNION ALL SELECT dst, src FROM fx_edges)"
_DEGREE = f"{_BOTH}, dg AS (SELECT n.node_id, count(b.a) AS degree FROM fx_nodes n LEFT JOIN b ON n.node_id = b.a GROUP BY n.node_id)"
# Labels spread in rounds; a node's row is replaced whenever it learns a lesser one.
_COMPONENTS = f"""{_BOTH}, cc(node_id, component) USING KEY (node_id) AS (SELECT node_id, node_id FROM fx_nodes
 UNION SELECT b.a, min(w.component) FROM cc w JOIN b ON b.b = w.node_id JOIN recurring.cc u ON u.node_id = b.a AND w.component < u.component GROUP BY b.a)"""


@register(f"WITH {_DEGREE} SELECT node_id, degree FROM dg")
def degree(fx: Fixtures) -> DataFrame:
    return graphs.degree(fx.nodes, fx.edges)


@register(f"WITH RECURSIVE {_COMPONENTS} SELECT node_id, component FROM cc")
def components(fx: Fixtures) -> DataFrame:
    return graphs.components(fx.nodes, fx.edges)


@register(f"WITH {_DEGREE} SELECT n.node_id FROM fx_nodes n JOIN dg ON n.node_id = dg.node_id WHERE NOT (node_type = 'junction' AND degree = 1)")
def prune_degree1(fx: Fixtures) -> DataFrame:
    return graphs.prune_leaves(fx.nodes, fx.edges).select("node_id")


@register(f"""WITH {_DEGREE}, k AS (SELECT n.* FROM fx_nodes n JOIN dg ON n.node_id = dg.node_id WHERE NOT (node_type = 'junction' AND degree = 1)),
i AS (SELECT e.* FROM fx_edges e WHERE src IN (SELECT node_id FROM k) AND dst IN (SELECT node_id FROM k))
SELECT node_id FROM k WHERE NOT (isa_tag = '' AND confidence < 0.5 AND node_id NOT IN (SELECT src FROM i) AND node_id NOT IN (SELECT dst FROM i))""")
def prune_isolates(fx: Fixtures) -> DataFrame:
    """After the leaves are gone."""
    n = graphs.prune_leaves(fx.nodes, fx.edges)
    return graphs.prune_isolated(n, fx.edges).select("node_id")


@register("""WITH e AS (SELECT e.src, e.dst, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 2) AS length_px
 FROM fx_edges e JOIN fx_nodes a ON e.src = a.node_id JOIN fx_nodes b ON e.dst = b.node_id)
SELECT src, dst, length_px, CASE WHEN length_px < 40 THEN 'signal' WHEN length_px < 100 THEN 'instrument' ELSE 'main_process' END AS line_type FROM e WHERE length_px >= 10""")
def build_graph(fx: Fixtures) -> DataFrame:
    links = graphs.both_ways(fx.edges)
    return graphs.build(fx.nodes, links)


@register(f"""WITH RECURSIVE {_COMPONENTS}
SELECT (SELECT count(*) FROM fx_nodes) AS nodes, (SELECT count(*) FROM fx_edges) AS edges, (SELECT count(DISTINCT component) FROM cc) AS components,
 (SELECT count(*) FROM fx_nodes WHERE label <> '') AS labelled, (SELECT count(*) FROM fx_nodes WHERE isa_tag <> '') AS tagged,
 round((SELECT count(*) FROM fx_edges) * 2 / (SELECT count(*) FROM fx_nodes)::DOUBLE, 2) AS avg_degree,
 round((SELECT count(*) FROM fx_edges) * 2 / ((SELECT count(*) FROM fx_nodes) * ((SELECT count(*) FROM fx_nodes) - 1))::DOUBLE, 6) AS density""")
def graph_summary(fx: Fixtures) -> DataFrame:
    return graphs.summary(fx.nodes, fx.edges)


@register(f"WITH {_BOTH}, z AS (SELECT node_id FROM fx_nodes WHERE node_id % 97 = 0), h1 AS (SELECT node_id FROM z UNION SELECT b.b FROM b JOIN z ON b.a = z.node_id), h2 AS (SELECT node_id FROM h1 UNION SELECT b.b FROM b JOIN h1 ON b.a = h1.node_id) SELECT node_id FROM h2")
def ego_2hop(fx: Fixtures) -> DataFrame:
    return graphs.neighbourhood(fx.edges, F.col("a") % 97 == 0)


@register("WITH RECURSIVE w(node_id) AS (SELECT dst FROM fx_edges WHERE src % 50 = 1 UNION SELECT e.dst FROM w JOIN fx_edges e ON e.src = w.node_id) SELECT node_id FROM w")
def reachability(fx: Fixtures) -> DataFrame:
    return graphs.reachable(fx.edges, F.col("src") % 50 == 1)


@register("""WITH RECURSIVE b AS (SELECT src AS a, dst AS b FROM fx_routes UNION ALL SELECT dst, src FROM fx_routes),
p(path, t) AS (SELECT [b.a, b.b], e.target FROM fx_route_ends e JOIN b ON b.a = e.source
 UNION ALL SELECT list_append(p.path, b.b), p.t FROM p JOIN b ON b.a = p.path[-1] WHERE p.path[-1] <> p.t AND NOT list_contains(p.path, b.b) AND len(p.path) <= 10)
SELECT array_to_string(path, '-') AS path FROM p WHERE path[-1] = t""")
def paths_cutoff(fx: Fixtures) -> DataFrame:
    """Simple paths of up to ten edges from the first to the last line of every order."""
    found = graphs.simple_paths(fx.routes, fx.route_ends)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"))


@register("SELECT e.src, e.dst FROM fx_edges e JOIN fx_nodes a ON e.src = a.node_id JOIN fx_nodes b ON e.dst = b.node_id WHERE a.symbol_class <> 'junction' AND b.symbol_class <> 'junction'")
def induced_subgraph(fx: Fixtures) -> DataFrame:
    return graphs.induced(fx.nodes, fx.edges, F.col("symbol_class") != "junction")


@register("SELECT symbol_class, node_id, CAST((i % 3) * 280 + 50 AS BIGINT) AS px, CAST((i // 3) * 160 + 50 AS BIGINT) AS py FROM (SELECT symbol_class, node_id, row_number() OVER (PARTITION BY symbol_class ORDER BY node_id) - 1 AS i FROM fx_nodes)")
def layout_grid(fx: Fixtures) -> DataFrame:
    return graphs.grid_layout(fx.nodes, "symbol_class")


_LABEL = "CASE WHEN label <> '' THEN label WHEN isa_tag <> '' THEN isa_tag ELSE CAST(node_id AS VARCHAR) END"
_TYPE = sql_case(SYMBOL_TYPES, "symbol_class", "'pipe'")


@register(f"SELECT node_id, {_TYPE} AS type, {_LABEL} AS label FROM fx_nodes")
def graph_to_api(fx: Fixtures) -> DataFrame:
    return exports.api_nodes(fx.nodes)


@register(f"SELECT type, count(*) AS n FROM (SELECT {_TYPE} AS type FROM fx_nodes) GROUP BY type")
def type_breakdown(fx: Fixtures) -> DataFrame:
    return exports.api_nodes(fx.nodes).groupBy("type").agg(F.count("*").alias("n"))


@register(f"""WITH n AS (SELECT node_id % 4 AS part, string_agg('{{"node_id":' || node_id || ',"type":"' || {_TYPE} || '","label":"' || {_LABEL} || '"}}', ',' ORDER BY node_id) AS nodes FROM fx_nodes GROUP BY 1),
e AS (SELECT src % 4 AS part, string_agg('{{"source":' || src || ',"target":' || dst || '}}', ',' ORDER BY src, dst) AS edges FROM fx_edges GROUP BY 1)
SELECT n.part, '{{"nodes":[' || nodes || '],"edges":[' || coalesce(edges, '') || ']}}' AS graph FROM n LEFT JOIN e ON n.part = e.part""")
def sink_node_link(fx: Fixtures) -> DataFrame:
    return exports.graph_json(fx.nodes, fx.edges, F.col("node_id") % 4)


@register("""SELECT node_id, '<node id="' || node_id || '"><data key="class">' || symbol_class || '</data><data key="tag">' || isa_tag || '</data></node>' AS xml FROM fx_nodes""")
def sink_graphml(fx: Fixtures) -> DataFrame:
    return exports.graphml_nodes(fx.nodes)


@register("""SELECT node_id, '{"image_id":' || pid_id || ',"category_id":"' || symbol_class || '","bbox":[' || x1 || ',' || y1 || ',' || (x2 - x1) || ',' || (y2 - y1) || ']}' AS json, round(confidence, 5) AS score FROM fx_boxes""")
def sink_coco_json(fx: Fixtures) -> DataFrame:
    return exports.coco_rows(fx.boxes)


@register("SELECT node_id, printf('%s %.6f %.6f %.6f %.6f', symbol_class, (x1 + x2) / 2.0::DOUBLE / 2000, (y1 + y2) / 2.0::DOUBLE / 2000, (x2 - x1) / 2000.0::DOUBLE, (y2 - y1) / 2000.0::DOUBLE) AS line FROM fx_boxes")
def sink_pred_txt(fx: Fixtures) -> DataFrame:
    return exports.prediction_lines(fx.boxes)


@register("SELECT node_id FROM fx_nodes WHERE contains(lower(symbol_class), 'valve')")
def nodes_by_class(fx: Fixtures) -> DataFrame:
    return fx.nodes.where(F.contains(F.lower("symbol_class"), F.lower(F.lit("Valve")))).select("node_id")


@register("SELECT node_id FROM fx_nodes WHERE upper(isa_tag) = 'V-100' OR upper(label) = 'ITEM 100'")
def nodes_by_tag(fx: Fixtures) -> DataFrame:
    return fx.nodes.where((F.upper("isa_tag") == "V-100") | (F.upper("label") == "ITEM 100")).select("node_id")


@register("SELECT e.src, e.dst, e.src % 3 = 0 AND e.dst % 3 = 0 AS highlighted FROM fx_edges e")
def highlight(fx: Fixtures) -> DataFrame:
    return requests.highlighted(fx.nodes, fx.edges, F.col("node_id") % 3 == 0)


@register("SELECT node_id, 'Node ' || node_id || ': type=' || node_type || ', label=' || label || ', class=' || symbol_class || ', tag=' || isa_tag AS chunk FROM fx_nodes UNION ALL SELECT NULL, 'Edge: ' || src || ' -> ' || dst FROM fx_edges")
def graph_chunks(fx: Fixtures) -> DataFrame:
    n = requests.node_chunk(F.col("node_id").cast("string"), F.col("node_type"), F.col("label"), F.create_map(F.lit("class"), F.col("symbol_class"), F.lit("tag"), F.col("isa_tag")))
    e = requests.edge_chunk(F.col("src").cast("string"), F.col("dst").cast("string"))
    return fx.nodes.select("node_id", n.alias("chunk")).unionByName(fx.edges.select(F.lit(None).cast("long").alias("node_id"), e.alias("chunk")))


@register("SELECT node_id FROM fx_nodes WHERE (y >= 600 AND x >= 900) OR (y <= 120 AND x >= 600 AND x <= 1200)")
def roi_rectangles(fx: Fixtures) -> DataFrame:
    return fx.nodes.where(requests.in_margins(F.col("x"), F.col("y"), 1800, 1000)).select("node_id")


@register("""WITH s AS (SELECT p_partkey, 4 * pi() * (p_size * 37) / ((p_size + 20.0::DOUBLE) * (p_size + 20)) AS c, p_size * 37 / (p_size * 30.0::DOUBLE + p_partkey) AS solid, (10 + p_partkey % 40) / (10.0::DOUBLE + p_size) AS aspect FROM part)
SELECT p_partkey, CASE WHEN c > 0.7 AND aspect > 0.7 AND aspect < 1.4 THEN 'pressure_indicator' WHEN c > 0.55 THEN 'flow_indicator' WHEN solid < 0.5 THEN 'gate_valve' WHEN aspect > 1.5 AND aspect < 4 THEN 'centrifugal_pump' ELSE 'unknown' END AS symbol_class FROM s""")
def classify_cc(fx: Fixtures) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    made = requests.component_class(size * 37, size + F.lit(20.0), size * 30.0 + key, 10 + key % 40, 10.0 + size)
    return fx.part.select("p_partkey", made["symbol_class"].alias("symbol_class"))

