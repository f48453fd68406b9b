"""Tables of drawings and procedures that are derived from the generated star-schema tables.

Each statement is plain SQL that Spark and DuckDB read alike; Spark gets the tables it names
as DataFrames, DuckDB the statements as common table expressions. Keys are numbered per order,
so no statement needs an order over a whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name: (tables and views that it reads, statement).
STATEMENTS: dict[str, tuple[tuple[str, ...], str]] = {
    "base": (
        ("lineitem",),
        """SELECT *, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_tax, l_discount) AS rn FROM {lineitem}""",
    ),
    "boxes": (
        ("base",),
        """SELECT l_orderkey - l_orderkey % 40 AS pid_id, rn AS node_id,
 CASE l_partkey % 6 WHEN 0 THEN 'gate_valve' WHEN 1 THEN 'control_valve' WHEN 2 THEN 'centrifugal_pump' WHEN 3 THEN 'vessel' WHEN 4 THEN 'pressure_transmitter' ELSE 'flow_indicator' END AS symbol_class,
 (l_partkey % 9) * 200 + rn % 37 AS x1, (l_suppkey % 5) * 200 + rn % 23 AS y1,
 (l_partkey % 9) * 200 + rn % 37 + 60 + rn % 17 AS x2, (l_suppkey % 5) * 200 + rn % 23 + 60 + rn % 13 AS y2,
 CAST((rn * 7919) % 1000003 AS DOUBLE) / CAST(1000003 AS DOUBLE) AS confidence,
 CASE l_suppkey % 3 WHEN 0 THEN 'yolov5' WHEN 1 THEN 'classical' ELSE 'ocr_injected' END AS source FROM {base}""",
    ),
    "texts": (
        ("orders",),
        """SELECT o_orderkey - o_orderkey % 40 AS pid_id, o_orderkey AS region_id,
 concat(CASE o_custkey % 8 WHEN 0 THEN 'FCV' WHEN 1 THEN 'PT' WHEN 2 THEN 'P' WHEN 3 THEN 'V' WHEN 4 THEN 'PSV' WHEN 5 THEN 'XV' WHEN 6 THEN 'E' ELSE 'NOTE' END,
  CASE WHEN o_orderkey % 3 = 0 THEN '_' WHEN o_orderkey % 3 = 1 THEN '-' ELSE '' END,
  CASE WHEN o_custkey % 8 = 7 THEN 'X' ELSE CAST(100 + o_custkey % 300 AS VARCHAR(10)) END) AS text,
 CAST(400 + (o_orderkey * 7) % 600 AS DOUBLE) / CAST(1000 AS DOUBLE) AS confidence,
 (o_custkey % 10) * 200 + o_orderkey % 90 AS cx, ((o_orderkey * 3) % 7) * 200 + o_orderkey % 70 AS cy FROM {orders}""",
    ),
    "segments": (
        ("base",),
        """SELECT l_orderkey - l_orderkey % 40 AS pid_id, rn AS seg_id,
 (l_partkey % 9) * 200 + 70 + rn % 11 AS x1, (l_suppkey % 5) * 200 + 30 + rn % 9 AS y1,
 (l_partkey % 9) * 200 + CASE WHEN rn % 2 = 0 THEN 190 + rn % 11 ELSE 70 + rn % 19 END AS x2,
 (l_suppkey % 5) * 200 + CASE WHEN rn % 2 = 0 THEN 30 + rn % 14 ELSE 180 + rn % 9 END AS y2 FROM {base}""",
    ),
    "edges": (
        ("lineitem",),
        """SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM
 (SELECT l_partkey AS a, (l_partkey * 7 + l_suppkey) % 2000 AS b FROM {lineitem}) t WHERE a <> b""",
    ),
    "nodes": (
        ("edges",),
        """SELECT node_id, CASE WHEN node_id % 3 = 0 THEN 'junction' ELSE 'symbol' END AS node_type,
 CASE WHEN node_id % 3 = 0 THEN 'junction' WHEN node_id % 3 = 1 THEN 'gate_valve' WHEN node_id % 2 = 0 THEN 'vessel' ELSE 'flow_indicator' END AS symbol_class,
 CASE WHEN node_id % 5 = 0 THEN concat('V-', CAST(node_id AS VARCHAR(12))) ELSE '' END AS isa_tag,
 CASE WHEN node_id % 4 = 0 THEN concat('item ', CAST(node_id AS VARCHAR(12))) ELSE '' END AS label,
 CAST(node_id % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
 (node_id * 13) % 1800 AS x, (node_id * 29) % 1000 AS y
 FROM (SELECT src AS node_id FROM {edges} UNION SELECT dst AS node_id FROM {edges}) t""",
    ),
    # A small graph for each order, for queries that list paths: a line is linked to the next two.
    "routes": (("base",), "SELECT a.rn AS src, b.rn AS dst FROM {base} a JOIN {base} b ON a.l_orderkey = b.l_orderkey AND b.rn - a.rn BETWEEN 1 AND 2"),
    "route_ends": (("base",), "SELECT min(rn) AS source, max(rn) AS target FROM {base} GROUP BY l_orderkey HAVING count(*) > 1"),
    "docs": (
        ("customer",),
        """SELECT c_custkey AS pid_id, concat(c_name, '.pdf') AS file_name,
 CASE WHEN c_custkey % 11 = 0 THEN 'failed' WHEN c_custkey % 7 = 0 THEN 'pending' ELSE 'completed' END AS status,
 c_nationkey AS upload_batch_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 9 + 1 AS INT) END AS page_num FROM {customer}""",
    ),
    "runs": (
        ("orders",),
        """SELECT o_orderkey AS run_id, o_custkey AS pid_id, o_custkey % 40 AS sop_id,
 CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'completed' ELSE 'failed' END AS status,
 CAST(o_orderkey % 6 AS INT) AS n_issues, CASE o_orderkey % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'info' ELSE NULL END AS severity,
 o_orderdate AS created_at FROM {orders}""",
    ),
    "sop_lines": (
        ("orders",),
        """SELECT o_custkey % 40 AS sop_id, o_orderkey AS line_no,
 CASE WHEN o_orderkey % 9 = 0 THEN concat('SECTION ', CAST(o_orderkey AS VARCHAR(12)))
  WHEN o_orderkey % 4 = 1 THEN concat('Open: FCV-', CAST(100 + o_custkey % 300 AS VARCHAR(10)), ' hold 5 bar')
  WHEN o_orderkey % 4 = 2 THEN concat('close XV_', CAST(100 + o_custkey % 300 AS VARCHAR(10)), ' below 80 deg C')
  WHEN o_orderkey % 4 = 3 THEN concat('open valve PSV', CAST(100 + o_custkey % 300 AS VARCHAR(10)), ' flow 12.5 gpm')
  ELSE 'Verify readings and log' END AS text FROM {orders}""",
    ),
    "plant": (
        ("customer",),
        """SELECT c_custkey % 40 AS sop_id, concat('n', CAST(c_custkey AS VARCHAR(12))) AS node_id, c_custkey AS ord,
 CASE c_custkey % 4 WHEN 0 THEN concat('FCV-', CAST(100 + c_custkey % 300 AS VARCHAR(10))) WHEN 1 THEN concat('XV-', CAST(100 + c_custkey % 300 AS VARCHAR(10)))
  WHEN 2 THEN '' ELSE concat('PSV-', CAST(200 + c_custkey % 300 AS VARCHAR(10))) END AS isa_tag,
 CASE WHEN c_custkey % 4 = 2 THEN concat('PSV-', CAST(100 + c_custkey % 300 AS VARCHAR(10))) ELSE '' END AS label,
 CASE c_nationkey % 5 WHEN 0 THEN 'control_valve' WHEN 1 THEN 'gate_valve' WHEN 2 THEN 'relief_valve' WHEN 3 THEN 'unknown' ELSE 'vessel' END AS symbol_class,
 CASE c_nationkey % 3 WHEN 0 THEN 'closed' WHEN 1 THEN 'OPEN' ELSE '' END AS state FROM {customer}""",
    ),
    "truth": (
        ("boxes",),
        """SELECT pid_id, node_id AS gt_id, symbol_class, x1 + node_id % 5 AS x1, y1 + node_id % 4 AS y1, x2 + node_id % 5 AS x2, y2 + node_id % 4 AS y2
 FROM {boxes} WHERE node_id % 3 <> 0""",
    ),
}
TABLES = ("lineitem", "orders", "customer", "supplier", "part", "nation", "region", "events", "embeddings", "documents", "conversations", "pages")


class Fixtures:
    """Tables and derived views of one folder as lazy DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in STATEMENTS:
                needs, sql = STATEMENTS[name]
                self._made[name] = self.spark.sql(sql, **{x: getattr(self, x) for x in needs})
            elif name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._made[name]


def common_tables(names: list[str]) -> list[str]:
    """The common table expressions that the named views need, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in STATEMENTS and name not in order:
            for x in STATEMENTS[name][0]:
                add(x)
            order.append(name)

    for name in names:
        add(name)
    return [f"fx_{n} AS ({STATEMENTS[n][1].format(**{x: f'fx_{x}' if x in STATEMENTS else x for x in STATEMENTS[n][0]})})" for n in order]
