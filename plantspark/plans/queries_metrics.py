"""Queries over detection quality and datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as m
from .catalogue import register
from .fixtures import Fixtures
from .queries_boxes import _inter, _union

_CAND = f"cd AS (SELECT a.pid_id, a.node_id, b.gt_id, a.symbol_class AS pred_class, b.symbol_class AS gt_class, {_inter('a', 'b')} AS inter, {_union('a', 'b')} AS uni FROM fx_boxes a JOIN fx_truth b ON a.pid_id = b.pid_id WHERE {_inter('a', 'b')} > 0)"
_MATCH = f"""{_CAND}, th AS (SELECT unnest(range(50, 100, 5))::INT AS percent),
k1 AS (SELECT *, round(inter / uni::DOUBLE, 9) AS iou FROM cd, th WHERE pred_class = gt_class AND inter * 100 >= uni * percent),
k2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY percent, pid_id, node_id ORDER BY iou DESC, gt_id) AS n FROM k1) WHERE n = 1),
mt AS (SELECT percent, pid_id, node_id, gt_id FROM (SELECT percent, pid_id, node_id, gt_id, row_number() OVER (PARTITION BY percent, pid_id, gt_id ORDER BY node_id) AS n FROM k2) WHERE n = 1)"""
_CONF = f"""{_CAND}, k1 AS (SELECT *, round(inter / uni::DOUBLE, 9) AS iou FROM cd WHERE inter * 100 > uni * 45),
k2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid_id, node_id ORDER BY iou DESC, gt_id) AS n FROM k1) WHERE n = 1),
mc AS (SELECT pid_id, node_id, gt_id, pred_class, gt_class FROM (SELECT * EXCLUDE n, row_number() OVER (PARTITION BY pid_id, gt_id ORDER BY iou DESC, node_id) AS n FROM k2) WHERE n = 1),
cf AS (SELECT pred_class, gt_class, count(*) AS n FROM (SELECT pred_class, gt_class FROM mc
  UNION ALL SELECT 'background', symbol_class FROM fx_truth WHERE gt_id NOT IN (SELECT gt_id FROM mc)
  UNION ALL SELECT symbol_class, 'background' FROM fx_boxes WHERE node_id NOT IN (SELECT node_id FROM mc) AND pid_id IN (SELECT pid_id FROM mc)) GROUP BY 1, 2)"""


@register(f"WITH {_MATCH} SELECT percent, pid_id, node_id, gt_id FROM mt")
def match_tp(fx: Fixtures) -> DataFrame:
    return m.match(fx.boxes, fx.truth)


@register(f"WITH {_CONF} SELECT pid_id, node_id, gt_id, pred_class, gt_class FROM mc")
def match_confusion(fx: Fixtures) -> DataFrame:
    return m.match_confusion(fx.boxes, fx.truth)


@register(f"WITH {_CONF} SELECT pred_class, gt_class, n FROM cf")
def confusion_counts(fx: Fixtures) -> DataFrame:
    return m.confusion(fx.boxes, fx.truth)


@register(f"WITH {_CONF} SELECT pred_class, gt_class, round(n / sum(n) OVER (PARTITION BY gt_class), 6) AS share FROM cf")
def confusion_normalised(fx: Fixtures) -> DataFrame:
    return m.normalised(m.confusion(fx.boxes, fx.truth))


@register(f"WITH {_CONF} SELECT pred_class AS symbol_class, sum(CASE WHEN pred_class = gt_class THEN n ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN pred_class = gt_class THEN 0 ELSE n END)::BIGINT AS fp FROM cf WHERE pred_class <> 'background' GROUP BY 1")
def tp_fp(fx: Fixtures) -> DataFrame:
    return m.true_false(m.confusion(fx.boxes, fx.truth))


_RANKED = f"""{_MATCH}, hit AS (SELECT node_id FROM mt WHERE percent = 50), nl AS (SELECT symbol_class, count(*) AS n_labels FROM fx_truth GROUP BY 1),
rk AS (SELECT b.symbol_class, b.node_id, sum(CASE WHEN h.node_id IS NULL THEN 0 ELSE 1 END) OVER w AS tp, sum(CASE WHEN h.node_id IS NULL THEN 1 ELSE 0 END) OVER w AS fp, n_labels
  FROM fx_boxes b LEFT JOIN hit h ON b.node_id = h.node_id JOIN nl ON b.symbol_class = nl.symbol_class WINDOW w AS (PARTITION BY b.symbol_class ORDER BY confidence DESC, b.node_id ROWS UNBOUNDED PRECEDING))"""


@register(f"WITH {_RANKED} SELECT symbol_class, node_id, tp::BIGINT AS tp, fp::BIGINT AS fp, n_labels FROM rk")
def cum_tp_fp(fx: Fixtures) -> DataFrame:
    return m.ranked(fx.boxes, fx.truth).drop("confidence")


@register(f"""WITH {_RANKED},
r0 AS (SELECT symbol_class, (tp + fp)::BIGINT AS rank, tp / (n_labels + 1e-16::DOUBLE) AS recall, tp / (tp + fp)::DOUBLE AS precision FROM rk
  UNION ALL SELECT symbol_class, 0, 0.0, 1.0 FROM nl UNION ALL SELECT symbol_class, 4611686018427387904, 1.0, 0.0 FROM nl),
r1 AS (SELECT *, max(precision) OVER (PARTITION BY symbol_class ORDER BY rank DESC ROWS UNBOUNDED PRECEDING) AS env FROM r0),
xs AS (SELECT unnest(range(0, 101))::BIGINT AS k),
lo AS (SELECT symbol_class, k, arg_max(recall, rank) AS ra, arg_max(env, rank) AS ea, max(rank) AS rank FROM r1, xs WHERE rank < 4611686018427387904 AND ceil(recall * 100) <= k GROUP BY 1, 2),
nx AS (SELECT symbol_class, rank, lead(recall) OVER (PARTITION BY symbol_class ORDER BY rank) AS rb, lead(env) OVER (PARTITION BY symbol_class ORDER BY rank) AS eb FROM r1),
yv AS (SELECT lo.symbol_class, k, CASE WHEN k = 100 THEN 0 WHEN rb > ra THEN ea + (eb - ea) * (k / 100.0::DOUBLE - ra) / (rb - ra) ELSE ea END AS y FROM lo JOIN nx ON lo.symbol_class = nx.symbol_class AND lo.rank = nx.rank)
SELECT symbol_class, round(sum(y * CASE WHEN k IN (0, 100) THEN 0.5 ELSE 1 END) / 100, 6) AS ap FROM yv GROUP BY 1""")
def ap_101(fx: Fixtures) -> DataFrame:
    return m.average_precision(m.ranked(fx.boxes, fx.truth))


_WEIGHTS = "w0 AS (SELECT symbol_class, 1 / count(*)::DOUBLE AS inv FROM fx_boxes GROUP BY 1), cw AS (SELECT symbol_class, round(inv / (SELECT sum(inv) FROM w0), 6) AS weight FROM w0)"


@register(f"WITH {_WEIGHTS} SELECT symbol_class, weight FROM cw")
def class_weights(fx: Fixtures) -> DataFrame:
    return m.class_weights(fx.boxes)


@register(f"WITH {_WEIGHTS} SELECT pid_id, round(sum(weight), 6) AS weight FROM fx_boxes b JOIN cw ON b.symbol_class = cw.symbol_class GROUP BY 1")
def image_weights(fx: Fixtures) -> DataFrame:
    return m.image_weights(fx.boxes)


@register("SELECT symbol_class, count(*) AS instances, count(DISTINCT pid_id) AS drawings FROM fx_boxes GROUP BY ROLLUP(symbol_class)")
def dataset_stats(fx: Fixtures) -> DataFrame:
    return m.dataset_stats(fx.boxes)


@register("SELECT node_id, reason FROM (SELECT node_id, CASE WHEN greatest((x1 + x2) / 2.0 / 1700, (y1 + y2) / 2.0 / 1700, (x2 - x1) / 1700.0, (y2 - y1) / 1700.0) > 1 THEN 'beyond the image' WHEN x2 - x1 < 62 THEN 'narrow' END AS reason FROM fx_boxes) WHERE reason IS NOT NULL")
def label_legal(fx: Fixtures) -> DataFrame:
    return m.legal_labels(fx.boxes, 1700)


@register("SELECT least((x2 - x1) * 20 // 100, 19) AS bx, least((y2 - y1) * 20 // 100, 19) AS by, count(*) AS n FROM fx_boxes GROUP BY 1, 2")
def hist2d(fx: Fixtures) -> DataFrame:
    return m.histogram(fx.boxes)


_ANCHORS = ((30, 61), (62, 45), (59, 119), (116, 90), (156, 198), (10, 13))
_FIT = ", ".join(f"least(least((x2 - x1) / {w}.0::DOUBLE, {w}.0::DOUBLE / (x2 - x1)), least((y2 - y1) / {h}.0::DOUBLE, {h}.0::DOUBLE / (y2 - y1)))" for w, h in _ANCHORS)


@register(f"SELECT round(avg(CASE WHEN list_max(f) > 0.25 THEN 1.0::DOUBLE ELSE 0 END), 6) AS bpr, round(avg(len(list_filter(f, lambda x: x > 0.25))), 6) AS aat FROM (SELECT [{_FIT}] AS f FROM fx_boxes)")
def anchor_metric(fx: Fixtures) -> DataFrame:
    return m.anchor_fit(fx.boxes, _ANCHORS)


@register("SELECT run, epoch, best, (epoch - best_epoch)::BIGINT AS since, epoch - best_epoch >= 10 AS stop FROM (SELECT run, epoch, best, max(CASE WHEN value >= best THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS best_epoch FROM (SELECT p_partkey % 20 AS run, p_partkey AS epoch, p_size AS value, max(p_size) OVER (PARTITION BY p_partkey % 20 ORDER BY p_partkey) AS best FROM part))")
def early_stop(fx: Fixtures) -> DataFrame:
    return m.running_best(fx.part.selectExpr("p_partkey % 20 AS run", "p_partkey AS epoch", "p_size AS value"))
