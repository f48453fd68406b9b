"""Queries over recognised texts, procedures and the rule engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tags as t
from ..functions.dims import COMPATIBLE, FIRST_LETTER, PREFIX_CLASS, SECOND_LETTER, sql_case
from ..operators import procedures as p
from ..operators import requests, xref
from .catalogue import register
from .fixtures import Fixtures
from .queries_boxes import _TAG, TAGGED, tagged_texts

_ISA = r"'\b([A-Z]{1,4})[_\-]?(\d{2,5}[A-Z]?)\b'"


@register(f"SELECT region_id, regexp_extract(upper(trim(text)), {_TAG}, 1) AS prefix, regexp_extract(upper(trim(text)), {_TAG}, 2) AS number, tag FROM {TAGGED}")
def parse_isa_tag(fx: Fixtures) -> DataFrame:
    parts = t.drawing_tag(F.col("text"))
    return tagged_texts(fx).select("region_id", parts["prefix"].alias("prefix"), parts["number"].alias("number"), "tag")


@register(f"SELECT pid_id, tag, arg_max(region_id, (confidence, -region_id)) AS region_id FROM {TAGGED} GROUP BY pid_id, tag")
def tag_best(fx: Fixtures) -> DataFrame:
    return tagged_texts(fx).groupBy("pid_id", "tag").agg(F.max_by("region_id", F.struct("confidence", -F.col("region_id"))).alias("region_id"))


_FIRST, _SECOND = sql_case(FIRST_LETTER, "substr(text, 1, 1)"), sql_case(SECOND_LETTER, "substr(text, 2, 1)")


@register(f"SELECT region_id, coalesce({_FIRST} || '_' || {_SECOND}, {_FIRST}, 'unknown') AS hint FROM fx_texts")
def tag_component_hint(fx: Fixtures) -> DataFrame:
    return fx.texts.select("region_id", t.component_hint(F.col("text")).alias("hint"))


_P = f"regexp_extract(upper(trim(text)), {_TAG}, 1)"
_KIND = f"coalesce({sql_case(FIRST_LETTER, f'substr({_P}, 1, 1)')}, 'flow')"


@register(f"SELECT region_id, coalesce({sql_case(PREFIX_CLASS, _P)}, CASE WHEN suffix({_P}, 'T') THEN {_KIND} || '_transmitter' WHEN suffix({_P}, 'I') THEN {_KIND} || '_indicator' WHEN suffix({_P}, 'C') THEN {_KIND} || '_controller' ELSE 'instrument' END) AS symbol_class FROM {TAGGED}")
def prefix_to_class(fx: Fixtures) -> DataFrame:
    return tagged_texts(fx).select("region_id", t.prefix_class(t.drawing_tag(F.col("text"))["prefix"]).alias("symbol_class"))


@register("SELECT region_id, upper(trim(regexp_replace(concat(text, ' ;x/', CAST(region_id AS VARCHAR)), '[^A-Za-z0-9\\-_ ]', '', 'g'))) AS text FROM fx_texts")
def normalise_ocr_text(fx: Fixtures) -> DataFrame:
    return fx.texts.select("region_id", t.normal_ocr(F.concat("text", F.lit(" ;x/"), F.col("region_id").cast("string"))).alias("text"))


_COMPAT = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v)}]" for k, v in COMPATIBLE.items())
_LISTS = "coalesce(" + ", ".join(f"CASE substr(prefix, 1, {n}) {_COMPAT} END" for n in (4, 3, 2, 1)) + ")"


@register(f"SELECT node_id, coalesce(list_contains({_LISTS}, symbol_class), true) AS ok, coalesce(array_to_string(list_sort(CASE prefix {_COMPAT} END), ' | '), 'unknown') AS expected FROM (SELECT node_id, symbol_class, split_part(isa_tag, '-', 1) AS prefix FROM fx_plant WHERE isa_tag <> '')")
def classes_compatible(fx: Fixtures) -> DataFrame:
    prefix = F.substring_index("isa_tag", "-", 1)
    return fx.plant.where("isa_tag <> ''").select("node_id", t.compatible(prefix, F.col("symbol_class")).alias("ok"), t.expected_classes(prefix).alias("expected"))


#: Sections and what is read from them.
_STEPS = r"""
a AS (SELECT sop_id, line_no, trim(text) AS text FROM fx_sop_lines WHERE length(trim(text)) > 0),
b AS (SELECT *, upper(text) = text AND lower(text) <> text AS head FROM a),
c AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY sop_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM b),
d AS (SELECT sop_id, section, coalesce(max(CASE WHEN head THEN text END), '') AS heading, string_agg(text, ' ' ORDER BY line_no) FILTER (NOT head) AS text FROM c GROUP BY sop_id, section),
st AS (SELECT sop_id, row_number() OVER (PARTITION BY sop_id ORDER BY section) - 1 AS step_no, heading, text FROM d WHERE text IS NOT NULL),
tg0 AS (SELECT sop_id, step_no, regexp_extract_all(upper(concat_ws(' ', heading, text)), '\b[A-Z]{1,4}[_\-]?\d{2,5}[A-Z]?\b') AS l FROM st),
tg1 AS (SELECT sop_id, step_no, unnest(l) AS raw, unnest(range(len(l))) AS k FROM tg0),
tg2 AS (SELECT sop_id, step_no, regexp_replace(raw, '^([A-Z]{1,4})[_\-]?(\d{2,5}[A-Z]?)$', '\1-\2') AS tag, min(k) AS k FROM tg1 GROUP BY ALL),
tg AS (SELECT sop_id, step_no, tag, row_number() OVER (PARTITION BY sop_id, step_no ORDER BY k) - 1 AS pos FROM tg2),
vl0 AS (SELECT sop_id, step_no, 'open' AS state, regexp_extract_all(text, '(?i)\b(?:open|opened?|opening)\b[^A-Z]{0,15}([A-Z]{1,4}[_\-]?\d{2,5}[A-Z]?)', 1) AS l, 0 AS phase FROM st
  UNION ALL SELECT sop_id, step_no, 'closed', regexp_extract_all(text, '(?i)\b(?:close|closed?|closing|shut|shutoff)\b[^A-Z]{0,15}([A-Z]{1,4}[_\-]?\d{2,5}[A-Z]?)', 1), 1 FROM st),
vl1 AS (SELECT sop_id, step_no, state, phase, unnest(l) AS raw, unnest(range(len(l))) AS k FROM vl0),
vl AS (SELECT sop_id, step_no, regexp_replace(upper(raw), '^([A-Z]{1,4})[_\-]?(\d{2,5}[A-Z]?)$', '\1-\2') AS tag, arg_max(state, (phase, k)) AS state, min((phase, k)) AS pos FROM vl1 GROUP BY ALL)
"""


@register("WITH " + _STEPS + "SELECT sop_id, step_no, heading, text FROM st")
def sop_sections(fx: Fixtures) -> DataFrame:
    return p.sections(fx.sop_lines)


@register("WITH " + _STEPS + "SELECT sop_id, step_no, string_agg(tag, ',' ORDER BY pos) AS tags FROM tg GROUP BY sop_id, step_no")
def tags_extract(fx: Fixtures) -> DataFrame:
    return p.steps(fx.sop_lines).where(F.size("required_tags") > 0).select("sop_id", "step_no", F.array_join("required_tags", ",").alias("tags"))


@register("WITH " + _STEPS + "SELECT sop_id, step_no, tag, state FROM vl")
def sop_valves(fx: Fixtures) -> DataFrame:
    return p.step_valves(p.steps(fx.sop_lines)).drop("pos")


@register("WITH " + _STEPS + "SELECT sop_id, tag, arg_max(state, step_no) AS state FROM vl GROUP BY sop_id, tag")
def valve_map_merge(fx: Fixtures) -> DataFrame:
    return p.final_valves(p.steps(fx.sop_lines))


@register("WITH " + _STEPS + "SELECT sop_id, tag, min(step_no) AS first_step FROM tg GROUP BY sop_id, tag")
def ordered_distinct_tags(fx: Fixtures) -> DataFrame:
    return p.all_tags(p.steps(fx.sop_lines))


def _last(pattern: str) -> str:
    one = lambda k: f"regexp_extract_all(text, '{pattern}', {k})[-1]"
    return f"{one(1)} || ' ' || lower({one(2)})"


@register("WITH " + _STEPS + f"SELECT sop_id, step_no, {', '.join(f'{_last(x)} AS {k}' for k, x in t.PARAMETERS.items())} FROM st")
def sop_parameters(fx: Fixtures) -> DataFrame:
    return p.steps(fx.sop_lines).select("sop_id", "step_no", *t.PARAMETERS)


_NAMES = """
nm0 AS (SELECT sop_id, upper(isa_tag) AS name, 1 AS is_tag, ord, node_id, symbol_class, state FROM fx_plant WHERE isa_tag <> ''
  UNION ALL SELECT sop_id, upper(label), 0, ord, node_id, symbol_class, state FROM fx_plant WHERE label <> ''),
nm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sop_id, name ORDER BY is_tag DESC, ord DESC) AS n FROM nm0) WHERE n = 1)
"""
_MISS = "SELECT tg.sop_id, tg.step_no, tg.tag AS sop_tag FROM tg LEFT JOIN nm ON tg.sop_id = nm.sop_id AND tg.tag = nm.name WHERE nm.name IS NULL"
_TYPE = f"""SELECT * FROM (SELECT tg.sop_id, tg.step_no, tg.tag AS sop_tag, nm.node_id AS graph_tag, nm.symbol_class, split_part(tg.tag, '-', 1) AS prefix
  FROM tg JOIN nm ON tg.sop_id = nm.sop_id AND tg.tag = nm.name WHERE nm.symbol_class <> 'unknown') WHERE NOT coalesce(list_contains({_LISTS}, symbol_class), true)"""
_VALVE = "SELECT vl.sop_id, vl.step_no, vl.tag AS sop_tag, nm.node_id AS graph_tag FROM vl JOIN nm ON vl.sop_id = nm.sop_id AND vl.tag = nm.name WHERE length(nm.state) > 0 AND lower(nm.state) <> lower(vl.state)"
_EXTRA = """SELECT sop_id, CASE WHEN isa_tag <> '' THEN upper(isa_tag) ELSE upper(label) END AS graph_tag, node_id FROM fx_plant g WHERE (isa_tag <> '' OR label <> '')
  AND NOT EXISTS (SELECT 1 FROM tg WHERE tg.sop_id = g.sop_id AND (tg.tag = upper(g.isa_tag) OR tg.tag = upper(g.label)))"""
_WITH = "WITH " + _STEPS + "," + _NAMES


def _steps(fx: Fixtures) -> DataFrame:
    return p.steps(fx.sop_lines)


@register(_WITH + _MISS)
def xref_missing(fx: Fixtures) -> DataFrame:
    return xref.unmatched(_steps(fx), fx.plant, fuzzy=False).select("sop_id", "step_no", "sop_tag")


@register(_WITH + f"SELECT sop_id, step_no, sop_tag, graph_tag FROM ({_TYPE})")
def xref_type_mismatch(fx: Fixtures) -> DataFrame:
    return xref.type_mismatches(_steps(fx), fx.plant).select("sop_id", "step_no", "sop_tag", "graph_tag")


@register(_WITH + _VALVE)
def xref_valve_state(fx: Fixtures) -> DataFrame:
    return xref.valve_conflicts(_steps(fx), fx.plant).select("sop_id", "step_no", "sop_tag", "graph_tag")


@register(_WITH + f"SELECT sop_id, graph_tag FROM ({_EXTRA})")
def xref_extra(fx: Fixtures) -> DataFrame:
    return xref.extra_components(_steps(fx), fx.plant, fuzzy=False).select("sop_id", "graph_tag")


@register(_WITH + f""", k AS (SELECT tg.sop_id, tg.tag, nm.name IS NOT NULL AS ok FROM tg LEFT JOIN nm ON tg.sop_id = nm.sop_id AND tg.tag = nm.name),
s AS (SELECT sop_id, count(DISTINCT tag) AS total_tags, count(DISTINCT CASE WHEN ok THEN tag END) AS matched_tags, count(*) FILTER (NOT ok) AS missing_tags FROM k GROUP BY sop_id),
x AS (SELECT sop_id, 'c' AS v FROM ({_MISS}) UNION ALL SELECT sop_id, 'c' FROM ({_TYPE}) UNION ALL SELECT sop_id, 'w' FROM ({_VALVE}) UNION ALL SELECT sop_id, 'i' FROM ({_EXTRA}))
SELECT s.*, round(matched_tags * 100 / greatest(total_tags, 1)::DOUBLE, 1) AS coverage_pct, (SELECT count(*) FROM x WHERE x.sop_id = s.sop_id AND v = 'c') AS n_critical,
 (SELECT count(*) FROM x WHERE x.sop_id = s.sop_id AND v = 'w') AS n_warning, (SELECT count(*) FROM x WHERE x.sop_id = s.sop_id AND v = 'i') AS n_info FROM s""")
def xref_summary(fx: Fixtures) -> DataFrame:
    return xref.summary(_steps(fx), fx.plant, fuzzy=False)


@register()
def xref_discrepancies(fx: Fixtures) -> DataFrame:
    """All rules with the similarity of names, which SQL can't express."""
    return xref.discrepancies(_steps(fx), fx.plant)


@register()
def xref_fuzzy_summary(fx: Fixtures) -> DataFrame:
    return xref.summary(_steps(fx), fx.plant)


@register(_WITH + f", x AS (SELECT sop_id, 1 AS c FROM ({_MISS}) UNION ALL SELECT sop_id, 1 FROM ({_TYPE}) UNION ALL SELECT sop_id, 0 FROM ({_VALVE}) UNION ALL SELECT sop_id, 0 FROM ({_EXTRA})) SELECT sop_id, max(c) AS exit_code FROM x GROUP BY sop_id")
def xref_exit_code(fx: Fixtures) -> DataFrame:
    return xref.has_critical(xref.discrepancies(_steps(fx), fx.plant, fuzzy=False))


@register("SELECT pid_id, string_agg(text, ' ' ORDER BY region_id) AS text_metadata FROM fx_texts GROUP BY pid_id")
def text_metadata(fx: Fixtures) -> DataFrame:
    return fx.texts.groupBy("pid_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("region_id", "text"))), lambda x: x["text"]), " ").alias("text_metadata"))


@register("""WITH a AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'missing_component' WHEN 1 THEN 'type_mismatch' WHEN 2 THEN 'attribute_mismatch' ELSE NULL END AS t FROM events)
SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 = 3 THEN 0 ELSE 1 END::BIGINT AS n, CASE WHEN t = 'type_mismatch' THEN 'attribute_mismatch' ELSE t END AS type FROM a""")
def parse_llm_json(fx: Fixtures) -> DataFrame:
    """Answers as a list, in a fence, under a name, empty, and broken."""
    raw = F.expr(
        "CASE event_id % 5 WHEN 0 THEN '[{\"type\":\"missing_component\",\"relatedNodes\":[\"n1\"]}]' WHEN 1 THEN 'Sure: ```json\n{\"issues\": [{\"type\": \"type_mismatch\"}]}\n```' "
        "WHEN 2 THEN '{\"result\":[{\"type\":\"anything\"}]}' WHEN 3 THEN '[]' ELSE 'no' END"
    )
    found = requests.parsed_answers(fx.events.select("event_id", raw.alias("raw")), "raw")
    return found.select("event_id", F.when(F.col("issues").isNotNull(), F.size("issues")).cast("long").alias("n"), F.get("issues", F.lit(0))["type"].alias("type"))


@register("WITH " + _STEPS + "SELECT s.sop_id, s.step_no, concat_ws(' ', (SELECT string_agg(tag, ' ' ORDER BY pos) FROM tg WHERE tg.sop_id = s.sop_id AND tg.step_no = s.step_no), substr(s.text, 1, 3000)) AS search_text FROM st s WHERE EXISTS (SELECT 1 FROM tg WHERE tg.sop_id = s.sop_id AND tg.step_no = s.step_no)")
def search_query(fx: Fixtures) -> DataFrame:
    return p.steps(fx.sop_lines).where(F.size("required_tags") > 0).select("sop_id", "step_no", requests.search_text(F.col("required_tags"), F.col("text")).alias("search_text"))


@register(_WITH + f"""SELECT sop_id, type, component, severity FROM (SELECT sop_id, 'missing_component' AS type, sop_tag AS component, 'error' AS severity FROM ({_MISS}) UNION ALL SELECT sop_id, 'attribute_mismatch', sop_tag, 'error' FROM ({_TYPE})
 UNION ALL SELECT sop_id, 'attribute_mismatch', sop_tag, 'warning' FROM ({_VALVE}) UNION ALL SELECT sop_id, 'unexpected_component', graph_tag, 'info' FROM ({_EXTRA}))""")
def llm_validate(fx: Fixtures) -> DataFrame:
    """The rule engine's rows as the issues that an answer would hold."""
    return requests.issues(xref.discrepancies(_steps(fx), fx.plant, fuzzy=False))
