"""Queries over stored documents and runs, and vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dims import ISSUE_TYPES, sql_case
from ..operators import retrieval, store
from .catalogue import register
from .fixtures import Fixtures

_NEWEST = "nw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid_id ORDER BY created_at DESC NULLS LAST, run_id DESC) AS n FROM fx_runs) WHERE n = 1)"


@register("SELECT pid_id, file_name, status FROM fx_docs WHERE status = 'completed' ORDER BY pid_id DESC LIMIT 50")
def docs_recent(fx: Fixtures) -> DataFrame:
    return store.list_documents(fx.docs)


@register("SELECT upload_batch_id, pid_id, page_num, row_number() OVER (PARTITION BY upload_batch_id ORDER BY page_num ASC NULLS LAST, pid_id) AS place FROM fx_docs WHERE status = 'completed'")
def batch_pages(fx: Fixtures) -> DataFrame:
    return store.by_batch(fx.docs)


@register(f"WITH {_NEWEST} SELECT pid_id, run_id, status, n_issues FROM nw")
def latest_run(fx: Fixtures) -> DataFrame:
    return store.newest(fx.runs, "pid_id").select("pid_id", "run_id", "status", "n_issues")


@register("SELECT sop_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY sop_id ORDER BY created_at DESC NULLS LAST, run_id DESC) AS n FROM fx_runs) WHERE n = 1")
def latest_run_per_sop(fx: Fixtures) -> DataFrame:
    return store.newest(fx.runs, "sop_id").select("sop_id", "run_id")


@register(f"WITH {_NEWEST} SELECT d.pid_id, coalesce(file_name, 'P&ID') AS name, coalesce(nw.status, 'graph_ready') AS status, coalesce(CAST(n_issues AS BIGINT), 0) AS issue_count FROM fx_docs d LEFT JOIN nw ON d.pid_id = nw.pid_id WHERE d.status = 'completed'")
def list_pids(fx: Fixtures) -> DataFrame:
    return store.documents_with_runs(fx.docs, fx.runs)


@register("SELECT r.sop_id, r.pid_id, r.run_id, d.file_name FROM (SELECT *, row_number() OVER (PARTITION BY sop_id, pid_id ORDER BY created_at DESC NULLS LAST, run_id DESC) AS n FROM fx_runs) r JOIN fx_docs d ON r.pid_id = d.pid_id WHERE n = 1")
def dedupe_latest(fx: Fixtures) -> DataFrame:
    return store.runs_of_procedure(fx.runs, fx.docs)


@register("SELECT r.run_id, r.pid_id, d.file_name FROM fx_runs r JOIN fx_docs d ON r.pid_id = d.pid_id WHERE r.sop_id = 7")
def join_runs_docs(fx: Fixtures) -> DataFrame:
    d = fx.docs.select(F.col("pid_id").alias("p"), "file_name")
    return fx.runs.where("sop_id = 7").join(d, F.col("pid_id") == F.col("p")).select("run_id", "pid_id", "file_name")


@register("SELECT pid_id, CASE WHEN status IS NULL THEN 404 WHEN status <> 'completed' THEN 409 ELSE 200 END AS code FROM fx_docs")
def graph_guard(fx: Fixtures) -> DataFrame:
    return store.graph_guard(fx.docs)


@register(f"""WITH {_NEWEST}, u AS (SELECT 'pid' AS kind, d.pid_id AS id, nw.created_at, file_name FROM fx_docs d JOIN nw ON d.pid_id = nw.pid_id UNION ALL SELECT 'run', run_id, created_at, NULL FROM fx_runs)
SELECT kind, id, file_name FROM u ORDER BY created_at DESC, kind, id LIMIT 100""")
def recent_union(fx: Fixtures) -> DataFrame:
    return store.recent(fx.docs, fx.runs).drop("created_at")


@register("SELECT coalesce(severity, 'error') AS severity, count(*) AS runs, sum(n_issues)::BIGINT AS issues FROM fx_runs GROUP BY 1")
def issues_by_severity(fx: Fixtures) -> DataFrame:
    return store.issues_by_severity(fx.runs)


@register("SELECT pid_id, CASE WHEN n > 1 AND page_num IS NOT NULL THEN file_name || ' (page ' || page_num || ')' ELSE file_name END AS label, n FROM (SELECT *, count(*) OVER (PARTITION BY upload_batch_id, status) AS n FROM fx_docs)")
def same_name_count(fx: Fixtures) -> DataFrame:
    return store.same_name(fx.docs)


@register("SELECT upload_batch_id, greatest(count(page_num), 1) AS pages FROM fx_docs GROUP BY upload_batch_id")
def pdf_page_count(fx: Fixtures) -> DataFrame:
    return store.pages_per_file(fx.docs)


_RAW = "CASE event_id % 4 WHEN 0 THEN 'extra_component' WHEN 1 THEN 'type_mismatch' WHEN 2 THEN 'validation_skipped' ELSE event_type END"


@register(f"SELECT issue_type, count(*) AS n FROM (SELECT {sql_case(ISSUE_TYPES, 'raw', chr(39) + 'attribute_mismatch' + chr(39))} AS issue_type FROM (SELECT {_RAW} AS raw FROM events)) GROUP BY 1")
def map_issue_type(fx: Fixtures) -> DataFrame:
    return fx.events.select(store.issue_type(F.expr(_RAW)).alias("issue_type")).groupBy("issue_type").agg(F.count("*").alias("n"))


@register("""WITH u AS (SELECT pid_id, run_id, created_at, 0 AS w FROM fx_runs WHERE run_id % 2 = 0 UNION ALL SELECT pid_id, run_id, created_at, 1 FROM fx_runs WHERE run_id % 3 = 0)
SELECT pid_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY pid_id ORDER BY created_at DESC, w DESC, run_id DESC) AS n FROM (SELECT pid_id, max(run_id) AS run_id, created_at, w FROM u GROUP BY pid_id, created_at, w)) WHERE n = 1""")
def sink_upsert(fx: Fixtures) -> DataFrame:
    rows = lambda k: fx.runs.where(f"run_id % {k} = 0").groupBy("pid_id", "created_at").agg(F.max("run_id").alias("run_id"))
    return store.upsert(rows(2), rows(3), "pid_id", "created_at").select("pid_id", "run_id")


_TOP = """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id, {}round(list_cosine_distance(embedding::DOUBLE[], q.e::DOUBLE[]), 6) AS distance FROM embeddings, q {}ORDER BY distance, vec_id LIMIT {}"""


@register(_TOP.format("label, ", "", 10))
def vector_topk(fx: Fixtures) -> DataFrame:
    return retrieval.search(fx.embeddings, retrieval.vector_of(fx.embeddings, 0), 10)


@register(_TOP.format("label, ", "WHERE label = 3 ", 5))
def vector_search_filtered(fx: Fixtures) -> DataFrame:
    return retrieval.search(fx.embeddings.where("label = 3"), retrieval.vector_of(fx.embeddings, 0), 5)


@register("WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], q.e::DOUBLE[]), 6) AS distance FROM embeddings, q")
def cosine_distance(fx: Fixtures) -> DataFrame:
    q = F.array(*(F.lit(x) for x in retrieval.vector_of(fx.embeddings, 0)))
    return fx.embeddings.select("vec_id", F.round(retrieval.cosine_distance(F.col("embedding"), q), 6).alias("distance"))


@register("SELECT d.pid_id, d.file_name FROM (SELECT vec_id FROM (WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], q.e::DOUBLE[]), 6) AS d FROM embeddings, q) ORDER BY d, vec_id LIMIT 20) t JOIN fx_docs d ON d.pid_id = t.vec_id WHERE d.status = 'completed'")
def join_sop_matches(fx: Fixtures) -> DataFrame:
    """The best matches that are completed documents."""
    top = retrieval.search(fx.embeddings, retrieval.vector_of(fx.embeddings, 0), 20).select("vec_id")
    return fx.docs.where("status = 'completed'").join(F.broadcast(top), F.col("pid_id") == F.col("vec_id")).select("pid_id", "file_name")


@register("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(fx: Fixtures) -> DataFrame:
    """Windows over the events; the same plan runs as a stream in ``streaming``."""
    from ..streaming.streams import event_windows as windows

    return windows(fx.events).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, opens DESC ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(fx: Fixtures) -> DataFrame:
    from ..streaming.streams import sessions

    return sessions(fx.events).select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "n")
