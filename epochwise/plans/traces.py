"""Telemetry, lineage and span-tree queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochwise.functions.numbers import rnd
from epochwise.operators import graph, readout, telemetry
from epochwise.plans import views as v
from epochwise.plans.base import query, r
from epochwise.plans.readouts import rounded
from epochwise.plans.views import sql

_CALLS = "FILTER (kind = 'LLM')"


def _summary_sql(where="true"):
    return sql(
        "spans_events",
        f"""SELECT count(*) AS spans, count(*) {_CALLS} AS calls, count(DISTINCT trace_id) AS traces, count(*) FILTER (kind = 'LLM' AND cache_hit) AS cache_hits,
        count(*) FILTER (kind = 'LLM' AND status = 'ERROR') AS errors,
        {r("coalesce(count(*) FILTER (kind = 'LLM' AND cache_hit)::DOUBLE / nullif(count(*) FILTER (kind = 'LLM'), 0), 0.0)", 4)} AS cache_hit_rate,
        {r("coalesce(count(*) FILTER (kind = 'LLM' AND status = 'ERROR')::DOUBLE / nullif(count(*) FILTER (kind = 'LLM'), 0), 0.0)", 4)} AS error_rate,
        CAST(coalesce(sum(tokens_in) {_CALLS}, 0) AS BIGINT) AS tokens_in_total, CAST(coalesce(sum(tokens_out) {_CALLS}, 0) AS BIGINT) AS tokens_out_total,
        {r(f'coalesce(avg(tokens_in) {_CALLS}, 0.0)', 4)} AS tokens_in_mean, {r(f'coalesce(avg(tokens_out) {_CALLS}, 0.0)', 4)} AS tokens_out_mean,
        {r("coalesce(avg(duration_ms) FILTER (kind = 'LLM' AND duration_ms > 0), 0.0)", 4)} AS latency_ms_mean,
        {r("coalesce(max(duration_ms) FILTER (kind = 'LLM' AND duration_ms > 0), 0.0)", 2)} AS latency_ms_max,
        coalesce((SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT provider AS p FROM spans_events WHERE {where})), '') AS providers,
        coalesce((SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT model AS p FROM spans_events WHERE {where})), '') AS models FROM spans_events WHERE {where}""",
    )


@query("agg15_trace_summary", _summary_sql())
def _(spark, d):
    return telemetry.trace_summary(v.spans_events(spark, d))


@query("agg15_trace_summary_of_run", _summary_sql("run_id = 'run3'"))
def _(spark, d):
    return telemetry.trace_summary(v.spans_events(spark, d), "run3")


@query(
    "agg16_narrated_summary",
    sql(
        "obs_events",
        f"""SELECT count(*) AS calls, {r('avg(CASE WHEN cache_hit THEN 1.0 ELSE 0.0 END)')} AS cache_hit_rate, {r("avg(CASE WHEN error <> '' THEN 1.0 ELSE 0.0 END)")} AS error_rate,
        CAST(sum(tokens_in) AS BIGINT) AS tokens_in_total, CAST(sum(tokens_out) AS BIGINT) AS tokens_out_total,
        (SELECT string_agg(m, ',' ORDER BY m) FROM (SELECT DISTINCT model AS m FROM obs_events WHERE narrated)) AS models,
        (SELECT string_agg(m, ',' ORDER BY m) FROM (SELECT DISTINCT provider AS m FROM obs_events WHERE narrated)) AS providers FROM obs_events WHERE narrated""",
    ),
)
def _(spark, d):
    return rounded(telemetry.narrated_summary(v.obs_events(spark, d)), ["cache_hit_rate", "error_rate"])


@query(
    "agg16_first_token_values",
    sql("obs_events", "SELECT CAST(row_number() OVER (ORDER BY subject, epoch) AS INTEGER) AS position, tokens_in AS value FROM obs_events WHERE narrated QUALIFY position <= 4000"),
)
def _(spark, d):
    return telemetry.first_values(v.obs_events(spark, d), "tokens_in", ["subject", "epoch"])


def _pct(q):
    return r(f"max(v) FILTER (i = CAST(round_even({q} * (n - 1), 0) AS BIGINT) + 1)", 3)


@query(
    "agg17_nearest_rank_percentiles",
    sql(
        "spans_events",
        f""", k AS (SELECT kind, duration_ms AS v, row_number() OVER (PARTITION BY kind ORDER BY duration_ms) AS i, count(*) OVER (PARTITION BY kind) AS n FROM spans_events)
        SELECT kind, {_pct(0.5)} AS p50, {_pct(0.95)} AS p95 FROM k GROUP BY kind""",
    ),
)
def _(spark, d):
    return telemetry.percentiles(v.spans_events(spark, d), "duration_ms", {"p50": 0.5, "p95": 0.95}, ["kind"])


@query(
    "agg17_overall_percentiles",
    sql(
        "spans_events",
        f""", k AS (SELECT tokens_in AS v, row_number() OVER (ORDER BY tokens_in) AS i, count(*) OVER () AS n FROM spans_events WHERE kind = 'LLM')
        SELECT CAST({_pct(0.5)} AS DOUBLE) AS p50, CAST({_pct(0.95)} AS DOUBLE) AS p95 FROM k""",
    ),
)
def _(spark, d):
    return telemetry.percentiles(v.spans_events(spark, d).where("kind = 'LLM'"), "tokens_in", {"p50": 0.5, "p95": 0.95})


@query(
    "shp13_span_flattening",
    sql(
        "spans_events",
        """SELECT trace_id, span_id, parent_id, name, kind, duration_ms, tokens_in, '{"epoch":"' || epoch_text || '","run_id":"' || run_id || '"}' AS attributes_json
           FROM spans_events WHERE run_id = 'run2'""",
    ),
)
def _(spark, d):
    f = telemetry.flatten(v.spans_events(spark, d), "run2")
    return f.select("trace_id", "span_id", "parent_id", "name", "kind", "duration_ms", "tokens_in", "attributes_json")


# --- lineage ---------------------------------------------------------------------
@query(
    "grf01_edge_table",
    sql(
        "edges_dim",
        """SELECT source, target, relation, agent, 'run1' AS run_id, '{"kind":"' || split_part(target, ':', 1) || '"}' AS details_json, '2024-01-01T00:00:00' AS created_at FROM edges_dim""",
    ),
)
def _(spark, d):
    details = F.struct(F.split_part("target", F.lit(":"), F.lit(1)).alias("kind"))
    return graph.edge_table(v.edges_dim(spark, d), "run1", "2024-01-01T00:00:00", details)


@query(
    "grf02_upstream_closure",
    sql(
        "edges_dim",
        """, looped AS (SELECT source, target FROM edges_dim UNION ALL SELECT 'customer:' || o_custkey, 'nation:' || (o_custkey % 25) FROM orders WHERE o_custkey % 500 = 7),
        up(node) AS (SELECT source FROM looped WHERE target = 'nation:7' UNION SELECT l.source FROM looped l JOIN up ON l.target = up.node) SELECT node FROM up""",
        recursive=True,
    ),
)
def _(spark, d):
    edges = v.edges_dim(spark, d).select("source", "target")
    # a few customers feed back into nations, so the graph has cycles
    back = v.table(spark, d, "orders").where("o_custkey % 500 = 7").select(
        F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("source"),
        F.concat(F.lit("nation:"), (F.col("o_custkey") % 25).cast("string")).alias("target"),
    )
    return graph.upstream(edges.unionByName(back), "nation:7")


@query(
    "grf03_downstream_closure",
    sql(
        "edges_dim",
        ", dn(node) AS (SELECT target FROM edges_dim WHERE source = 'region:1' UNION SELECT e.target FROM edges_dim e JOIN dn ON e.source = dn.node) SELECT node FROM dn",
        recursive=True,
    ),
)
def _(spark, d):
    return graph.downstream(v.edges_dim(spark, d), "region:1")


@query(
    "grf04_span_tree",
    sql(
        "spans_events",
        """, p AS (SELECT s.trace_id, s.span_id, q.span_id AS parent FROM spans_events s LEFT JOIN spans_events q ON q.trace_id = s.trace_id AND q.span_id = s.parent_id),
        t(trace_id, span_id, root, depth, path) AS (SELECT trace_id, span_id, span_id, 0, span_id FROM p WHERE parent IS NULL
          UNION ALL SELECT p.trace_id, p.span_id, t.root, t.depth + 1, t.path || '/' || p.span_id FROM p JOIN t ON t.trace_id = p.trace_id AND p.parent = t.span_id)
        SELECT * FROM t""",
        recursive=True,
    ),
)
def _(spark, d):
    return graph.span_tree(v.spans_events(spark, d))


@query(
    "agg29_lineage_summary",
    sql(
        "edges_dim",
        """SELECT count(*) AS edges, (SELECT count(*) FROM (SELECT source FROM edges_dim UNION SELECT target FROM edges_dim)) AS nodes,
           (SELECT string_agg(agent, ',' ORDER BY agent) FROM (SELECT DISTINCT agent FROM edges_dim)) AS agents FROM edges_dim""",
    ),
)
def _(spark, d):
    return graph.lineage_summary(v.edges_dim(spark, d))


@query(
    "agg29_node_kinds",
    sql("edges_dim", "SELECT split_part(n, ':', 1) AS kind, count(*) AS n FROM (SELECT source AS n FROM edges_dim UNION SELECT target FROM edges_dim) GROUP BY 1"),
)
def _(spark, d):
    return graph.node_kinds(v.edges_dim(spark, d), F.split_part("node", F.lit(":"), F.lit(1)))
