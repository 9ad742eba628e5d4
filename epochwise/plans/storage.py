"""Source, sink and versioned-read queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochwise.operators import contract
from epochwise.plans import views as v
from epochwise.plans.base import query, seed_sql
from epochwise.plans.reshapes import BUILDERS
from epochwise.plans.views import sql
from epochwise.session import scratch_path
from epochwise.sources import export, tables, versions

_COLS = "_version, o_orderkey, o_custkey, o_orderstatus, o_totalprice"
_KEEP = ["_version", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


@query("src01_parquet_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, d):
    return tables.read_columns(spark, f"{d}/orders.parquet", ["o_orderkey", "not_there", "o_totalprice"])


@query(
    "src02_json_lines",
    sql("spans_events", "SELECT trace_id, span_id, kind, duration_ms, tokens_in, status FROM spans_events"),
)
def _(spark, d):
    """Spans written as JSON lines between blank and broken lines, then read back."""
    s = v.spans_events(spark, d).select("trace_id", "span_id", "kind", "duration_ms", "tokens_in", "status")
    text = F.to_json(F.struct(*s.columns, F.lit("ignored").alias("unknown_field")))
    damage = F.array(text, F.when(F.col("tokens_in") % 5 == 0, F.lit("{broken")), F.when(F.col("tokens_in") % 7 == 0, F.lit("   ")))
    path = scratch_path(spark, "spans")
    s.select(F.explode(F.array_compact(damage)).alias("value")).write.text(path)
    return tables.read_json_lines(spark, path, s.schema)


@query(
    "src03_append_and_overwrite",
    sql("batches", f"SELECT {_COLS} FROM order_batches WHERE _version >= 4"),
)
def _(spark, d):
    """Yearly batches written one by one (the fourth overwrites), then the effective state."""
    root = scratch_path(spark, "orders")
    data = v.order_batches(spark, d)
    for n in range(1, 9):
        part = data.where(F.col("_version") == n).drop("_version", "run_id")
        versions.append_batch(part, root, f"run{n}", "overwrite" if n == 4 else "append", ("o_orderstatus",))
    return versions.latest(versions.read_data(spark, root), versions.read_log(spark, root)).select(*_KEEP)


def stored(spark, d):
    """The order batches as a Parquet dataset partitioned by version, and their log."""
    root = scratch_path(spark, "batches")
    v.order_batches(spark, d).repartition("_version").write.partitionBy("_version").parquet(f"{root}/data")
    v.batch_log(spark, d).write.parquet(f"{root}/log")
    return versions.read_data(spark, root), versions.read_log(spark, root)


@query("src04_single_batch", sql("batches", f"SELECT {_COLS} FROM order_batches WHERE _version = 3"))
def _(spark, d):
    return versions.batch(stored(spark, d)[0], 3).select(*_KEEP)


@query("src04_as_of", sql("batches", f"SELECT {_COLS} FROM order_batches WHERE _version BETWEEN 4 AND 6"))
def _(spark, d):
    return versions.as_of(*stored(spark, d), 6).select(*_KEEP)


@query("src04_as_of_before_overwrite", sql("batches", f"SELECT {_COLS} FROM order_batches WHERE _version <= 2"))
def _(spark, d):
    return versions.as_of(*stored(spark, d), 2).select(*_KEEP)


@query(
    "src05_latest_state",
    sql("batches", f"SELECT {_COLS} FROM order_batches WHERE _version >= (SELECT max(version) FROM batch_log WHERE mode = 'overwrite')"),
)
def _(spark, d):
    return versions.latest(*stored(spark, d)).select(*_KEEP)


@query("src06_run_scoped", sql("batches", f"SELECT {_COLS} FROM order_batches WHERE run_id = sha256('1997')[1:8]"))
def _(spark, d):
    import hashlib

    run = hashlib.sha256(b"1997").hexdigest()[:8]
    data, log = stored(spark, d)
    return versions.of_run(data, run, log).select(*_KEEP)


@query(
    "src07_history",
    sql("batches", "SELECT version, written_at, CASE mode WHEN 'overwrite' THEN 'WRITE' ELSE 'APPEND' END AS operation, rows, run_id FROM batch_log ORDER BY version DESC LIMIT 5"),
)
def _(spark, d):
    return versions.history(v.batch_log(spark, d), 5)


@query("src08_beyond_retention", sql("batches", "SELECT version, run_id, rows FROM batch_log QUALIFY row_number() OVER (ORDER BY version DESC) > 3"))
def _(spark, d):
    return versions.beyond_retention(v.batch_log(spark, d), 3).select("version", "run_id", "rows")


@query(
    "src09_export_counts",
    sql(
        "trial cohort_cust",
        """SELECT 'DM' AS dataset, count(*) AS rows FROM cohort_cust UNION ALL SELECT 'EX', count(*) FROM trial WHERE dose > 0 UNION ALL SELECT 'VS', 2 * count(*) FROM trial
        UNION ALL SELECT 'AE', count(*) FROM ae_events UNION ALL SELECT 'ADSL', count(*) FROM eot UNION ALL SELECT 'ADVS', 2 * count(*) FROM trial UNION ALL SELECT 'ADAE', count(*) FROM ae_events""",
    ),
)
def _(spark, d):
    from epochwise.operators.datasets import VARIABLES

    made = {name: make(spark, d) for name, make in BUILDERS.items()}
    return export.export(made, VARIABLES, scratch_path(spark, "export"))


@query(
    "src10_nested_to_json",
    sql(
        "spans_events",
        """SELECT span_id, '{"epoch":"' || epoch_text || '","run_id":"' || run_id || '"}' AS attributes, '{"cost":' || tokens_in || ',"kind":"' || kind || '"}' AS call,
           '["' || provider || '","' || model || '"]' AS route FROM spans_events""",
    ),
)
def _(spark, d):
    s = v.spans_events(spark, d).select(
        "span_id", "attributes", F.struct("kind", F.col("tokens_in").alias("cost")).alias("call"), F.array("provider", "model").alias("route")
    )
    return contract.nested_to_json(s)


@query("src11_newest_run", sql("batches", f"SELECT {_COLS} FROM order_batches WHERE run_id = (SELECT arg_max(run_id, written_at) FROM batch_log)"))
def _(spark, d):
    return versions.newest_run(*stored(spark, d)).select(*_KEEP)


@query(
    "src12_bounded_sample",
    sql("obs_events", f"SELECT subject, epoch, y FROM obs_events ORDER BY {seed_sql("'0|' || subject || '|' || epoch")}, subject, epoch LIMIT 500"),
)
def _(spark, d):
    return tables.bounded_sample(v.obs_events(spark, d).select("subject", "epoch", "y"), 500, "0", ["subject", "epoch"])
