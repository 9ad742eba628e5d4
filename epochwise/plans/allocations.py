"""Allocation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochwise.functions.coerce import age_band
from epochwise.operators import allocation
from epochwise.plans import views as v
from epochwise.plans.base import query, uniform_sql
from epochwise.plans.views import sql

WEIGHTS = {"ctl": 0.25, "low": 0.375, "high": 0.375}

_BLOCKS = f"""
, w AS (SELECT * FROM (VALUES (1, 'ctl', 0.25), (2, 'low', 0.375), (3, 'high', 0.375)) t(pos, a, w)),
q0 AS (SELECT s, pos, a, s * w AS exact, CAST(floor(s * w) AS INTEGER) AS k FROM range(1, 7) g(s), w),
q1 AS (SELECT *, s - sum(k) OVER (PARTITION BY s) AS rest, row_number() OVER (PARTITION BY s ORDER BY exact - k DESC, a) AS i FROM q0),
q2 AS (SELECT s, pos, a, k + CASE WHEN i <= rest THEN 1 ELSE 0 END AS k FROM q1),
q AS (SELECT s, a, sum(k) OVER (PARTITION BY s ORDER BY pos) AS upto, sum(k) OVER (PARTITION BY s ORDER BY pos) - k AS above FROM q2),
c AS (SELECT subject, sex || '|' || CASE WHEN age < 40 THEN '18-39' WHEN age < 60 THEN '40-59' ELSE '60+' END AS stratum FROM cohort_cust),
n AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY subject) - 1 AS rn, count(*) OVER (PARTITION BY stratum) AS total FROM c),
b AS (SELECT *, rn // 6 AS block_index, least(6, total - (rn // 6) * 6) AS size FROM n),
o AS (SELECT *, row_number() OVER (PARTITION BY stratum, block_index ORDER BY {uniform_sql("'77|randomisation|' || stratum || '|' || subject")}, subject) AS slot FROM b),
alloc AS (SELECT o.subject, o.stratum, o.block_index, q.a AS allocated_arm FROM o JOIN q ON q.s = o.size AND o.slot <= q.upto AND o.slot > q.above)"""


def allocated(spark, d):
    c = v.cohort_cust(spark, d).select("subject", "sex", age_band(F.col("age")).alias("age_band"))
    return allocation.permuted_blocks(c, WEIGHTS, ["sex", "age_band"], 6, "77")


@query("win08_permuted_blocks", sql("cohort_cust", _BLOCKS + " SELECT * FROM alloc"))
def _(spark, d):
    return allocated(spark, d).select("subject", "stratum", "block_index", "allocated_arm")


@query(
    "win09_simple_allocation",
    sql(
        "cohort_cust",
        f""", u AS (SELECT subject, {uniform_sql("'77|simple|' || subject")} AS u FROM cohort_cust)
            SELECT subject, CASE WHEN u < 0.25 THEN 'ctl' WHEN u < 0.625 THEN 'low' ELSE 'high' END AS allocated_arm FROM u""",
    ),
)
def _(spark, d):
    return allocation.simple_allocation(v.cohort_cust(spark, d).select("subject"), WEIGHTS, "77")


@query("win10_balance_audit", sql("cohort_cust", _BLOCKS + " SELECT stratum, block_index, allocated_arm, count(*) AS n FROM alloc GROUP BY ALL"))
def _(spark, d):
    return allocation.balance_audit(allocated(spark, d))


@query("win10_arm_counts", sql("cohort_cust", _BLOCKS + " SELECT allocated_arm, count(*) AS n FROM alloc GROUP BY ALL"))
def _(spark, d):
    return allocation.arm_counts(allocated(spark, d))
