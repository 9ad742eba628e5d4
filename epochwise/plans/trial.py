"""The day log with baselines, changes, responders and withdrawals attached.

Readout queries share this plan and its SQL counterpart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.operators import longitudinal as lon
from epochwise.plans import views as v

THRESHOLD = -1.0


def trial_log(spark, d) -> DataFrame:
    log = lon.change_from_baseline(v.obs_events(spark, d), ["x", "y"])
    log = lon.propagate_discontinuation(lon.with_last_epoch(log))
    at_end = F.col("epoch") == F.col("last_epoch")
    return log.withColumn("responder", lon.responder(F.col("x_change"), at_end, "decrease", THRESHOLD))


def end_rows(log: DataFrame) -> DataFrame:
    return log.where("epoch = last_epoch")


v._SQL["trial"] = [v.EV, v.AE_EVENTS, v.OBS_EVENTS, f"""
stops AS (
  SELECT subject, min(epoch) AS at, arg_min(CASE WHEN worst_grade >= 4 THEN 'CTCAE grade ' || worst_grade || ' adverse event'
         ELSE 'patient withdrew consent after reported symptoms' END, epoch) AS why
  FROM obs_events WHERE epoch > 0 AND (worst_grade >= 4 OR (narrated AND intent = 'discontinue')) GROUP BY subject
)""", f"""
trial AS (
  SELECT o.* REPLACE (CASE WHEN o.epoch > s.at THEN 0.0 ELSE o.dose END AS dose),
         b.x AS x_base, o.x - b.x AS x_change, o.x / b.x AS x_ratio,
         b.y AS y_base, o.y - b.y AS y_change, o.y / b.y AS y_ratio,
         e.last_epoch, coalesce(o.epoch >= s.at, false) AS discontinued,
         CASE WHEN o.epoch >= s.at THEN s.why ELSE '' END AS discontinuation_reason,
         coalesce(o.epoch = e.last_epoch AND o.x - b.x <= {THRESHOLD}, false) AS responder
  FROM obs_events o LEFT JOIN obs_events b ON b.subject = o.subject AND b.epoch = 0
  JOIN (SELECT subject, max(epoch) AS last_epoch FROM obs_events GROUP BY subject) e ON e.subject = o.subject
  LEFT JOIN stops s ON s.subject = o.subject
)""", """
eot AS (SELECT * FROM trial WHERE epoch = last_epoch)"""]

# the same with the rule that the log states: the ratio to a zero baseline is null (DuckDB's quotient would be infinite)
v._SQL["trial_ratios"] = [p.replace("o.x / b.x AS", "o.x / nullif(b.x, 0) AS").replace("o.y / b.y AS", "o.y / nullif(b.y, 0) AS") for p in v._SQL["trial"]]
