"""Per-subject sequence queries and baseline joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochwise.functions.numbers import rnd
from epochwise.operators import joins
from epochwise.operators import longitudinal as lon
from epochwise.operators import ranks
from epochwise.plans import views as v
from epochwise.plans.base import query, r
from epochwise.plans.trial import trial_log
from epochwise.plans.views import sql


@query(
    "win01_end_of_treatment",
    sql("obs_orders", f"SELECT subject, arm, epoch, {r('x')} AS x, {r('y')} AS y FROM obs_orders QUALIFY epoch = max(epoch) OVER (PARTITION BY subject)"),
)
def _(spark, d):
    return lon.end_of_treatment(v.obs_orders(spark, d)).select("subject", "arm", "epoch", rnd(F.col("x")).alias("x"), rnd(F.col("y")).alias("y"))


@query(
    "win02_change_from_baseline",
    sql(
        "obs_orders",
        f"""SELECT o.subject, o.epoch, {r('o.x - b.x', 4)} AS x_change, {r('o.x / nullif(b.x, 0)', 4)} AS x_ratio
            FROM obs_orders o LEFT JOIN obs_orders b ON b.subject = o.subject AND b.epoch = 0""",
    ),
)
def _(spark, d):
    c = lon.change_from_baseline(v.obs_orders(spark, d), ["x"])
    return c.select("subject", "epoch", rnd(F.col("x_change"), 4).alias("x_change"), rnd(F.col("x_ratio"), 4).alias("x_ratio"))


@query(
    "win03_responder_flag",
    sql(
        "trial",
        """SELECT subject, epoch, coalesce(epoch = 29 AND x_change <= -1.0, false) AS down,
                  coalesce(epoch = 29 AND x_change >= 1.0, false) AS up, coalesce(epoch = last_epoch AND abs(x_change) >= 2.0, false) AS both,
                  coalesce(epoch = last_epoch AND x_change <= -0.5, false) AS by_mcid FROM trial""",
    ),
)
def _(spark, d):
    log = trial_log(spark, d)
    change, at, last = F.col("x_change"), F.col("epoch") == 29, F.col("epoch") == F.col("last_epoch")
    return log.select(
        "subject",
        "epoch",
        lon.responder(change, at, "decrease", -1.0).alias("down"),
        lon.responder(change, at, "increase", 1.0).alias("up"),
        lon.responder(change, last, "two_sided", -2.0).alias("both"),
        lon.responder(change, last, "decrease", mcid=0.5).alias("by_mcid"),
    )


@query(
    "win04_discontinuation",
    sql("trial", "SELECT subject, epoch, dose, discontinued, discontinuation_reason FROM trial"),
)
def _(spark, d):
    return trial_log(spark, d).select("subject", "epoch", "dose", "discontinued", "discontinuation_reason")


@query(
    "win05_cumulative_exposure",
    sql(
        "trial",
        """SELECT a.subject, a.epoch, CAST(sum(b.dose * b.n_rows) AS DOUBLE) AS cumulative FROM trial a
           JOIN trial b ON b.subject = a.subject AND b.epoch <= a.epoch GROUP BY ALL""",
    ),
)
def _(spark, d):
    log = trial_log(spark, d).select("subject", "epoch", (F.col("dose") * F.col("n_rows")).alias("auc"))
    return lon.cumulative(log, "auc", "cumulative").select("subject", "epoch", "cumulative")


@query(
    "win11_triggered_sampling",
    sql(
        "obs_events",
        """, c AS (SELECT subject, epoch, worst_grade FROM obs_events WHERE epoch > 0 AND (worst_grade >= 4 OR
             (('0x' || sha256('11|' || subject || '|' || epoch || '|sample')[1:16])::UBIGINT % 9223372036854775808::UBIGINT)::DOUBLE / 9223372036854775808.0::DOUBLE < 0.25))
           SELECT subject, epoch, worst_grade, CAST(row_number() OVER (PARTITION BY subject ORDER BY epoch) AS INTEGER) AS pick
           FROM c QUALIFY pick <= 6""",
    ),
)
def _(spark, d):
    picked = lon.sample_for_review(v.obs_events(spark, d), "11", "triggered", 4, 0.25)
    return picked.select("subject", "epoch", "worst_grade", "pick")


@query(
    "win12_ranked_subjects",
    sql(
        "trial",
        f"""SELECT subject, arg_max(arm, epoch) AS arm, {r('coalesce(max(x_base), arg_min(x, epoch))')} AS baseline_x,
                   {r('max(CASE WHEN epoch = last_epoch THEN x_change END)')} AS final_change, CAST(arg_max(worst_grade, epoch) AS INTEGER) AS worst_grade,
                   CAST(sum(n_ae) AS BIGINT) AS n_events, arg_max(responder, epoch) AS responder, bool_or(discontinued) AS discontinued,
                   bool_or(narrated) AS narrated FROM trial GROUP BY subject""",
    ),
)
def _(spark, d):
    i = ranks.subject_index(trial_log(spark, d), measure="x")
    return i.withColumn("baseline_x", rnd(F.col("baseline_x"))).withColumn("final_change", rnd(F.col("final_change")))


@query(
    "win12_subject_details",
    sql(
        "trial",
        f""", top AS (SELECT subject FROM eot ORDER BY worst_grade DESC, CAST(subject AS VARCHAR) LIMIT 150)
           SELECT subject, string_agg(CAST(epoch AS VARCHAR), ',' ORDER BY epoch) AS epochs,
                  string_agg(CAST(CAST(dose AS INTEGER) AS VARCHAR), ',' ORDER BY epoch) AS doses,
                  string_agg(CAST(CAST(round_even(y * 100, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY epoch) AS measures
           FROM trial SEMI JOIN top USING (subject) GROUP BY subject""",
    ),
)
def _(spark, d):
    det = ranks.subject_details(trial_log(spark, d), ["dose", "y"], top=150)

    def joined(field, scale):
        return F.concat_ws(",", F.transform("series", lambda s: F.rint(s[field] * scale).cast("bigint").cast("string")))

    return det.select("subject", joined("epoch", 1).alias("epochs"), joined("dose", 1).alias("doses"), joined("y", 100).alias("measures"))


@query(
    "win13_cohort_buckets",
    sql(
        "obs_events",
        """, b AS (SELECT DISTINCT cohort FROM obs_events), k AS (SELECT cohort, (dense_rank() OVER (ORDER BY cohort) - 1) // 3 AS g FROM b)
           SELECT subject, epoch, cohort, 'P' || lpad(CAST(g AS VARCHAR), 5, '0') AS bucket FROM obs_events JOIN k USING (cohort)""",
    ),
)
def _(spark, d):
    return ranks.bucket_key(v.obs_events(spark, d), "cohort", 3).select("subject", "epoch", "cohort", "bucket")


@query("win14_total_order", sql("obs_events", "SELECT cohort, subject, epoch, y FROM obs_events"))
def _(spark, d):
    return lon.ordered(v.obs_events(spark, d).select("cohort", "subject", "epoch", "y"), "cohort", "subject", "epoch")


@query(
    "win15_deviation_log",
    sql("trial", "SELECT subject, cohort, arm, epoch, discontinuation_reason AS reason FROM trial WHERE discontinued"),
)
def _(spark, d):
    return lon.deviations(trial_log(spark, d))


@query(
    "win15_first_deviations",
    sql("trial", "SELECT subject, cohort, arm, epoch, discontinuation_reason AS reason FROM trial WHERE discontinued QUALIFY row_number() OVER (PARTITION BY subject ORDER BY epoch) = 1"),
)
def _(spark, d):
    return lon.deviations(trial_log(spark, d), first_only=True)


# The three arms of the demonstration protocol.
ARMS = [
    ("ctl", "Placebo", 0.0, None, None, None, True, 0.25),
    ("low", "50 mg twice daily", 50.0, None, None, None, False, 0.375),
    ("high", "150 mg twice daily", 150.0, 3, 25.0, 200.0, False, 0.375),
]
ARMS_DDL = "arm string, label string, base_dose double, start_epoch int, step double, max_dose double, is_control boolean, weight double"


def arms_table(spark):
    return spark.createDataFrame(ARMS, ARMS_DDL)


@query(
    "win16_dose_schedule",
    sql(
        "obs_events",
        """, p AS (SELECT subject, arm, epoch, CASE WHEN epoch <= 0 OR arm = 'ctl' THEN 0.0 WHEN arm = 'low' THEN 50.0
                    WHEN epoch >= 3 THEN least(200.0, 150.0 + 25.0 * (epoch - 2)) ELSE 150.0 END::DOUBLE AS planned_dose FROM obs_events)
           SELECT subject, epoch, planned_dose, epoch * 12.0::DOUBLE AS planned_time,
                  CASE WHEN arm = 'ctl' THEN 'withhold study drug (placebo arm)'
                       ELSE 'administer ' || CAST(CAST(planned_dose AS INTEGER) AS VARCHAR) || ' mg ORAL' END AS instruction FROM p""",
    ),
)
def _(spark, d):
    arms = arms_table(spark).drop("label", "weight")
    s = lon.scheduled_dose(arms, v.obs_events(spark, d).select("subject", "arm", "epoch"), 12.0)
    return s.select("subject", "epoch", "planned_dose", "planned_time", "instruction")


# --- baseline and dimension joins -------------------------------------------
@query(
    "joi01_baseline_attach",
    sql(
        "obs_events",
        f""", e AS (SELECT * FROM obs_events QUALIFY epoch = max(epoch) OVER (PARTITION BY subject))
            SELECT e.subject, e.epoch, {r('b.x')} AS x_base, {r('b.y')} AS y_base, {r('e.y / nullif(b.y, 0)')} AS y_ratio
            FROM e LEFT JOIN obs_events b ON b.subject = e.subject AND b.epoch = 0""",
    ),
)
def _(spark, d):
    log = v.obs_events(spark, d)
    a = lon.attach_baseline(lon.end_of_treatment(log), log, ["x", "y"])
    return a.select(
        "subject", "epoch", rnd(F.col("x_base")).alias("x_base"), rnd(F.col("y_base")).alias("y_base"),
        rnd(F.try_divide("y", "y_base")).alias("y_ratio"),
    )


@query(
    "joi02_elevation",
    sql(
        "obs_events",
        "SELECT a.subject, a.epoch, a.y, b.y AS y_base FROM obs_events a JOIN obs_events b ON b.subject = a.subject AND b.epoch = 0 WHERE a.epoch <= 20 AND a.y >= 3 * b.y AND a.y > 40",
    ),
)
def _(spark, d):
    log = v.obs_events(spark, d)
    return lon.elevated(log, log, "y", 3.0, 40.0, upto=20).select("subject", "epoch", "y", "y_base")


@query(
    "joi03_arm_lookup",
    sql(
        "ae_events",
        """SELECT ae_id, CASE WHEN subject % 10 = 0 THEN 'ctl' ELSE arm END AS arm,
                  CASE WHEN subject % 10 = 0 OR arm = 'ctl' THEN 'Placebo' WHEN arm = 'low' THEN '50 mg twice daily' ELSE '150 mg twice daily' END AS label,
                  CASE WHEN subject % 10 = 0 OR arm = 'ctl' THEN 0.0 WHEN arm = 'low' THEN 50.0 ELSE 150.0 END::DOUBLE AS base_dose FROM ae_events""",
    ),
)
def _(spark, d):
    # one subject in ten carries an arm the protocol does not know
    e = v.ae_events(spark, d).withColumn("arm", F.when(F.col("subject") % 10 == 0, "gone").otherwise(F.col("arm")))
    dims = [{"arm": a[0], "label": a[1], "base_dose": a[2]} for a in ARMS]
    return joins.lookup_arm(e.select("ae_id", "arm"), dims)


@query(
    "joi04_control_match",
    sql(
        "ae_events",
        """, c AS (SELECT arm, term, count(*) AS n FROM ae_events GROUP BY ALL)
           SELECT c.arm, c.term, c.n, coalesce(k.n, 0) AS control_n FROM c LEFT JOIN c k ON k.term = c.term AND k.arm = 'ctl'""",
    ),
)
def _(spark, d):
    counts = v.ae_events(spark, d).groupBy("arm", "term").agg(F.count("ae_id").alias("n"))
    return joins.beside_control(counts, ["n"], ["term"], "ctl")


@query(
    "joi08_rule_grid",
    sql(
        "obs_events",
        """, r AS (SELECT * FROM (VALUES ('SR-01', 2, []::VARCHAR[]), ('SR-02', 3, ['low', 'high']), ('SR-03', 25, ['high'])) t(rule_id, min_epoch, arms)),
             a AS (SELECT arm, max(epoch) AS top, count(*) AS n FROM obs_events GROUP BY arm),
             m AS (SELECT max(top) AS m FROM a)
           SELECT rule_id, arm, CAST(e AS INTEGER) AS epoch FROM r, a, m, unnest(range(min_epoch, m.m + 1)) u(e)
           WHERE len(arms) = 0 OR list_contains(arms, arm)""",
    ),
)
def _(spark, d):
    from epochwise.operators import safety

    rules = [
        safety.Rule("SR-01", "grade3_plus_rate", 0.2, min_epoch=2),
        safety.Rule("SR-02", "sae_rate", 0.1, min_epoch=3, arms=("low", "high")),
        safety.Rule("SR-03", "mortality_rate", 0.05, min_epoch=25, arms=("high",)),
    ]
    log = v.obs_events(spark, d)
    return safety.rule_grid(log, rules).select("rule_id", "arm", "epoch")


@query(
    "joi09_grade_counts",
    sql(
        "trial",
        """, g AS (SELECT subject, count(*) AS n FROM ae_events WHERE grade >= 3 GROUP BY subject)
           SELECT e.subject, e.arm, coalesce(g.n, 0) AS grade3_events FROM eot e LEFT JOIN g USING (subject)""",
    ),
)
def _(spark, d):
    eot = lon.end_of_treatment(v.obs_events(spark, d))
    return joins.attach_grade_counts(eot, v.ae_events(spark, d), 3).select("subject", "arm", "grade3_events")
