"""Arm summaries, trajectories, tables, flow, audit, overview and verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochwise.functions.numbers import rnd
from epochwise.operators import inference, ranks, readout, safety, screening
from epochwise.plans import views as v
from epochwise.plans.base import fisher_p_sql, json_map_sql, newcombe_sql, query, r, wilson_sql
from epochwise.plans.projections import _SCREEN_SQL, screened_cohort
from epochwise.plans.trial import end_rows, trial_log
from epochwise.plans.views import sql


def rounded(df, names, digits=6):
    return df.withColumns({n: rnd(F.col(n), digits) for n in names})


_WR, _WG = wilson_sql("responders", "n"), wilson_sql("grade3", "n")
ARM_SUMMARY_CTE = f"""
, s AS (SELECT arm, count(DISTINCT subject) AS n, avg(x_change) AS mx, coalesce(stddev_samp(x_change), 0.0) AS sx, avg(y_change) AS my,
        coalesce(stddev_samp(y_change), 0.0) AS sy, count(*) FILTER (responder) AS responders, avg(y_ratio) AS mr, count(*) FILTER (discontinued) AS disc
        FROM eot GROUP BY arm),
a AS (SELECT arm, count(*) AS n_obs FROM trial GROUP BY arm),
h AS (SELECT arm, count(DISTINCT subject) AS with_event, count(DISTINCT subject) FILTER (grade >= 3) AS grade3,
      count(DISTINCT subject) FILTER (serious) AS serious, count(DISTINCT subject) FILTER (grade >= 5) AS grade5 FROM ae_events GROUP BY arm),
summary AS (SELECT arm, arm = 'ctl' AS is_control, n AS n_subjects, n_obs AS n_observations, {r('mx')} AS mean_x_change, {r('sx')} AS sd_x_change,
  {r('my')} AS mean_y_change, {r('sy')} AS sd_y_change, {r('responders::DOUBLE / n')} AS responder_rate, {r('with_event::DOUBLE / n')} AS event_rate,
  {r('grade3::DOUBLE / n')} AS grade3_plus_rate, {r('serious::DOUBLE / n')} AS serious_rate, {r('grade5::DOUBLE / n')} AS grade5_rate,
  {r('mr')} AS mean_y_ratio, disc AS discontinuations, {r(_WR[0])} AS responder_ci_low, {r(_WR[1])} AS responder_ci_high,
  {r(_WG[0])} AS grade3_plus_ci_low, {r(_WG[1])} AS grade3_plus_ci_high
  FROM s JOIN a USING (arm) JOIN h USING (arm))"""


def arm_summary(spark, d):
    return readout.arm_summary(trial_log(spark, d), v.ae_events(spark, d), ["x_change", "y_change"], "y_ratio", "ctl")


@query("agg01_arm_summary", sql("trial_ratios", ARM_SUMMARY_CTE + " SELECT * FROM summary"))
def _(spark, d):
    s = arm_summary(spark, d)
    return rounded(s, [c for c, t in s.dtypes if t == "double"])


_WL = wilson_sql("hits", "n")


@query(
    "agg02_wilson_interval",
    sql(
        "dose_lines",
        f""", g AS (SELECT arm, count(*) FILTER (responder) AS hits, count(*) AS n FROM dose_lines GROUP BY arm)
            SELECT arm, hits, n, {r('hits::DOUBLE / n')} AS rate, {r(_WL[0])} AS ci_low, {r(_WL[1])} AS ci_high FROM g""",
    ),
)
def _(spark, d):
    return rounded(readout.rate_with_interval(v.dose_lines(spark, d), ["arm"], F.col("responder")), ["rate", "ci_low", "ci_high"])


_ND = newcombe_sql("k", "n", "coalesce(ck, 0)", "cn")
SAFETY_CTE = f"""
, sizes AS (SELECT arm, count(DISTINCT subject) AS n FROM eot GROUP BY arm),
soc AS (SELECT arm, term, soc FROM (SELECT arm, term, soc, row_number() OVER (PARTITION BY arm, term ORDER BY count(*) DESC, soc) AS i
        FROM ae_events GROUP BY arm, term, soc) WHERE i = 1),
hist AS (SELECT arm, term, {json_map_sql('grade', 'c')} AS grade_distribution FROM (SELECT arm, term, grade, count(*) AS c FROM ae_events GROUP BY ALL) GROUP BY ALL),
g AS (SELECT arm, term, count(*) AS n_events, count(DISTINCT subject) AS k, count(DISTINCT subject) FILTER (grade >= 3) AS grade3_plus,
      count(DISTINCT subject) FILTER (grade >= 5) AS grade5, count(DISTINCT subject) FILTER (serious) AS serious,
      count(DISTINCT subject) FILTER (source IN ('llm', 'hybrid')) AS reported_subjects, avg(p) AS mp FROM ae_events GROUP BY ALL),
j AS (SELECT g.*, soc.soc, hist.grade_distribution, s.n, c.k AS ck, (SELECT n FROM sizes WHERE arm = 'ctl') AS cn
      FROM g JOIN sizes s USING (arm) JOIN soc USING (arm, term) JOIN hist USING (arm, term) LEFT JOIN g c ON c.term = g.term AND c.arm = 'ctl'),
f AS (SELECT *, {fisher_p_sql('j.k', '(j.n - j.k)', 'coalesce(j.ck, 0)', '(j.cn - coalesce(j.ck, 0))')} AS p_value FROM j),
q AS (SELECT *, row_number() OVER (ORDER BY p_value, arm, term) AS rk, count(*) OVER () AS m FROM f),
safety AS (SELECT arm, term, soc, n AS n_subjects, n_events, k AS n_subjects_with_event, k::DOUBLE / n AS rate, coalesce(ck, 0)::DOUBLE / cn AS control_rate,
      k::DOUBLE / n - coalesce(ck, 0)::DOUBLE / cn AS risk_difference, {_ND[0]} AS rd_ci_low, {_ND[1]} AS rd_ci_high, p_value,
      least(1.0, min(p_value * m / rk) OVER (ORDER BY rk DESC)) AS q_value, grade3_plus, grade5, serious, reported_subjects,
      mp AS mean_probability, grade_distribution FROM q)"""
_SAFETY_DOUBLES = ["rate", "control_rate", "risk_difference", "rd_ci_low", "rd_ci_high", "p_value", "q_value", "mean_probability"]
#: Means of hundredths often end in a 5 at the seventh digit, which sums in another order may round either way.
_DIGITS = {"mean_probability": 12}


def safety_rows(spark, d):
    return safety.safety_table(v.ae_events(spark, d), end_rows(trial_log(spark, d)), "ctl")


@query(
    "agg03_safety_table",
    sql("trial", SAFETY_CTE + " SELECT * REPLACE (" + ", ".join(f"{r(c, _DIGITS.get(c, 6))} AS {c}" for c in _SAFETY_DOUBLES) + ") FROM safety"),
)
def _(spark, d):
    table = rounded(safety_rows(spark, d), [c for c in _SAFETY_DOUBLES if c not in _DIGITS])
    return safety.by_rate(rounded(table, ["mean_probability"], 12))


@query(
    "agg04_safety_without_control",
    sql(
        "trial",
        SAFETY_CTE + f""" SELECT arm, term, soc, n_subjects, n_events, n_subjects_with_event, {r('rate')} AS rate, grade3_plus, grade5, serious,
        reported_subjects, {r('mean_probability', 12)} AS mean_probability, grade_distribution FROM safety""",
    ),
)
def _(spark, d):
    t = safety.safety_table(v.ae_events(spark, d), end_rows(trial_log(spark, d)), None)
    return rounded(rounded(t, ["rate"]), ["mean_probability"], 12)


@query(
    "agg05_grade_histogram",
    sql("ae_events", f", c AS (SELECT term, grade, count(*) AS n FROM ae_events GROUP BY ALL) SELECT term, {json_map_sql('grade', 'n')} AS grades FROM c GROUP BY term"),
)
def _(spark, d):
    names = [f"g{g}" for g in range(1, 6)]
    wide = v.ae_events(spark, d).groupBy("term").agg(*[F.count(F.when(F.col("grade") == g, 1)).alias(f"g{g}") for g in range(1, 6)])
    return wide.select("term", safety.grade_histogram(names).alias("grades"))


@query(
    "agg06_grade_stack",
    sql(
        "trial",
        "SELECT t.arm, " + ", ".join(f"count(ae_id) FILTER (grade = {g}) AS g{g}" for g in range(1, 6))
        + " FROM (SELECT DISTINCT arm FROM trial) t LEFT JOIN ae_events e ON e.arm = t.arm GROUP BY t.arm",
    ),
)
def _(spark, d):
    return readout.grade_stack(v.ae_events(spark, d), v.obs_events(spark, d))


@query(
    "agg07_demographics",
    sql(
        "cohort_cust obs_orders",
        f""", b AS (SELECT subject, max(x) FILTER (epoch = 0) AS x0, arg_max(x, epoch) AS x1, max(epoch) AS e FROM obs_orders GROUP BY subject)
            SELECT c.arm, count(DISTINCT subject) AS n, {r('avg(age)')} AS age_mean, {r('coalesce(stddev_samp(age), 0.0)')} AS age_sd,
                   {r("100 * avg(CASE WHEN sex = 'F' THEN 1.0 ELSE 0.0 END)")} AS female_pct, {r('avg(x1)')} AS end_mean, {r('avg(x1 - x0)')} AS change_mean,
                   count(*) FILTER (e < 8) AS discontinued FROM cohort_cust c JOIN b USING (subject) GROUP BY c.arm""",
    ),
)
def _(spark, d):
    from epochwise.operators import longitudinal as lon

    log = lon.change_from_baseline(v.obs_orders(spark, d).select("subject", "epoch", "x"), ["x"])
    end = lon.end_of_treatment(log).withColumn("discontinued", F.col("epoch") < 8)
    rows = v.cohort_cust(spark, d).select("subject", "arm", "age", "sex").join(end, "subject")
    t = readout.demographics(rows, measure="x", change="x_change")
    return rounded(t, ["age_mean", "age_sd", "female_pct", "end_mean", "change_mean"])


_DOSE_CTE = """, g AS (SELECT arm, dose, count(*) AS n, avg(response) AS mean, stddev_samp(response) AS sd FROM dose_lines GROUP BY ALL)"""


@query(
    "agg08_dose_response",
    sql("dose_lines", _DOSE_CTE + f" SELECT arm, dose, n, {r('mean')} AS mean, {r('mean - 1.96 * sd / sqrt(n)')} AS ci_low, {r('mean + 1.96 * sd / sqrt(n)')} AS ci_high FROM g"),
)
def _(spark, d):
    return rounded(readout.dose_response(v.dose_lines(spark, d), "response"), ["mean", "ci_low", "ci_high"])


@query(
    "agg09_dose_trend",
    sql(
        "dose_lines",
        _DOSE_CTE + f""", t AS (SELECT regr_slope(mean, dose) AS b, regr_intercept(mean, dose) AS a, avg(mean) AS m FROM g),
        e AS (SELECT 1 - sum(pow(mean - (a + b * dose), 2)) / sum(pow(mean - m, 2)) AS r2, any_value(b) AS b FROM g, t)
        SELECT arm, dose, {r('mean')} AS mean, {r('b')} AS trend_slope, {r('r2')} AS trend_r_squared FROM g, e""",
    ),
)
def _(spark, d):
    t = readout.with_dose_trend(readout.dose_response(v.dose_lines(spark, d), "response"))
    return rounded(t.select("arm", "dose", "mean", "trend_slope", "trend_r_squared"), ["mean", "trend_slope", "trend_r_squared"])


@query(
    "agg10_participant_flow",
    sql(
        "trial",
        f""", s AS (SELECT subject, arm, bool_or(discontinued) AS d FROM trial GROUP BY ALL), c AS (SELECT arm, count(*) AS n FROM s GROUP BY arm)
            SELECT count(*) AS enrolled, count(*) FILTER (NOT d) AS completed, count(*) FILTER (d) AS discontinued,
                   (SELECT {json_map_sql('arm', 'n')} FROM c) AS allocation FROM s""",
    ),
)
def _(spark, d):
    return readout.participant_flow(trial_log(spark, d))


@query(
    "agg10_screening_summary",
    sql(
        "cohort_cust",
        f""", {_SCREEN_SQL}, c AS (SELECT reason, count(*) AS n FROM screened WHERE reason <> '' GROUP BY reason)
            SELECT count(*) AS screened, count(*) FILTER (reason = '') AS enrolled, count(*) FILTER (reason <> '') AS screen_failures,
                   {r("count(*) FILTER (reason <> '')::DOUBLE / count(*)", 4)} AS screen_failure_rate, (SELECT {json_map_sql('reason', 'n')} FROM c) AS failure_reasons
            FROM screened""",
    ),
)
def _(spark, d):
    s = screening.screening_summary(screened_cohort(spark, d).select("reason"))
    return s.withColumn("screen_failure_rate", rnd(F.col("screen_failure_rate"), 4))


@query(
    "agg11_quality_audit",
    sql(
        "trial",
        f"""SELECT count(*) AS rows, count(DISTINCT subject) AS subjects, count(*) FILTER (narrated) AS narrated_rows,
            {r('100 * count(*) FILTER (narrated)::DOUBLE / count(*)', 2)} AS narrated_pct, count(*) FILTER (error <> '') AS error_rows,
            {r("100 * count(*) FILTER (error <> '')::DOUBLE / count(*)", 4)} AS error_pct, CAST(max(epoch) + 1 AS BIGINT) AS epochs,
            (SELECT string_agg(model, ',' ORDER BY model) FROM (SELECT DISTINCT model FROM trial WHERE model IS NOT NULL)) AS models FROM trial""",
    ),
)
def _(spark, d):
    a = readout.quality_audit(v.obs_events(spark, d))
    return a.withColumn("narrated_pct", rnd(F.col("narrated_pct"), 2)).withColumn("error_pct", rnd(F.col("error_pct"), 4))


@query(
    "agg11_null_counts",
    sql(
        "trial_ratios",
        """SELECT * FROM (SELECT unnest(['model', 'provider', 'x_base', 'y_base', 'x_change', 'y_change', 'x_ratio', 'y_ratio']) AS "column",
           unnest([count(*) - count(model), count(*) - count(provider), count(*) - count(x_base), count(*) - count(y_base), count(*) - count(x_change),
           count(*) - count(y_change), count(*) - count(x_ratio), count(*) - count(y_ratio)]) AS nulls FROM trial) WHERE nulls > 0""",
    ),
)
def _(spark, d):
    return readout.null_counts(trial_log(spark, d))


@query(
    "agg12_cohort_summary",
    sql(
        "cohort_cust",
        f"""SELECT count(*) AS n, {r('avg(age)')} AS mean_age, {r("count(*) FILTER (sex = 'F')::DOUBLE / count(*)")} AS female_fraction, {r('avg(bmi)')} AS mean_bmi,
            {r('avg(sbp)')} AS mean_sbp, {r("count(*) FILTER (cyp2d6 = 'PM')::DOUBLE / count(*)")} AS poor_metaboliser_fraction,
            {r('count(*) FILTER (hla_b)::DOUBLE / count(*)')} AS hla_b_fraction, count(DISTINCT cohort) AS cohorts, count(DISTINCT site) AS sites FROM cohort_cust""",
    ),
)
def _(spark, d):
    s = readout.cohort_summary(v.cohort_cust(spark, d))
    return rounded(s, [c for c, t in s.dtypes if t == "double"])


@query(
    "agg12_ancestry_distribution",
    sql("cohort_cust", f"SELECT ancestry, count(*) AS n, {r('count(*)::DOUBLE / (SELECT count(*) FROM cohort_cust)')} AS share FROM cohort_cust GROUP BY ancestry"),
)
def _(spark, d):
    return rounded(readout.distribution(v.cohort_cust(spark, d), "ancestry"), ["share"])


def _digest_sql(source: str, text: str, order: str) -> str:
    """Tree of two levels, enough for 1024 * 1024 rows."""
    return f""", k AS (SELECT {text} AS t, row_number() OVER (ORDER BY {order}) - 1 AS o FROM {source}),
        l AS (SELECT o // 1024 AS b, sha256(string_agg(t, '|' ORDER BY o)) AS t FROM k GROUP BY 1),
        l2 AS (SELECT b // 1024 AS b, CASE WHEN count(*) = 1 THEN any_value(t) ELSE sha256(string_agg(t, '|' ORDER BY b)) END AS t FROM l GROUP BY 1)
        SELECT CASE WHEN count(*) = 1 THEN any_value(t) ELSE sha256(string_agg(t, '|' ORDER BY b)) END[1:16] AS digest FROM l2"""


@query("agg13_cohort_digest", sql("cohort_cust", _digest_sql("cohort_cust", "subject || ':' || CAST(age AS INTEGER) || ':' || sex || ':' || CAST(sbp AS INTEGER)", "subject")))
def _(spark, d):
    parts = [F.col("subject"), F.col("age").cast("int"), F.col("sex"), F.col("sbp").cast("int")]
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return readout.cohort_digest(v.cohort_cust(spark, d), text, "subject")


@query("agg13_text_key_digest", sql("edges_dim", _digest_sql("edges_dim", "source || '>' || target || ':' || relation", "source, target, relation")))
def _(spark, d):
    text = F.concat(F.col("source"), F.lit(">"), F.col("target"), F.lit(":"), F.col("relation"))
    return readout.cohort_digest(v.edges_dim(spark, d), text, "source", "target", "relation")


def _traj_sql(m, sd):
    half = f"1.96 * coalesce(stddev_samp({m}), 0.0) / sqrt(greatest(1, count({m})))"
    return (
        f"SELECT '{m}' AS metric, arm, epoch, {r(f'avg({m})', 4)} AS mean, {r(f'coalesce(stddev_samp({m}), 0.0)', 4)} AS sd, count({m}) AS n, "
        f"{r(f'avg({m}) - {half}', 4)} AS low, {r(f'avg({m}) + {half}', 4)} AS high FROM trial GROUP BY arm, epoch"
    )


@query("agg19_trajectories", sql("trial_ratios", " UNION ALL ".join(_traj_sql(m, None) for m in ("x", "dose", "x_change", "x_ratio"))))
def _(spark, d):
    t = readout.trajectories(trial_log(spark, d), ["x", "dose", "x_change", "x_ratio"])
    return rounded(t, ["mean", "sd", "low", "high"], 4)


_HEAT = """, n AS (SELECT arm, count(DISTINCT subject) AS size FROM obs_events GROUP BY arm),
c AS (SELECT term, arm, count(DISTINCT subject) AS k FROM ae_events GROUP BY ALL),
t AS (SELECT term, CAST(sum(k) AS BIGINT) AS total FROM c GROUP BY term ORDER BY total DESC, term LIMIT 8)"""


@query(
    "agg20_event_heat",
    sql(
        "obs_events ae_events",
        _HEAT + " SELECT t.term, t.total, " + ", ".join(
            r(f"coalesce(max(100.0 * k / size) FILTER (c.arm = '{a}'), 0.0)") + f" AS {a}" for a in ("ctl", "low", "high")
        ) + " FROM t JOIN c ON c.term = t.term JOIN n ON n.arm = c.arm GROUP BY t.term, t.total",
    ),
)
def _(spark, d):
    cells = readout.event_heat(v.ae_events(spark, d), v.obs_events(spark, d))
    return rounded(readout.heat_table(cells, ["ctl", "low", "high"]), ["ctl", "low", "high"])


@query("agg21_events_by_term", sql("ae_events", "SELECT arm, term, count(*) AS n, max(grade) AS worst FROM ae_events GROUP BY ALL"))
def _(spark, d):
    return readout.events_by_term(v.ae_events(spark, d))


@query(
    "agg22_exposure_at_end",
    sql("trial", f"SELECT arm, {r('avg(dose)')} AS mean_dose, {r('avg(x)')} AS mean_x FROM trial WHERE epoch = 29 GROUP BY arm"),
)
def _(spark, d):
    return rounded(readout.exposure_at_end(trial_log(spark, d), 29, ["dose", "x"]), ["mean_dose", "mean_x"])


@query("agg23_cross_tab", sql("cohort_cust", "SELECT arm, sex, count(*) AS n FROM cohort_cust GROUP BY ALL"))
def _(spark, d):
    return readout.cross_tab(v.cohort_cust(spark, d), "arm", "sex")


@query(
    "agg24_histogram",
    f"""WITH v AS (SELECT CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem), e AS (SELECT min(x) AS lo, (max(x) - min(x)) / 18 AS w FROM v),
    b AS (SELECT CAST(least(17, floor((x - lo) / w)) AS INTEGER) AS bin, lo, w FROM v, e)
    SELECT bin, {r('any_value(lo) + bin * any_value(w)', 4)} AS "from", {r('any_value(lo) + bin * any_value(w) + any_value(w)', 4)} AS "to", count(*) AS n FROM b GROUP BY bin""",
)
def _(spark, d):
    h = readout.histogram(v.table(spark, d, "lineitem"), "l_extendedprice")
    return rounded(h, ["from", "to"], 4)


@query("agg18_median", sql("trial", f"SELECT arm, {r('median(x_change)')} AS median FROM eot WHERE n_rows >= 1 GROUP BY arm"))
def _(spark, d):
    rows = end_rows(trial_log(spark, d)).where("n_rows >= 1")
    return rounded(ranks.median(rows, "x_change", ["arm"]), ["median"])


@query(
    "agg18_lineitem_median",
    "SELECT l_returnflag, median(l_extendedprice) AS median FROM lineitem GROUP BY l_returnflag",
)
def _(spark, d):
    return ranks.median(v.table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])


# --- alerts, overview, verdict ------------------------------------------------
@query(
    "agg27_safety_alerts",
    sql(
        "trial",
        SAFETY_CTE + r""", z AS (SELECT *, coalesce(grade3_plus > 0 AND q_value < 0.10, false) AS severe FROM safety)
        SELECT CASE WHEN severe AND grade3_plus >= 3 THEN 'high' ELSE 'moderate' END AS severity, term, arm,
          CASE WHEN severe THEN printf('%s: grade>=3 in %d patients, rate difference %+.1f%% vs control (q=%.3f)', term, grade3_plus, risk_difference * 100, q_value)
               ELSE printf('%s: %.0f%% of patients affected vs %.0f%% in control', term, rate * 100, control_rate * 100) END AS message
        FROM z WHERE n_subjects_with_event >= 5 AND (severe OR (rate > 0.25 AND risk_difference > 0.10))""",
    ),
)
def _(spark, d):
    return safety.safety_alerts(safety_rows(spark, d))
