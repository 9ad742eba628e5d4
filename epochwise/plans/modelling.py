"""Feature, scoring, fit and pandas-map queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from epochwise.functions import coerce
from epochwise.functions import kinetics as kin
from epochwise.functions.numbers import rnd
from epochwise.operators import grouped, models, ranks
from epochwise.plans import views as v
from epochwise.plans.base import query, r, uniform_sql
from epochwise.plans.projections import _LIST_SQL
from epochwise.plans.readouts import rounded
from epochwise.plans.views import sql

DRUG = kin.Drug()
TAU = 12.0


def subjects(spark, d):
    return v.cohort_cust(spark, d).withColumn("n_conditions", F.size(coerce.to_list(F.col("conditions_text"))))


def doses(spark, d):
    """Half-year order epochs as dosing epochs: the dose follows the number of orders, the response is the mean root price."""
    return v.obs_orders(spark, d).select("subject", "epoch", (F.col("n_orders") % 3 * 50.0).alias("dose"), "x")


_DOSES = """doses AS (SELECT subject, epoch, (n_orders % 3) * 50.0::DOUBLE AS dose, x FROM obs_orders)"""


@query(
    "mod01_kinetic_features",
    sql(
        "cohort_cust obs_orders",
        f""", {_DOSES}, g AS (SELECT subject, count(*) FILTER (dose > 0) AS n_dosed, coalesce(sum(dose), 0.0) AS total_dose,
            min(epoch) FILTER (dose > 0) AS f, max(epoch) FILTER (dose > 0) AS l FROM doses GROUP BY subject)
        SELECT subject, n_dosed, total_dose, coalesce(CAST(f AS INTEGER), -1) AS first_dosed, coalesce(CAST(l AS INTEGER), -1) AS last_dosed,
               {r('coalesce((l - f)::DOUBLE / nullif(n_dosed - 1, 0), -1)')} AS mean_interval, {r('total_dose / weight')} AS dose_per_kg
        FROM g JOIN cohort_cust USING (subject)""",
    ),
)
def _(spark, d):
    """Recorded dosing of each subject, also per kg of body weight; -1 stands for none."""
    s = models.dosing_summary(doses(spark, d)).join(v.cohort_cust(spark, d).select("subject", "weight"), "subject")
    s = s.select("subject", "n_dosed", "total_dose", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("first_dosed", "last_dosed", "mean_interval")], (F.col("total_dose") / F.col("weight")).alias("dose_per_kg"))
    return rounded(s, ["mean_interval", "dose_per_kg"])


def exposed(spark, d):
    """Recorded exposure of each subject-epoch beside the subject's covariates."""
    own = subjects(spark, d).select("subject", "weight", "age", "bmi", "egfr", "n_conditions", "sex", "cyp2d6", "hla_b", "slco1b1", "smoking", "sbp", "alt")
    return models.exposure_features(doses(spark, d).join(own, "subject"))


_EXPO = _LIST_SQL + f""",
m AS (SELECT *, len(conditions) AS n_conditions FROM list), {_DOSES},
x0 AS (SELECT o.subject, o.epoch, o.dose, o.x, m.* EXCLUDE (subject) FROM doses o JOIN m ON m.subject = o.subject),
expo AS (SELECT *, dose / weight AS dose_per_kg, sum(dose) OVER w AS cumulative_dose, avg(dose) OVER w AS mean_dose, avg(dose / weight) OVER w AS exposure_ratio
         FROM x0 WINDOW w AS (PARTITION BY subject ORDER BY epoch))"""
_EXPO_COLS = ["dose_per_kg", "cumulative_dose", "mean_dose", "exposure_ratio"]


_COURSE_COLS = ["n_dosed", "peak_dose_per_kg", "trough_dose_per_kg", "since_dose"]


@query(
    "mod02_exposure_features",
    sql(
        "cohort_cust obs_orders",
        f""", {_EXPO}, course AS (SELECT *, count(*) FILTER (dose > 0) OVER w AS n_dosed, coalesce(max(dose_per_kg) FILTER (dose > 0) OVER w, 0.0::DOUBLE) AS peak_dose_per_kg,
            coalesce(min(dose_per_kg) FILTER (dose > 0) OVER w, 0.0::DOUBLE) AS trough_dose_per_kg, CAST(coalesce(epoch - max(epoch) FILTER (dose > 0) OVER w, -1) AS INTEGER) AS since_dose
            FROM expo WINDOW w AS (PARTITION BY subject ORDER BY epoch))
        SELECT subject, epoch, {', '.join(f"{r(c)} AS {c}" for c in _EXPO_COLS)}, n_dosed, {r('peak_dose_per_kg')} AS peak_dose_per_kg, {r('trough_dose_per_kg')} AS trough_dose_per_kg, since_dose FROM course""",
    ),
)
def _(spark, d):
    """Exposure so far on every row: level, sum and means, the dosed epochs, highest and lowest dose, distance to the last dose."""
    e = models.exposure_course(exposed(spark, d))
    return rounded(e.select("subject", "epoch", *_EXPO_COLS, *_COURSE_COLS), [*_EXPO_COLS, "peak_dose_per_kg", "trough_dose_per_kg"])


@query(
    "mod03_emax_effect",
    sql(
        "obs_orders",
        f""", {_DOSES}, l AS (SELECT subject, dose, avg(x) AS m FROM doses GROUP BY ALL),
        n AS (SELECT subject, m AS none FROM l WHERE dose = 0),
        b AS (SELECT subject, dose AS best_dose, m AS top FROM l WHERE dose > 0 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY m DESC, dose) = 1)
        SELECT subject, epoch, dose, {r('m - none')} AS effect, best_dose, {r('top - none')} AS best_effect
        FROM doses JOIN l USING (subject, dose) LEFT JOIN n USING (subject) LEFT JOIN b USING (subject)""",
    ),
)
def _(spark, d):
    """Measured effect of the dose on every subject-epoch, beside the subject's largest one."""
    return rounded(models.level_effects(doses(spark, d), "x"), ["effect", "best_effect"])


def kinetic(spark, d):
    """Exposure of each subject-epoch by the kinetics of the subject's weight, age, sex, kidney function and metabolism."""
    own = models.kinetic_parameters(subjects(spark, d).withColumn("metabolism", coerce.exposure_multiplier(F.col("cyp2d6"))), DRUG)
    own = own.select("subject", "cl", "vol", "ke", "age", "bmi", "egfr", "n_conditions", "sex", "cyp2d6", "hla_b", "slco1b1", "smoking", "sbp", "alt")
    return models.kinetic_exposure(doses(spark, d).drop("x").join(own, "subject"), DRUG, TAU)


_PK = _LIST_SQL + """,
m AS (SELECT *, CASE cyp2d6 WHEN 'PM' THEN 1.35 WHEN 'IM' THEN 1.175 WHEN 'NM' THEN 1.0 ELSE 0.825 END::DOUBLE AS metabolism, len(conditions) AS n_conditions FROM list),
c1 AS (SELECT *, greatest(0.05::DOUBLE, 4.0::DOUBLE * greatest(30.0::DOUBLE, weight) * 60 / 1000 * (0.4::DOUBLE * least(1.25::DOUBLE, greatest(0.35::DOUBLE, egfr / 100))
        + 0.5::DOUBLE * metabolism + 0.1::DOUBLE) * least(1.15::DOUBLE, greatest(0.55::DOUBLE, 1 - 0.008::DOUBLE * greatest(0::DOUBLE, age - 40))) * CASE WHEN sex = 'F' THEN 0.9 ELSE 1.0 END::DOUBLE) AS cl,
        greatest(5.0::DOUBLE, 1.2::DOUBLE * greatest(30.0::DOUBLE, weight) * (1 + 0.1::DOUBLE * (bmi - 25) / 25)) AS vol FROM m),
pk AS (SELECT *, cl / vol AS ke, ln(2) / (cl / vol) AS half_life FROM c1)"""


def _level(t):
    decay = lambda k: f"exp(-{k} * {t}) * (1 - exp(-{k} * epoch * 12.0::DOUBLE)) / (1 - exp(-{k} * 12.0::DOUBLE))"
    return f"greatest(0.0::DOUBLE, 0.7::DOUBLE * dose * 1.1::DOUBLE / (vol * (1.1::DOUBLE - ke)) * ({decay('ke')} - {decay('1.1::DOUBLE')}))"


_KIN = _PK + f""",
x0 AS (SELECT o.subject, o.epoch, (o.n_orders % 3) * 50.0::DOUBLE AS dose, pk.* EXCLUDE (subject) FROM obs_orders o JOIN pk ON pk.subject = o.subject),
x1 AS (SELECT *, dose > 0 AND epoch > 0 AS dosed, CASE WHEN dose > 0 AND epoch > 0 THEN ln(1.1::DOUBLE / ke) / (1.1::DOUBLE - ke) ELSE 0 END AS t_max,
        CASE WHEN dose > 0 AND epoch > 0 THEN 0.7::DOUBLE * dose / cl ELSE 0 END AS auc FROM x0),
expo AS (SELECT *, CASE WHEN dosed THEN {_level('0.0::DOUBLE')} ELSE 0 END AS c_trough, CASE WHEN dosed THEN {_level('t_max')} ELSE 0 END AS c_peak,
        auc / 12 AS c_avg, auc / 12 / 0.9::DOUBLE AS exposure_ratio, sum(auc) OVER (PARTITION BY subject ORDER BY epoch) AS cumulative_auc FROM x1)"""


TERMS = [
    {"term": "cough", "intercept": -3.1, "slope": 0.6, "coefficients": {"female": 0.45, "age_z": 0.10}},
    {"term": "headache", "intercept": -2.4, "slope": 0.3, "coefficients": {"female": 0.35, "age_z": -0.10, "comorbidity_z": 0.12}},
    {"term": "hepatotoxicity", "intercept": -5.0, "slope": 1.1, "coefficients": {"hla_b": 1.10, "slco1b1": 0.45, "bmi_z": 0.20, "unlisted": 9.0}},
]


def covariates():
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "female": one(F.col("sex") == "F"),
        "age_z": models.z_score(F.col("age"), "age"),
        "bmi_z": models.z_score(F.col("bmi"), "bmi"),
        "comorbidity_z": models.z_score(F.col("n_conditions"), "comorbidity"),
        "hla_b": one(F.col("hla_b")),
        "slco1b1": one(F.col("slco1b1")),
    }


_COV = """, cov AS (SELECT subject, epoch, exposure_ratio, CASE WHEN sex = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS female, (age - 55) / 12 AS age_z, (bmi - 27) / 5 AS bmi_z,
  (n_conditions - 2) / 1.5::DOUBLE AS comorbidity_z, CASE WHEN hla_b THEN 1.0 ELSE 0.0 END::DOUBLE AS hla, CASE WHEN slco1b1 THEN 1.0 ELSE 0.0 END::DOUBLE AS slco FROM expo),
lg AS (SELECT subject, epoch, 'cough' AS term, -3.1::DOUBLE + 0.6::DOUBLE * ln(1 + exposure_ratio) + 0.45::DOUBLE * female + 0.1::DOUBLE * age_z + 0.25::DOUBLE * exp(-epoch / 2.0::DOUBLE) AS x FROM cov
  UNION ALL SELECT subject, epoch, 'headache', -2.4::DOUBLE + 0.3::DOUBLE * ln(1 + exposure_ratio) + 0.35::DOUBLE * female - 0.1::DOUBLE * age_z + 0.12::DOUBLE * comorbidity_z + 0.25::DOUBLE * exp(-epoch / 2.0::DOUBLE) FROM cov
  UNION ALL SELECT subject, epoch, 'hepatotoxicity', -5::DOUBLE + 1.1::DOUBLE * ln(1 + exposure_ratio) + 1.1::DOUBLE * hla + 0.45::DOUBLE * slco + 0.2::DOUBLE * bmi_z + 0.25::DOUBLE * exp(-epoch / 2.0::DOUBLE) FROM cov)"""


@query("mod04_risk_scores", sql("cohort_cust obs_orders", f", {_KIN}{_COV} SELECT subject, epoch, term, {r('1 / (1 + exp(-x))', 7)} AS p FROM lg"))
def _(spark, d):
    s = models.risk_scores(kinetic(spark, d), TERMS, covariates(), ["subject", "epoch"])
    return rounded(s, ["p"], 7)


_FEATURES_SQL = [
    "1.0::DOUBLE", "ln(1 + greatest(0, exposure_ratio))", "least(exposure_ratio, 20)", "(age - 55) / 12", "(bmi - 27) / 5", "(egfr - 90) / 20",
    "(n_conditions - 2) / 1.5::DOUBLE", "CASE WHEN sex = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE", "CASE WHEN cyp2d6 = 'PM' THEN 1.0 ELSE 0.0 END::DOUBLE",
    "CASE WHEN hla_b THEN 1.0 ELSE 0.0 END::DOUBLE", "epoch / 13.0::DOUBLE", "(sbp - 132) / 14", "(alt - 26) / 12", "CASE WHEN smoking = 'current' THEN 1.0 ELSE 0.0 END::DOUBLE",
]


def _fv(own, level):
    return f", fv AS (SELECT subject, epoch, {own}" + ", ".join(f"{e} AS f{i}" for i, e in enumerate(_FEATURES_SQL)) + f", {level} * 3 + age / 10 AS y FROM expo)"


_FV, _KIN_FV = _fv("", "dose_per_kg"), _fv("c_avg, ", "c_trough")
_F = [f"f{i}" for i in range(14)]


def featured(rows, level):
    """The feature vector of exposure rows, and a target made of their ``level`` and age."""
    vec = [c.alias(f"f{i}") for i, c in enumerate(models.feature_vector(13))]
    return rows.select("subject", "epoch", *vec, (F.col(level) * 3 + F.col("age") / 10).alias("y"))


@query("mod05_feature_vector", sql("cohort_cust obs_orders", f", {_KIN}{_KIN_FV} SELECT subject, epoch, " + ", ".join(f"{r(f)} AS {f}" for f in _F) + " FROM fv"))
def _(spark, d):
    return rounded(featured(kinetic(spark, d), "c_trough").select("subject", "epoch", *_F), _F)


_PAIRS = [(i, j) for i in range(15) for j in range(i, 15)]
_NAMES = [*_F, "y"]


@query(
    "mod06_gram_sums",
    sql(
        "cohort_cust obs_orders",
        f", {_KIN}{_KIN_FV}, g AS (SELECT " + ", ".join(f"sum({_NAMES[i]} * {_NAMES[j]}) AS g_{i}_{j}" for i, j in _PAIRS) + " FROM fv) "
        + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {r(f'g_{i}_{j}', 3)} AS s FROM g" for i, j in _PAIRS),
    ),
)
def _(spark, d):
    return rounded(models.gram_sums(featured(kinetic(spark, d), "c_trough"), _F, "y"), ["s"], 3)


_SYSTEM = ", ".join("[" + ", ".join(f"g_{min(i, j)}_{max(i, j)}" + (" + 1.0::DOUBLE" if i == j and i > 0 else "") for j in range(15)) + "]" for i in range(14))


@query(
    "mod06_ridge_fit",
    sql(
        "cohort_cust obs_orders",
        # Gauss-Jordan: step p clears column p of all rows but p
        f""", {_EXPO}{_FV}, g AS (SELECT """ + ", ".join(f"sum({_NAMES[i]} * {_NAMES[j]}) AS g_{i}_{j}" for i, j in _PAIRS) + f""" FROM fv),
        gj(p, m) AS (SELECT 1, [{_SYSTEM}] FROM g
          UNION ALL SELECT p + 1, list_transform(range(1, 15), lambda i: list_transform(range(1, 16), lambda j:
            CASE WHEN i = p THEN m[p][j] / m[p][p] ELSE m[i][j] - m[i][p] / m[p][p] * m[p][j] END)) FROM gj WHERE p <= 14)
        SELECT 'f' || (i - 1) AS feature, {r('m[i][15]')} AS coefficient FROM gj, range(1, 15) t(i) WHERE p = 15""",
        recursive=True,
    ),
)
def _(spark, d):
    beta = models.ridge_fit(featured(exposed(spark, d), "dose_per_kg"), _F, "y", 1.0)
    return rounded(spark.createDataFrame([(f"f{i}", float(b)) for i, b in enumerate(beta)], "feature string, coefficient double"), ["coefficient"])


_BETA = [0.5, 1.0, -0.25, 0.1, 0.0, 0.2, 0.0, 0.3, -0.4, 0.0, 1.5, 0.0, 0.05, 0.6]
_DOT = " + ".join(f"{b}::DOUBLE * f{i}" for i, b in enumerate(_BETA))


@query(
    "mod07_holdout_metrics",
    sql(
        "cohort_cust obs_orders",
        f""", {_KIN}{_KIN_FV}, s AS (SELECT y, {_DOT} AS yhat, {uniform_sql("'5|' || subject || '|' || epoch")} < 0.2 AS holdout FROM fv),
        g AS (SELECT holdout, avg(y) AS m FROM s GROUP BY holdout)
        SELECT s.holdout, count(*) AS n, {r('sqrt(avg(pow(y - yhat, 2)))')} AS rmse, {r('1 - sum(pow(y - yhat, 2)) / sum(pow(y - m, 2))')} AS r2 FROM s JOIN g USING (holdout) GROUP BY s.holdout""",
    ),
)
def _(spark, d):
    f = models.split_holdout(featured(kinetic(spark, d), "c_trough"), "5", ["subject", "epoch"])
    scored = f.withColumn("yhat", models.linear_score(F.array(*_F), _BETA, 14))
    return rounded(models.fit_metrics(scored, "y", "yhat", ["holdout"]), ["rmse", "r2"])


@query("mod08_linear_scores", sql("cohort_cust obs_orders", f", {_KIN}{_KIN_FV} SELECT subject, epoch, {r(_DOT)} AS score, 0.0::DOUBLE AS missing, 0.0::DOUBLE AS ill_sized FROM fv"))
def _(spark, d):
    vec = F.array(*_F)
    return featured(kinetic(spark, d), "c_trough").select(
        "subject",
        "epoch",
        rnd(models.linear_score(vec, _BETA, 14)).alias("score"),
        models.linear_score(vec, None, 14).alias("missing"),
        models.linear_score(F.array(*_F[:13]), _BETA, 14).alias("ill_sized"),
    )


@query(
    "mod09_composite_score",
    sql(
        "trial",
        f"""SELECT subject, epoch, {r("""-coalesce(x_change, 0) / 20 - coalesce(y_change, 0) / 12 - 0.4::DOUBLE * coalesce(x - 3, 0) / 10 - 0.3::DOUBLE * coalesce(greatest(0, 440 + y - 450), 0) / 30
            - 0.5::DOUBLE * CASE WHEN y IS NULL OR y_base IS NULL THEN 0 ELSE greatest(0, y / greatest(1, y_base) - 1) END""")} AS score FROM trial""",
    ),
)
def _(spark, d):
    """Weighted score of measured changes and levels; a subject without a baseline has no change and keeps its rows."""
    from epochwise.plans.trial import trial_log

    rise = models.rise_over(F.col("y"), F.col("y_base"), 1.0)
    high = models.above(440.0 + F.col("y"), 450.0)
    parts = [(F.col("x_change"), -1.0, 20.0), (F.col("y_change"), -1.0, 12.0), (F.col("x") - 3.0, -0.4, 10.0), (high, -0.3, 30.0), (rise, -0.5, 1.0)]
    return trial_log(spark, d).select("subject", "epoch", rnd(models.weighted_score(parts)).alias("score"))


@query(
    "mod10_risk_curve_fit",
    sql(
        "cohort_cust obs_orders",
        f""", {_KIN}{_COV}, s AS (SELECT subject, first(female) AS female, first(age_z) AS age_z, first(comorbidity_z) AS cz FROM cov GROUP BY subject),
        sh AS (SELECT 'cough' AS term, avg(0.45::DOUBLE * female + 0.1::DOUBLE * age_z) AS shift FROM s UNION ALL SELECT 'headache', avg(0.35::DOUBLE * female - 0.1::DOUBLE * age_z + 0.12::DOUBLE * cz) FROM s),
        u AS (SELECT dose, exposure_ratio AS v, row_number() OVER (PARTITION BY dose ORDER BY exposure_ratio) AS i, count(*) OVER (PARTITION BY dose) AS n FROM expo WHERE epoch > 0),
        md AS (SELECT dose, v AS ratio FROM u WHERE i = n // 2 + 1),
        t AS (SELECT term, CASE dose WHEN 0 THEN a WHEN 50 THEN b ELSE c END AS incidence, ratio FROM md, (VALUES ('cough', 0.05::DOUBLE, 0.12::DOUBLE, 0.3::DOUBLE), ('headache', 0.0::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE)) w(term, a, b, c)),
        tol AS (SELECT 0.25::DOUBLE * sum(exp(-e / 2.0::DOUBLE)) / 8 AS tol FROM range(1, 9) g(e)),
        h AS (SELECT term, ratio, CASE WHEN incidence <= 0 THEN 1e-9 ELSE 1 - pow(1 - incidence, 1 / 8.0::DOUBLE) END AS h FROM t),
        y AS (SELECT h.term, ln(1 + ratio) AS x, ln(h / (1 - h)) - shift - tol AS y FROM h JOIN sh ON sh.term = h.term, tol)
        SELECT term, {r('regr_slope(y, x)', 5)} AS slope, {r('regr_intercept(y, x)', 5)} AS intercept FROM y GROUP BY term""",
    ),
)
def _(spark, d):
    rows = kinetic(spark, d)
    shift = models.covariate_shift(subjects(spark, d).join(rows.select("subject").distinct(), "subject"), {t["term"]: t["coefficients"] for t in TERMS[:2]}, covariates())
    mid = ranks.order_statistics(rows.where("epoch > 0"), "exposure_ratio", {"ratio": F.floor(F.col("n") / 2) + 1}, ["dose"])
    targets = {"cough": (0.05, 0.12, 0.3), "headache": (0.0, 0.1, 0.2)}
    entries = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), *[F.lit(x).alias(f"i{i}") for i, x in enumerate(xs)]) for t, xs in targets.items()]))
    points = mid.select("ratio", "dose", entries.alias("t")).select(
        "t.term", "ratio", F.when(F.col("dose") == 0, F.col("t.i0")).when(F.col("dose") == 50, F.col("t.i1")).otherwise(F.col("t.i2")).alias("incidence")
    )
    return rounded(models.risk_curves(points.join(shift, "term"), 8), ["slope", "intercept"], 5)


@query(
    "mod11_relatedness",
    sql("ae_events", "SELECT ae_id, CASE WHEN p > 0.25 THEN 'probable' WHEN p > 0.08 THEN 'possible' ELSE 'unlikely' END AS relatedness, source <> 'llm' AND grade >= 3 AS serious FROM ae_events"),
)
def _(spark, d):
    e = v.ae_events(spark, d)
    return e.select("ae_id", models.relatedness(F.col("p")).alias("relatedness"), models.serious_event(F.col("source") != "llm", F.col("grade")).alias("serious"))


@query(
    "mod12_egfr",
    sql(
        "cohort_cust",
        f"""SELECT subject, {r('''least(160, greatest(5, 142 * CASE WHEN sex = 'F' THEN pow(least(creatinine / 0.7::DOUBLE, 1), -0.241::DOUBLE) * pow(greatest(creatinine / 0.7::DOUBLE, 1), -1.2::DOUBLE) * 1.012::DOUBLE
        ELSE pow(least(creatinine / 0.9::DOUBLE, 1), -0.302::DOUBLE) * pow(greatest(creatinine / 0.9::DOUBLE, 1), -1.2::DOUBLE) END * pow(0.9938::DOUBLE, age)))''')} AS egfr FROM cohort_cust""",
    ),
)
def _(spark, d):
    return v.cohort_cust(spark, d).select("subject", rnd(models.egfr(F.col("creatinine"), F.col("age"), F.col("sex"))).alias("egfr"))


# --- pandas maps ---------------------------------------------------------------------
_SITE_SCHEMA = StructType().add("site", LongType()).add("rows", LongType()).add("total", DoubleType())


def _site_totals(pdf: pd.DataFrame) -> pd.DataFrame:
    if pdf["site"].iloc[0] == 3:
        raise RuntimeError("site is closed")
    return pd.DataFrame([{"site": int(pdf["site"].iloc[0]), "rows": len(pdf), "total": float(pdf["y"].sum())}])


@query(
    "udf01_grouped_map",
    sql("obs_events", f"SELECT CAST(site AS BIGINT) AS site, CASE WHEN site = 3 THEN -1 ELSE count(*) END AS rows, CASE WHEN site = 3 THEN -1.0 ELSE {r('sum(y)', 2)} END AS total, site = 3 AS failed FROM obs_events GROUP BY site"),
)
def _(spark, d):
    log = v.obs_events(spark, d).select(F.col("site").cast("bigint").alias("site"), "subject", "y")
    # a site may be large: each is mapped in 16 hash pieces and the pieces are summed
    m = grouped.grouped_map(log, "site", _site_totals, _SITE_SCHEMA, part="subject", parts=16)
    g = m.groupBy("site").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"), F.bool_or(F.col("failure") != "").alias("failed"))
    return g.select("site", F.coalesce("rows", F.lit(-1)).alias("rows"), F.coalesce(rnd(F.col("total"), 2), F.lit(-1.0)).alias("total"), "failed")


def _site_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    if (pdf["subject"] % 211 == 5).any():
        raise ValueError("withheld subject")
    return pd.DataFrame([{"site": int(pdf["site"].iloc[0]), "rows": len(pdf), "total": float(pdf["y"].sum())}])


@query(
    "udf01_combined_map",
    sql(
        "obs_events",
        f"""SELECT CAST(CASE WHEN epoch % 3 = 0 THEN 0 ELSE site END AS BIGINT) AS site, CAST(count(*) FILTER (WHERE subject % 211 <> 5) AS BIGINT) AS rows,
        {r('sum(y) FILTER (WHERE subject % 211 <> 5)', 2)} AS total, count(*) FILTER (WHERE subject % 211 = 5) AS failed_rows FROM obs_events GROUP BY 1""",
    ),
)
def _(spark, d):
    # site 0 also holds a third of all epochs; single rows of it fail
    site = F.when(F.col("epoch") % 3 == 0, 0).otherwise(F.col("site")).cast("bigint")
    log = v.obs_events(spark, d).select(site.alias("site"), "subject", "y")
    out = grouped.combined_map(log, "site", _site_sums, _SITE_SCHEMA, {"rows": F.sum, "total": F.sum})
    return out.select("site", "rows", rnd(F.col("total"), 2).alias("total"), "failed_rows")


_BAND_SCHEMA = StructType().add("subject", LongType()).add("epoch", LongType()).add("band", StringType())


def _bands(pdf: pd.DataFrame) -> pd.DataFrame:
    band = pd.cut(pdf["y"], [-1, 10, 50, 1e12], labels=["low", "mid", "high"]).astype(str)
    return pdf[["subject", "epoch"]].assign(band=band)


@query(
    "udf02_batch_map",
    sql("obs_events", "SELECT subject, CAST(epoch AS BIGINT) AS epoch, CASE WHEN y <= 10 THEN 'low' WHEN y <= 50 THEN 'mid' ELSE 'high' END AS band FROM obs_events"),
)
def _(spark, d):
    log = v.obs_events(spark, d).select("subject", F.col("epoch").cast("bigint").alias("epoch"), "y")
    return grouped.results(grouped.batch_map(log, _bands, _BAND_SCHEMA))
