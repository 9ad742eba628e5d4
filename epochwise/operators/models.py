"""Feature columns, risk scoring and linear models as Spark aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

from epochwise.functions import kinetics as kin
from epochwise.functions.hashing import uniform
from epochwise.functions.numbers import clip
from epochwise.operators.longitudinal import cumulative

# Reference mean and standard deviation per covariate.
REFERENCE = {
    "age": (55.0, 12.0),
    "bmi": (27.0, 5.0),
    "egfr": (90.0, 20.0),
    "comorbidity": (2.0, 1.5),
    "sbp": (132.0, 14.0),
    "alt": (26.0, 12.0),
}
RATIO_CAP = 20.0
# Extra early risk and its decay.
EARLY_RISK, EARLY_EPOCHS = 0.25, 2.0
# Relatedness bands.
PROBABLE_ABOVE, POSSIBLE_ABOVE = 0.25, 0.08


def z_score(value: Column, name: str) -> Column:
    mean, sd = REFERENCE[name]
    return (value - mean) / sd


def dosing_summary(log: DataFrame, subject="subject", epoch="epoch", dose="dose") -> DataFrame:
    """Recorded dosing per subject from one aggregate: dosed epochs, total dose, first and last dosed epoch, mean distance."""
    dosed = F.col(dose) > 0
    n = F.count(F.when(dosed, 1))
    first, last = F.min(F.when(dosed, F.col(epoch))), F.max(F.when(dosed, F.col(epoch)))
    return log.groupBy(subject).agg(
        n.alias("n_dosed"),
        F.coalesce(F.sum(F.when(dosed, F.col(dose))), F.lit(0.0)).alias("total_dose"),
        first.alias("first_dosed"),
        last.alias("last_dosed"),
        F.try_divide(last - first, n - 1).alias("mean_interval"),
    )


def exposure_features(rows: DataFrame, subject="subject", epoch="epoch", dose="dose", weight="weight") -> DataFrame:
    """Recorded exposure up to each row: dose per kg, cumulative and mean dose, and the mean dose per kg as ``exposure_ratio``.

    Rows are one per subject and epoch, so the window holds a subject's epochs only.
    """
    upto = W.partitionBy(subject).orderBy(epoch).rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("dose_per_kg", F.try_divide(F.col(dose), F.col(weight)))
    return out.withColumns(
        {
            "cumulative_dose": F.sum(dose).over(upto),
            "mean_dose": F.avg(dose).over(upto),
            "exposure_ratio": F.avg("dose_per_kg").over(upto),
        }
    )


def exposure_course(rows: DataFrame, subject="subject", epoch="epoch", dose="dose") -> DataFrame:
    """Add to rows of ``exposure_features`` the course of a subject's doses up to each row: dosed epochs, highest and lowest dose
    per kg of the dosed epochs (0 before the first) and epochs since the last dosed one (-1 before the first)."""
    upto = W.partitionBy(subject).orderBy(epoch).rowsBetween(W.unboundedPreceding, 0)
    dosed = F.col(dose) > 0
    given = F.when(dosed, F.col("dose_per_kg"))
    return rows.withColumns(
        {
            "n_dosed": F.count(F.when(dosed, 1)).over(upto),
            "peak_dose_per_kg": F.coalesce(F.max(given).over(upto), F.lit(0.0)),
            "trough_dose_per_kg": F.coalesce(F.min(given).over(upto), F.lit(0.0)),
            "since_dose": F.coalesce(F.col(epoch) - F.max(F.when(dosed, F.col(epoch))).over(upto), F.lit(-1)),
        }
    )


def kinetic_parameters(cohort: DataFrame, drug: kin.Drug) -> DataFrame:
    """Add clearance, volume and elimination rate per subject."""
    cl = kin.clearance(drug, F.col("weight"), F.col("age"), F.col("sex"), F.col("egfr"), F.col("metabolism"))
    out = cohort.withColumns({"cl": cl, "vol": kin.volume(drug, F.col("weight"), F.col("bmi"))})
    return out.withColumn("ke", F.col("cl") / F.col("vol"))


def kinetic_exposure(rows: DataFrame, drug: kin.Drug, tau: float) -> DataFrame:
    """Exposure of the recorded dose per subject-epoch from the subject's own kinetics; rows carry dose, epoch, cl, vol and ke.

    Concentrations are those after ``epoch`` doses of the row's size, ``tau`` hours apart; without a dose and at the baseline
    epoch all are 0.  ``exposure_ratio`` is the average concentration over the half-effective one.
    """
    dosed = (F.col("dose") > 0) & (F.col("epoch") > 0)
    on = lambda c: F.when(dosed, c).otherwise(0.0)
    level = lambda t: kin.concentration(drug, F.col("dose"), F.col("vol"), F.col("ke"), t, F.col("epoch"), tau)
    out = rows.withColumns({"t_max": on(kin.time_to_peak(drug, F.col("ke"))), "auc": on(drug.bioavailability * F.col("dose") / F.col("cl"))})
    average = F.col("auc") / tau
    made = {
        "c_trough": on(level(F.lit(0.0))),
        "c_peak": on(level(F.col("t_max"))),
        "c_avg": average,
        "exposure_ratio": average / drug.ec50_mg_l,
    }
    return cumulative(out.withColumns(made), "auc", "cumulative_auc")


def level_effects(rows: DataFrame, measure: str, subject="subject", epoch="epoch", dose="dose") -> DataFrame:
    """Every row with its measured dose effect: (subject, epoch, dose, effect, best_dose, best_effect).

    ``effect`` is the mean measure at the row's dose less that of the subject's undosed epochs, hence 0 on undosed rows; null
    without an undosed epoch.  ``best_dose`` has the highest mean measure, the lower dose wins a tie; null without a dosed epoch.
    """
    own = W.partitionBy(subject)
    level = F.avg(measure).over(W.partitionBy(subject, dose))
    out = rows.select(subject, epoch, dose, level.alias("_m"))
    none = F.max(F.when(F.col(dose) == 0, F.col("_m"))).over(own)
    best = F.max(F.when(F.col(dose) > 0, F.struct(F.col("_m").alias("m"), (-F.col(dose)).alias("neg")))).over(own)
    out = out.select(subject, epoch, dose, "_m", none.alias("_none"), best.alias("_best"))
    return out.select(
        subject, epoch, dose, (F.col("_m") - F.col("_none")).alias("effect"), (-F.col("_best.neg")).alias("best_dose"), (F.col("_best.m") - F.col("_none")).alias("best_effect")
    )


def sigmoid(x: Column) -> Column:
    """Logistic function that never overflows."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def risk_scores(rows: DataFrame, terms: list[dict], covariates: dict[str, Column], keys: list[str]) -> DataFrame:
    """Probability per row and term from a coefficient table.

    ``terms`` is protocol text (term, intercept, slope, coefficients), so the
    scores are an array of literal-coefficient expressions: one pass over the
    rows, no join and no shuffle.
    """
    # a row without an epoch has no known risk
    early = F.when(F.col("epoch").isNotNull(), EARLY_RISK * F.exp(-F.greatest(F.lit(0), F.col("epoch")) / EARLY_EPOCHS))
    dose_part = F.log1p(F.greatest(F.lit(0.0), F.col("exposure_ratio")))
    entries = []
    for t in terms:
        logit = F.lit(float(t["intercept"])) + float(t["slope"]) * dose_part + early
        for name, coef in t["coefficients"].items():
            if name in covariates:
                logit = logit + float(coef) * covariates[name]
        entries.append(F.struct(F.lit(t["term"]).alias("term"), sigmoid(logit).alias("p")))
    return rows.select(*keys, F.explode(F.array(*entries)).alias("r")).select(*keys, "r.term", "r.p")


def feature_vector(epochs_total: int) -> list[Column]:
    """The 14 standardised features, in order."""
    ratio = F.col("exposure_ratio")
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        F.lit(1.0),
        F.log1p(F.greatest(F.lit(0.0), ratio)),
        F.least(ratio, F.lit(RATIO_CAP)),
        z_score(F.col("age"), "age"),
        z_score(F.col("bmi"), "bmi"),
        z_score(F.col("egfr"), "egfr"),
        z_score(F.col("n_conditions"), "comorbidity"),
        one(F.col("sex") == "F"),
        one(F.col("cyp2d6") == "PM"),
        one(F.col("hla_b")),
        F.col("epoch") / F.lit(float(max(1, epochs_total))),
        z_score(F.col("sbp"), "sbp"),
        z_score(F.col("alt"), "alt"),
        one(F.col("smoking") == "current"),
    ]


def gram_sums(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """Sums of products of all feature and target pairs: (i, j, s) with i <= j.

    The target has the last index.  Each task multiplies its Arrow batches and
    emits one small matrix, so the shuffle carries tasks x features^2 numbers.
    A row counts in every product whose two values it has; without one, the sum is null.
    """
    names = [*features, target]
    k = len(names)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((k, k)), np.zeros((k, k))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            known = ~np.isnan(x)
            x = np.where(known, x, 0.0)
            total += x.T @ x
            count += known.T.astype(float) @ known.astype(float)
        i, j = np.triu_indices(k)
        yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "s": total[i, j], "n": count[i, j].astype("int64")})

    schema = StructType().add("i", IntegerType()).add("j", IntegerType()).add("s", DoubleType()).add("n", LongType())
    columns = [F.col(c).cast("double").alias(c) for c in names]
    sums = rows.select(*columns).mapInPandas(partial, schema).groupBy("i", "j")
    return sums.agg(F.when(F.sum("n") > 0, F.sum("s")).alias("s"))


#: Groups in which the triangles of tasks are merged before the last merge.
TRIANGLE_GROUPS = 256


def triangle(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """One row (r, used, dropped): the triangular factor of the table [features, target], row by row, and row counts.

    Tall-skinny QR: a task folds each Arrow batch into its own triangle, triangles are merged in TRIANGLE_GROUPS groups and
    then in one, so no task holds more than tasks / TRIANGLE_GROUPS small matrices and products, which square the
    condition number, are never formed.  Rows with a null, NaN or infinite value are left out and counted.
    """
    names = [*features, target]
    k = len(names)

    def fold(parts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((k, k))
        r = np.linalg.qr(np.concatenate(parts), mode="r")
        out[: len(r)] = r
        return out

    def table(group, r, used, dropped):
        return pa.table({"group": pa.array([group], pa.int32()), "r": pa.array([r.ravel().tolist()], pa.list_(pa.float64())), "used": [int(used)], "dropped": [int(dropped)]})

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, used, dropped = np.zeros((k, k)), 0, 0
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            good = np.isfinite(x).all(axis=1)
            used, dropped = used + int(good.sum()), dropped + int((~good).sum())
            r = fold([r, x[good]])
        yield from table(TaskContext.get().partitionId() % TRIANGLE_GROUPS, r, used, dropped).to_batches()

    def merge(t: pa.Table) -> pa.Table:
        parts = [np.reshape(r, (k, k)) for r in t.column("r").to_pylist()]
        return table(0, fold(parts), sum(t.column("used").to_pylist()), sum(t.column("dropped").to_pylist()))

    schema = "group int, r array<double>, used long, dropped long"
    out = rows.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(partial, schema)
    return out.groupBy("group").applyInArrow(merge, schema).groupBy("group").applyInArrow(merge, schema).drop("group")


def ridge_solution(r: list[float] | np.ndarray, k: int, alpha: float = 1.0) -> list[float]:
    """Coefficients of ``k`` features from the triangle of [features, target]; the first one, the bias, is not penalised."""
    r = np.reshape(r, (k + 1, k + 1))
    penalty = np.sqrt(alpha) * np.eye(k)[1:]
    stacked = np.concatenate([r[:, :k], penalty])
    return [float(x) for x in np.linalg.lstsq(stacked, np.concatenate([r[:, k], np.zeros(k - 1)]), rcond=None)[0]]


def ridge_fit(rows: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> list[float]:
    """Ridge coefficients; only the merged triangle reaches the driver.  An empty table gives zeros."""
    found = triangle(rows, features, target).first()
    return ridge_solution(found["r"], len(features), alpha) if found else [0.0] * len(features)


def split_holdout(rows: DataFrame, seed: str, key: list[str], fraction: float = 0.2) -> DataFrame:
    """Add ``holdout`` by a seeded draw on the row key."""
    return rows.withColumn("holdout", uniform(seed, *[F.col(k) for k in key]) < fraction)


def fit_metrics(rows: DataFrame, target: str, predicted: str, by: list[str]) -> DataFrame:
    """n, RMSE and R-squared; R-squared is 0 without spread in the target."""
    miss = F.col(target) - F.col(predicted)
    total = F.var_pop(target) * F.count(target)
    return rows.groupBy(*by).agg(
        F.count(target).alias("n"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        F.when(total > 0, 1.0 - F.sum(miss * miss) / total).otherwise(0.0).alias("r2"),
    )


def linear_score(features: Column, beta: list[float] | None, width: int) -> Column:
    """Dot product with the coefficients; 0 for a missing or ill-sized vector."""
    if beta is None or len(beta) != width:
        return F.lit(0.0)
    weights = F.array(*[F.lit(float(b)) for b in beta])
    dot = F.aggregate(F.zip_with(features, weights, lambda x, b: x * b), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(features) == width, dot).otherwise(0.0)


def above(value: Column, limit: float) -> Column:
    """How far a value lies above its limit, 0 below it; null where it is missing."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), value - limit))


def rise_over(value: Column, base: Column, least: float) -> Column:
    """Relative rise over the baseline, taken as ``least`` at least, so a baseline of zero is no division by zero; null where either is missing."""
    return F.when(base.isNotNull(), above(value / F.greatest(F.lit(least), base), 1.0))


def weighted_score(parts: list[tuple[Column, float, float]]) -> Column:
    """Sum of weight * value / scale over (value, weight, scale); a missing value counts as no change, so no row is lost."""
    total = F.lit(0.0)
    for value, weight, scale in parts:
        total = total + float(weight) * F.coalesce(value, F.lit(0.0)) / float(scale)
    return total


def relatedness(p: Column) -> Column:
    return F.when(p > PROBABLE_ABOVE, "probable").when(p > POSSIBLE_ABOVE, "possible").otherwise("unlikely")


def serious_event(flagged: Column, grade: Column) -> Column:
    return flagged & (grade >= 3)


# Kidney-function formula by sex.
EGFR_KAPPA = {"F": 0.7, "M": 0.9}
EGFR_ALPHA = {"F": -0.241, "M": -0.302}
EGFR_SCALE, EGFR_HIGH_POWER, EGFR_AGE_BASE, EGFR_FEMALE, EGFR_RANGE = 142.0, -1.200, 0.9938, 1.012, (5.0, 160.0)


def egfr(creatinine: Column, age: Column, sex: Column) -> Column:
    """Estimated filtration rate without measurement noise."""
    female = sex == "F"
    x = creatinine / F.when(female, EGFR_KAPPA["F"]).otherwise(EGFR_KAPPA["M"])
    one = F.lit(1.0)
    low = F.pow(F.least(x, one), F.when(female, EGFR_ALPHA["F"]).otherwise(EGFR_ALPHA["M"]))
    high = F.pow(F.greatest(x, one), F.lit(EGFR_HIGH_POWER))
    return clip(EGFR_SCALE * low * high * F.pow(F.lit(EGFR_AGE_BASE), age) * F.when(female, EGFR_FEMALE).otherwise(1.0), *EGFR_RANGE)


def risk_curves(points: DataFrame, epochs: int, shift: str = "shift") -> DataFrame:
    """Intercept and exposure slope per term from target incidences.

    ``points`` has term, exposure ratio, target cumulative incidence and the
    term's mean covariate shift.  The incidence becomes a per-epoch hazard, its
    logit is fitted on log1p(ratio) by least squares.
    """
    tolerance = EARLY_RISK * F.aggregate(
        F.transform(F.sequence(F.lit(1), F.lit(epochs)), lambda e: F.exp(-e / EARLY_EPOCHS)), F.lit(0.0), lambda a, x: a + x
    ) / epochs
    c = F.col("incidence")
    hazard = F.when(c <= 0, 1e-9).otherwise(clip(1.0 - F.pow(1.0 - F.least(F.lit(0.999), c), F.lit(1.0 / epochs)), 1e-9, 0.999))
    y = F.ln(hazard / (1.0 - hazard)) - F.col(shift) - tolerance
    g = points.select("term", F.log1p("ratio").alias("x"), y.alias("y")).groupBy("term")
    spread = F.max("x") - F.min("x") >= 1e-9
    fits = g.agg(
        F.when(spread, F.regr_slope("y", "x")).otherwise(0.0).alias("slope"),
        F.when(spread, F.regr_intercept("y", "x")).otherwise(F.min_by("y", "x")).alias("intercept"),
    )
    return fits


def covariate_shift(rows: DataFrame, coefficients: dict[str, dict[str, float]], covariates: dict[str, Column]) -> DataFrame:
    """Mean covariate contribution per term over the cohort, in one aggregate row."""
    aggs = []
    for term, coefs in coefficients.items():
        total = F.lit(0.0)
        for name, coef in coefs.items():
            if name in covariates:
                total = total + float(coef) * covariates[name]
        aggs.append(F.avg(total).alias(term))
    return rows.agg(*aggs).unpivot([], list(coefficients), "term", "shift")
