"""Exposure from each subject's kinetics, and what reads it, against plain Python dose by dose."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from epochwise.functions import coerce, kinetics
from epochwise.operators import models
from epochwise.plans import modelling, registry
from epochwise.plans import views as v

SF = "/root/testdata/sf0.001"
TAU, KA, EC50 = 12.0, 1.1, 0.9
METABOLISM = {"PM": 1.35, "IM": 1.175, "NM": 1.0, "UM": 0.825}


def exposure(c, epoch, dose):
    """(trough, peak, average, ratio, AUC) of ``epoch`` equal doses, added up one by one."""
    if dose <= 0 or epoch <= 0:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    weight = max(30.0, c["weight"])
    age = min(1.15, max(0.55, 1 - 0.008 * max(0.0, c["age"] - 40)))
    routes = 0.4 * min(1.25, max(0.35, c["egfr"] / 100)) + 0.5 * METABOLISM[c["cyp2d6"]] + 0.1
    cl = max(0.05, 4.0 * weight * 60 / 1000 * routes * age * (0.9 if c["sex"] == "F" else 1.0))
    vol = max(5.0, 1.2 * weight * (1 + 0.1 * (c["bmi"] - 25) / 25))
    ke = cl / vol
    level = lambda t: sum(0.7 * dose * KA / (vol * (KA - ke)) * (math.exp(-ke * (t + i * TAU)) - math.exp(-KA * (t + i * TAU))) for i in range(epoch))
    auc = 0.7 * dose / cl
    return level(0.0), level(math.log(KA / ke) / (KA - ke)), auc / TAU, auc / TAU / EC50, auc


@pytest.fixture(scope="module")
def rows(spark):
    """Per (subject, epoch): the subject's covariates with epoch, dose and exposure of the row."""
    cohort = {r.subject: r.asDict() for r in v.cohort_cust(spark, SF).withColumn("n", F.size(coerce.to_list("conditions_text"))).collect()}
    out = {}
    for r in modelling.doses(spark, SF).collect():
        c = cohort[r.subject]
        trough, peak, average, ratio, auc = exposure(c, r.epoch, r.dose)
        out[r.subject, r.epoch] = c | {"epoch": r.epoch, "dose": r.dose, "trough": trough, "peak": peak, "average": average, "ratio": ratio, "auc": auc}
    assert {r["dose"] for r in out.values()} == {0.0, 50.0, 100.0} and max(k[1] for k in out) > 8
    return out


def test_exposure_adds_up_dose_by_dose(spark, rows):
    got = modelling.kinetic(spark, SF).collect()
    assert {(r.subject, r.epoch) for r in got} == set(rows)
    for r in got:
        want = rows[r.subject, r.epoch]
        assert (r.c_trough, r.c_peak, r.c_avg, r.exposure_ratio, r.auc) == pytest.approx([want[k] for k in ("trough", "peak", "average", "ratio", "auc")], rel=1e-9)
        assert r.cumulative_auc == pytest.approx(sum(w["auc"] for (s, e), w in rows.items() if s == r.subject and e <= r.epoch))


def test_equal_rates_and_missing_kidney_function(spark):
    """Absorption as fast as elimination stays finite; a missing filtration rate counts as the lowest."""
    at = models.kinetic_exposure(spark.sql("SELECT 1L AS subject, 1 AS epoch, 50.0D AS dose, 11.0D AS cl, 10.0D AS vol, 1.1D AS ke"), kinetics.Drug(), TAU).first()
    assert at.c_trough == pytest.approx(0.0) and at.t_max == 0.0 and math.isfinite(at.exposure_ratio)
    subject = "SELECT 70.0D AS weight, 50.0D AS age, 'M' AS sex, 24.0D AS bmi, 1.0D AS metabolism, CAST({} AS double) AS egfr"
    low, missing = (models.kinetic_parameters(spark.sql(subject.format(x)), kinetics.Drug()).first().cl for x in ("35.0", "NULL"))
    assert low == missing


def z(r):
    return {
        "female": float(r["sex"] == "F"), "age_z": (r["age"] - 55) / 12, "bmi_z": (r["bmi"] - 27) / 5, "comorbidity_z": (r["n"] - 2) / 1.5,
        "hla_b": float(r["hla_b"]), "slco1b1": float(r["slco1b1"]),
    }


def test_risk_follows_the_exposure_of_each_row(spark, rows):
    """three terms on every row; clearance counts, and an undosed epoch has the risk of no exposure whatever was given before."""
    want = {}
    for (s, e), r in rows.items():
        for t in modelling.TERMS:
            x = t["intercept"] + t["slope"] * math.log1p(r["ratio"]) + 0.25 * math.exp(-e / 2.0)
            x += sum(coef * z(r).get(name, 0.0) for name, coef in t["coefficients"].items())
            want[s, e, t["term"]] = 1 / (1 + math.exp(-x))
    got = {(r.subject, r.epoch, r.term): r.p for r in registry.QUERIES["mod04_risk_scores"](spark, SF).collect()}
    assert got == pytest.approx(want, abs=1e-7)


def test_a_row_without_an_epoch_has_no_known_risk(spark):
    """it is kept, with a null, and not taken as the baseline epoch."""
    rows = spark.createDataFrame([(0, 0.0), (-1, 0.0), (None, 0.0)], "epoch int, exposure_ratio double")
    got = {r.epoch: r.p for r in models.risk_scores(rows, [{"term": "t", "intercept": -0.25, "slope": 1.0, "coefficients": {}}], {}, ["epoch"]).collect()}
    assert got == {0: 0.5, -1: 0.5, None: None}


def features(r):
    """The 14 features of a row."""
    return [
        1.0, math.log1p(r["ratio"]), min(r["ratio"], 20.0), (r["age"] - 55) / 12, (r["bmi"] - 27) / 5, (r["egfr"] - 90) / 20, (r["n"] - 2) / 1.5,
        float(r["sex"] == "F"), float(r["cyp2d6"] == "PM"), float(r["hla_b"]), r["epoch"] / 13, (r["sbp"] - 132) / 14, (r["alt"] - 26) / 12, float(r["smoking"] == "current"),
    ]


def test_features_hold_the_exposure_of_each_row(spark, rows):
    """the two exposure features come from the row's average concentration."""
    got = {(r.subject, r.epoch): [r[f"f{i}"] for i in range(14)] for r in registry.QUERIES["mod05_feature_vector"](spark, SF).collect()}
    assert set(got) == set(rows)
    for k, r in rows.items():
        assert got[k] == pytest.approx(features(r), abs=1e-6)


def target(r):
    return r["trough"] * 3 + r["age"] / 10


def test_gram_sums_hold_troughs_and_ratios(spark, rows):
    """all 120 sums of products of the features and the trough's target over all rows."""
    table = [[*features(r), target(r)] for r in rows.values()]
    got = {(r.i, r.j): r.s for r in registry.QUERIES["mod06_gram_sums"](spark, SF).collect()}
    want = {(i, j): math.fsum(x[i] * x[j] for x in table) for i in range(15) for j in range(i, 15)}
    assert got == pytest.approx(want, abs=1e-3)


def test_gram_sums_leave_out_missing_products_only(spark):
    """A missing value takes no other product of its row away; a column without values has no sums."""
    table = spark.createDataFrame([(1.0, 2.0, None, 3.0), (1.0, None, None, 5.0)], "a double, b double, c double, y double")
    got = {(r.i, r.j): r.s for r in models.gram_sums(table, ["a", "b", "c"], "y").collect()}
    assert got == {(0, 0): 2.0, (0, 1): 2.0, (0, 2): None, (0, 3): 8.0, (1, 1): 4.0, (1, 2): None, (1, 3): 6.0, (2, 2): None, (2, 3): None, (3, 3): 34.0}


def score(r):
    return sum(b * x for b, x in zip(modelling._BETA, features(r), strict=True))


def test_holdout_metrics_judge_the_trough(spark, rows):
    """both parts' figures for a target made of the trough, over all rows of a part."""
    parts = {True: [], False: []}
    for (s, e), r in rows.items():
        seed = int(hashlib.sha256(f"5|{s}|{e}".encode()).hexdigest()[:16], 16) % 2**63
        parts[seed / 2**63 < 0.2].append((target(r), score(r)))
    got = {r.holdout: (r.n, r.rmse, r.r2) for r in registry.QUERIES["mod07_holdout_metrics"](spark, SF).collect()}
    assert set(got) == set(parts)
    for part, pairs in parts.items():
        mean, miss = sum(y for y, _ in pairs) / len(pairs), sum((y - p) ** 2 for y, p in pairs)
        assert got[part] == pytest.approx((len(pairs), math.sqrt(miss / len(pairs)), 1 - miss / sum((y - mean) ** 2 for y, _ in pairs)), abs=1e-6)


def test_linear_scores_weigh_the_exposure_of_each_row(spark, rows):
    """the weighted features of every row; a missing or ill-sized vector scores 0."""
    got = {(r.subject, r.epoch): (r.score, r.missing, r.ill_sized) for r in registry.QUERIES["mod08_linear_scores"](spark, SF).collect()}
    assert set(got) == set(rows)
    for k, r in rows.items():
        assert got[k] == pytest.approx((score(r), 0.0, 0.0), abs=1e-6)


def test_risk_curves_start_without_exposure(spark, rows):
    """least squares through the median ratio of each dose, which is 0 without a dose; covariate shifts over all subjects with rows."""
    ratio = {}
    for dose in (0.0, 50.0, 100.0):
        own = sorted(r["ratio"] for r in rows.values() if r["dose"] == dose and r["epoch"] > 0)
        ratio[dose] = own[len(own) // 2]
    assert ratio[0.0] == 0.0 < ratio[50.0] < ratio[100.0]
    people = {s: r for (s, _), r in rows.items()}.values()
    early = 0.25 * sum(math.exp(-e / 2.0) for e in range(1, 9)) / 8
    got = {r.term: (r.slope, r.intercept) for r in registry.QUERIES["mod10_risk_curve_fit"](spark, SF).collect()}
    for t, incidences in (("cough", (0.05, 0.12, 0.3)), ("headache", (0.0, 0.1, 0.2))):
        coefficients = next(x["coefficients"] for x in modelling.TERMS if x["term"] == t)
        shift = sum(c * z(r)[name] for r in people for name, c in coefficients.items()) / len(people)
        hazards = [1e-9 if i <= 0 else 1 - (1 - i) ** (1 / 8) for i in incidences]
        x, y = [math.log1p(ratio[d]) for d in sorted(ratio)], [math.log(h / (1 - h)) - shift - early for h in hazards]
        mx, my = sum(x) / 3, sum(y) / 3
        slope = sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / sum((a - mx) ** 2 for a in x)
        assert got.pop(t) == pytest.approx((slope, my - slope * mx), abs=1e-5)
    assert not got
