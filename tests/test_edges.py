"""Edge rows: missing baselines, damaged text, empty arms, cycles, versions."""

import hashlib
import json
import shutil

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from epochwise import session
from epochwise.functions import coerce, hashing, text
from epochwise.operators import allocation, compare, contract, events, graph, grouped, joins, longitudinal, readout, safety, screening, telemetry
from epochwise.sources import tables, versions


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


# --- casts -----------------------------------------------------------------
def test_tolerant_casts(spark):
    df = spark.createDataFrame([("NaN", "YES"), (None, None), (" 41 ", "0"), ("x", "t")], "a string, b string")
    got = df.select(coerce.to_double(F.col("a"), 55.0).alias("a"), coerce.to_bool(F.col("b")).alias("b")).collect()
    assert [r.a for r in got] == [55.0, 55.0, 41.0, 55.0]
    assert [r.b for r in got] == [True, False, False, True]


@pytest.mark.parametrize("given,want", [(None, []), ("  ", []), ('["a", "b"]', ["a", "b"]), ("a, b,,", ["a", "b"]), ("42", ["42"]), ('"x, y"', ["x, y"]), ("[]", []), ("[broken", ["[broken"])])
def test_list_text(spark, given, want):
    df = spark.createDataFrame([(given,)], "t string")
    assert df.select(coerce.to_list(F.col("t")).alias("x")).first().x == want


def test_contract_orders_casts_and_fills(spark):
    df = spark.createDataFrame([("3", "p1", "oops")], "epoch string, patient_id string, sbp string")
    out = contract.enforce(df, contract.OBSERVATIONS)
    row = out.first()
    assert out.columns[:5] == ["observation_id", "sim_run_id", "protocol_id", "protocol_version", "patient_id"]
    assert len(out.columns) == 50 and row.epoch == 3 and row.sbp is None and row.cohort_id == ""
    assert len(contract.schema_of(contract.COHORT)) == 30 and len(contract.schema_of(contract.EVENTS)) == 12
    assert contract.empty(spark, contract.EVENTS).count() == 0


def test_seed_is_stable_and_uniform(spark):
    import hashlib

    digest = hashlib.sha256(b"7|abc|3").digest()
    want = int.from_bytes(digest[:8], "big") % 2**63
    row = spark.range(1).select(hashing.stable_seed("7", F.lit("abc"), F.lit(3)).alias("s"), hashing.uniform("7", F.lit("abc")).alias("u")).first()
    assert row.s == want and 0 <= row.u < 1
    mean = spark.range(4000).select(F.avg(hashing.uniform("1", F.col("id")))).first()[0]
    assert mean == pytest.approx(0.5, abs=0.02)


# --- sequences --------------------------------------------------------------
LOG = "subject int, arm string, epoch int, x double, worst_grade int, narrated boolean, intent string, dose double"


@pytest.fixture()
def log(spark):
    data = [
        (1, "a", 0, 10.0, 4, False, "continue", 0.0),  # grade 4 at epoch 0 does not stop
        (1, "a", 1, 12.0, 0, False, "discontinue", 50.0),  # intent without narration does not stop
        (1, "a", 2, 8.0, 4, False, "continue", 50.0),
        (1, "a", 3, 7.0, 5, True, "discontinue", 50.0),
        (2, "b", 1, 5.0, 0, True, "continue", 50.0),  # no baseline
        (2, "b", 2, 6.0, 0, True, "discontinue", 50.0),
        (3, "b", 0, 0.0, 0, False, "continue", 0.0),  # baseline 0
        (3, "b", 1, 3.0, 0, False, "continue", 50.0),
    ]
    return spark.createDataFrame(data, LOG)


def test_baseline_edges(log):
    c = {(r.subject, r.epoch): r for r in longitudinal.change_from_baseline(log, ["x"]).collect()}
    assert c[(1, 3)].x_change == -3.0 and c[(1, 3)].x_ratio == 0.7
    assert c[(2, 2)].x_change is None and c[(2, 2)].x_ratio is None
    assert c[(3, 1)].x_change == 3.0 and c[(3, 1)].x_ratio is None


def test_window_and_join_baselines_agree(log):
    w = longitudinal.change_from_baseline(log, ["x"]).select("subject", "epoch", "x_base")
    j = longitudinal.attach_baseline(log, log, ["x"]).select("subject", "epoch", "x_base")
    assert compare.symmetric_difference(w, j).count() == 0


def test_last_rows_keep_ties(spark):
    df = spark.createDataFrame([(1, 0), (1, 2), (1, 2), (2, 1)], "subject int, epoch int")
    assert rows_of(longitudinal.end_of_treatment(df), "subject", "epoch") == [(1, 2), (1, 2), (2, 1)]


def test_discontinuation(log):
    d = {(r.subject, r.epoch): r for r in longitudinal.propagate_discontinuation(log).collect()}
    assert [d[(1, e)].discontinued for e in range(4)] == [False, False, True, True]
    assert d[(1, 3)].discontinuation_reason == "CTCAE grade 4 adverse event"
    assert (d[(1, 2)].dose, d[(1, 3)].dose) == (50.0, 0.0)
    assert d[(2, 2)].discontinuation_reason == "patient withdrew consent after reported symptoms"
    assert not d[(3, 1)].discontinued


@pytest.mark.parametrize("direction,threshold,want", [("decrease", -2.0, [True, False, False]), ("increase", 2.0, [False, False, True]), ("two_sided", -2.0, [True, False, True])])
def test_responder_sides(spark, direction, threshold, want):
    df = spark.createDataFrame([(-3.0,), (0.0,), (2.0,)], "v double").coalesce(1)
    got = [r.r for r in df.select(longitudinal.responder(F.col("v"), F.lit(True), direction, threshold).alias("r")).collect()]
    assert got == want
    assert not df.select(longitudinal.responder(F.col("v"), F.lit(False), direction, threshold).alias("r")).where("r").count()


def test_sampling_budget(spark):
    df = spark.createDataFrame([(1, e, 5) for e in range(12)], "subject int, epoch int, worst_grade int")
    assert [r.epoch for r in longitudinal.sample_for_review(df, "1").orderBy("epoch").collect()] == [1, 2, 3, 4, 5, 6]
    assert longitudinal.sample_for_review(df, "1", mode="sample", rate=0.0).count() == 0


def test_dose_schedule(spark):
    arms = spark.createDataFrame(
        [("p", 0.0, None, None, None, True), ("h", 150.0, 3, 25.0, 200.0, False)], "arm string, base_dose double, start_epoch int, step double, max_dose double, is_control boolean"
    )
    log = spark.createDataFrame([("h", e) for e in range(7)] + [("p", 2)], "arm string, epoch int")
    out = {(r.arm, r.epoch): r for r in longitudinal.scheduled_dose(arms, log, 12.0).collect()}
    assert [out[("h", e)].planned_dose for e in range(7)] == [0.0, 150.0, 150.0, 175.0, 200.0, 200.0, 200.0]
    assert out[("h", 3)].instruction == "administer 175 mg ORAL" and out[("h", 3)].planned_time == 36.0
    assert out[("p", 2)].instruction == "withhold study drug (placebo arm)"


# --- screening and allocation --------------------------------------------------
def test_first_failing_reason_wins(spark):
    c = screening.Criteria(exclude=("bad",), require_any=("need",), exclude_markers=("m",))
    data = [
        (80.0, 10.0, 200.0, ["bad"], True, "age_out_of_range"),
        (50.0, 10.0, 200.0, ["bad"], True, "renal_impairment"),
        (50.0, 60.0, 200.0, ["bad"], True, "hepatic_impairment"),
        (50.0, 60.0, 20.0, ["bad"] * 6, True, "comorbidity_burden"),
        (50.0, 60.0, 20.0, ["bad", "need"], True, "excluded_condition"),
        (50.0, 60.0, 20.0, [], True, "required_condition_absent"),
        (50.0, 60.0, 20.0, ["need"], True, "excluded_genotype_m"),
        (75.0, 50.0, 90.0, ["need"], False, ""),
    ]
    df = spark.createDataFrame(data, "age double, egfr double, alt double, conditions array<string>, m boolean, want string")
    out = screening.screen(df, c)
    assert out.where("reason <> want").count() == 0
    summary = screening.screening_summary(out).first()
    assert (summary.screened, summary.enrolled, summary.screen_failures) == (8, 1, 7)
    assert json.loads(summary.failure_reasons)["renal_impairment"] == 1


def test_effective_block_and_quotas(spark):
    def slots(weights, size):
        return spark.range(1).select(allocation.quota_slots(weights, F.lit(size)).alias("a")).first()["a"]

    assert [allocation.effective_block(3, b) for b in (1, 4, 5, 6, 7, 8)] == [3, 3, 6, 6, 6, 9]
    w = {"a": 0.25, "b": 0.375, "c": 0.375}
    assert slots(w, 6) == ["a", "a", "b", "b", "c", "c"]
    assert [slots({"x": 1.0, "y": 1.0}, s) for s in (1, 2, 3)] == [["x"], ["x", "y"], ["x", "x", "y"]]


@pytest.mark.parametrize("ids_per_block", [7, 4096])
def test_permuted_blocks_are_balanced_and_stable(spark, ids_per_block):
    df = spark.createDataFrame([(i, "s1" if i % 3 else "s2") for i in range(200)], "subject int, g string")
    w = {"a": 1.0, "b": 1.0}
    out = allocation.permuted_blocks(df, w, ["g"], 4, "9", id_block=F.floor(F.col("subject") / ids_per_block)).cache()
    again = allocation.permuted_blocks(df.repartition(5), w, ["g"], 4, "9")
    assert compare.symmetric_difference(out.select("subject", "allocated_arm"), again.select("subject", "allocated_arm")).count() == 0
    audit = {(r.stratum, r.block_index, r.allocated_arm): r.n for r in allocation.balance_audit(out).collect()}
    assert all(n == 2 for (s, b, a), n in audit.items() if not (s == "s1" and b == 33) and not (s == "s2" and b == 16))
    assert sum(audit.values()) == 200


# --- safety ----------------------------------------------------------------------
def test_stopping_rules_cumulative_and_comparators(spark):
    log = spark.createDataFrame([(s, "a", e) for s in range(4) for e in range(3)] + [(9, "b", 0)], "subject int, arm string, epoch int")
    ev = spark.createDataFrame(
        [(0, "a", 0, 3, False), (0, "a", 2, 5, True), (1, "a", 1, 3, False)], "subject int, arm string, epoch int, grade int, serious boolean"
    )
    rules = [safety.Rule("ge", "grade3_plus_rate", 0.5), safety.Rule("gt", "grade3_plus_rate", 0.5, "greater_than", min_epoch=1, arms=("a",))]
    got = {(r.rule_id, r.arm, r.epoch): (r.observed, r.triggered, r.n_at_risk) for r in safety.stopping_rules(log, ev, rules).collect()}
    assert got[("ge", "a", 0)] == (0.25, False, 4) and got[("ge", "a", 1)] == (0.5, True, 4) and got[("gt", "a", 1)] == (0.5, False, 4)
    assert ("ge", "b", 1) not in got and ("gt", "b", 0) not in got and ("gt", "a", 0) not in got
    interim = safety.stopping_rules(log, ev, rules, upto=0)
    assert {r.epoch for r in interim.collect()} == {0}


def test_elevation_rule_includes_baseline_row(spark):
    log = spark.createDataFrame([(1, "a", 0, 50.0), (1, "a", 1, 160.0), (2, "a", 0, 60.0), (2, "a", 1, 100.0), (3, "a", 1, 900.0)], "subject int, arm string, epoch int, y double")
    ev = spark.createDataFrame([], "subject int, arm string, epoch int, grade int, serious boolean")
    rules = [safety.Rule("r", "alt_elevation_rate", 0.05)]
    got = {r.epoch: r.observed for r in safety.stopping_rules(log, ev, rules, elevated_measure="y").collect()}
    assert got == {0: 0.0, 1: pytest.approx(1 / 3)}


def test_safety_table_without_control_subjects(spark):
    ev = spark.createDataFrame([("t", "x", 1, 3, True, 0.2, "llm", None), ("t", None, 1, 1, False, 0.4, "model", "s")], "arm string, term string, subject int, grade int, serious boolean, p double, source string, soc string")
    eot = spark.createDataFrame([(1, "t"), (2, "t")], "subject int, arm string")
    rows = {r.term: r for r in safety.safety_table(ev, eot, "c").collect()}
    assert set(rows) == {"x", None}
    assert rows["x"].rate == 0.5 and rows["x"].p_value is None and rows["x"].q_value is None and rows["x"].rd_ci_low is None
    assert rows["x"].soc == "" and rows[None].soc == "s" and rows["x"].grade_distribution == '{"3":1}'


def test_single_subject_arm_has_zero_sd(spark):
    df = spark.createDataFrame([("a", 0, 4.0), ("b", 0, 1.0), ("b", 0, 3.0)], "arm string, epoch int, v double")
    got = {r.arm: (r.sd, r.low, r.high) for r in readout.trajectories(df, ["v"]).collect()}
    assert got["a"] == (0.0, 4.0, 4.0) and got["b"][0] == pytest.approx(2**0.5)


def test_trend_needs_two_doses(spark):
    one = spark.createDataFrame([("a", 5.0, 1.0)], "arm string, dose double, mean double")
    assert readout.with_dose_trend(one).first().trend_slope is None
    two = spark.createDataFrame([("a", 0.0, 1.0), ("b", 10.0, 3.0)], "arm string, dose double, mean double")
    row = readout.with_dose_trend(two).first()
    assert row.trend_slope == pytest.approx(0.2) and row.trend_r_squared == pytest.approx(1.0)


def test_degenerate_histogram(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double")
    assert [(r.bin, r.n, r["from"]) for r in readout.histogram(df, "v", 4).collect()] == [(0, 2, 2.0)]


def _verdict(spark, comparisons, fired):
    c = spark.createDataFrame(comparisons, "endpoint string, arm string, control_arm string, effect double, ci_low double, ci_high double, meets_mcid boolean")
    r = spark.createDataFrame([(fired,)], "triggered boolean")
    return readout.verdict(c, r, "main").first()


def test_verdicts(spark):
    rows = [("main", "a", "c", -2.0, -3.0, -1.0, True), ("main", "b", "c", 4.0, -1.0, 9.0, True), ("other", "a", "c", 9.0, 8.0, 10.0, True)]
    assert _verdict(spark, rows, True).verdict == "HOLD"
    got = _verdict(spark, rows, False)
    assert (got.verdict, got.arm, got.effect) == ("PROCEED", "a", -2.0)
    assert _verdict(spark, rows[1:2], False).verdict == "REVIEW"
    assert _verdict(spark, rows[2:], False).verdict == "PROCEED"  # no primary rows: all count


# --- events and text ----------------------------------------------------------------
@pytest.mark.parametrize("given,n", [(None, 0), ("[]", 0), ("[{broken", 0), ('{"term": "x"}', 0), ('["a", 3, {"term": "x"}]', 1), ('[{"term": "x"}] tail', 0), ('[{"term": "x"},{"term": "y"}]', 2)])
def test_event_json(spark, given, n):
    df = spark.createDataFrame([(given,)], "adverse_events_json string")
    assert events.explode_events(df).count() == n


def test_event_defaults(spark):
    df = spark.createDataFrame([('[{"term": "x", "ctcae_grade": "bad"}, {"ctcae_grade": 3.0, "serious": true, "predicted_probability": "0.5", "epoch": 2}]',)], "adverse_events_json string")
    a, b = sorted(events.explode_events(df).collect(), key=lambda r: r.ctcae_grade)
    assert (a.ctcae_grade, a.serious, a.predicted_probability) == (1, False, 0.0)
    assert (b.ctcae_grade, b.serious, b.predicted_probability, b.epoch) == (3, True, 0.5, 2)


ANSWERS = [
    ("plain", '{"symptoms": [{"term": "a", "ctcae_grade": 9}]}', [("a", 5)], ""),
    ("fenced", 'Sure:\n```json\n[{"symptom": "b", "grade": "severe"}]\n```', [("b", 3)], ""),
    ("comma", '{"symptoms": [{"name": "c",},],}', [("c", 1)], ""),
    ("quotes", "{'symptoms': [], 'note': 'ok'}", [], ""),
    ("python", "{'symptoms': [{'term': 'd', 'ctcae_grade': 2}], 'x': None}", [("d", 2)], ""),
    ("prose", 'I say {"term": "e", "grade": "about 4"} now', [("e", 4)], ""),
    ("advice", 'I RECOMMEND rest {"term": "e"}', [], "safety filter"),
    ("blank", " \n", [], "empty response"),
    ("nothing", "no json", [], "unparseable"),
    ("scalar", "42", [], "unparseable"),
    ("notlist", '{"symptoms": "many"}', [], "'symptoms' must be a list"),
    ("wrapped", '{"symptoms": {"term": "f", "ctcae_grade": true}}', [("f", 1)], ""),
    ("eight", json.dumps({"symptoms": ["s"] * 8}), [("s", 1)] * 5, ""),
    ("mixed", '[1, {"term": ""}, {"quote": "x"}, {"term": "g", "grade": null}]', [("g", 1)], ""),
]


def test_answers(spark):
    df = spark.createDataFrame([(k, t) for k, t, _, _ in ANSWERS], "k string, text string")
    found = {}
    for r in events.symptom_rows(df, "k").orderBy("k", "position").collect():
        found.setdefault(r.k, []).append((r.term, r.grade))
    status = {r.k: r.error for r in events.answer_status(df, "k").collect()}
    for k, _, want, error in ANSWERS:
        assert found.get(k, []) == want, k
        assert status[k] == error, k


@pytest.mark.parametrize("given,want", [("2.5", 2), ("3.5", 4), ("-4", 1), ("MILD", 1), ("life-threatening", 4), ("death", 5), ("grade 3", 3), ("zero", 1), (None, 1), ("NaN", 1)])
def test_grades(spark, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(text.coerce_grade(F.col("t")).alias("g")).first().g == want


def test_grades_by_json_type(spark):
    listing = '[{"term": "a", "grade": "10"}, {"term": "b", "grade": "0.5"}, {"term": "c", "grade": 10}, {"term": "d", "ctcae_grade": null, "grade": 4}, "\\n"]'
    df = spark.createDataFrame([("k", listing)], "k string, text string")
    assert [(r.term, r.grade) for r in events.symptom_rows(df, "k").orderBy("position").collect()] == [("a", 1), ("b", 5), ("c", 5), ("d", 1), ("", 1)]


def test_report_merge(spark):
    model = spark.createDataFrame([("id1", 1, "a", 0, "Rash", "skin", 2, False, "possible", 0.3, "model", "")], "ae_id string, subject int, arm string, epoch int, term string, soc string, grade int, serious boolean, relatedness string, p double, source string, verbatim string")
    said = spark.createDataFrame(
        [(1, "a", 0, 1, " rash", 3, "itches"), (1, "a", 0, 2, "New", 1, ""), (1, "a", 0, 3, "new", 4, "sore"), (1, "a", 0, 6, "late", 5, "")],
        "subject int, arm string, epoch int, position int, term string, grade int, verbatim string",
    )
    out = joins.merge_reports(model, said, "run")
    assert rows_of(out, "term", "grade", "serious", "source") == [("New", 1, False, "llm"), ("Rash", 3, True, "hybrid"), ("new", 4, True, "llm")]
    assert out.where("term = 'Rash'").first().verbatim == "itches"


# --- graph, telemetry, runs ------------------------------------------------------------
def test_closures_with_cycle_and_orphan(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("x", "y")], "source string, target string")
    assert rows_of(graph.upstream(e, "d"), "node") == [("a",), ("b",), ("c",), ("d",)]
    assert rows_of(graph.downstream(e, "a"), "node") == [("b",), ("c",), ("d",)]
    assert graph.upstream(e, "a").count() == 0


def test_digest_of_distant_keys_is_one_row(spark):
    def digest(keys):
        return [r["digest"] for r in readout.cohort_digest(spark.createDataFrame([(k,) for k in keys], "k long"), F.col("k").cast("string"), "k").collect()]

    keys = [1, 3 * 1024**4, -5, 2**63 - 1, -(2**63), 2**62]
    assert len(digest(keys)) == 1 and digest(keys) == digest(keys[::-1])
    assert digest(keys) != digest(keys[:-1])
    assert digest([1, 2]) == [hashlib.sha256(b"1|2").hexdigest()[:16]]


def test_digest_depends_on_ranks_only(spark):
    """Text keys with a common prefix, repeated rows, several levels: as a plain tree; other key values give the same digest."""

    def tree(texts, width):
        level = [hashlib.sha256("|".join(texts[i : i + width]).encode()).hexdigest() for i in range(0, len(texts), width)]
        while len(level) > 1:
            groups = [level[i : i + width] for i in range(0, len(level), width)]
            level = [g[0] if len(g) == 1 else hashlib.sha256("|".join(g).encode()).hexdigest() for g in groups]
        return [level[0][:16]]

    texts = [f"t{i % 90:02d}" for i in range(203)]
    near = [(f"S-{i:05d}", t) for i, t in enumerate(texts)]
    far = [(f"S-{i * 397:09d}x", t) for i, t in enumerate(texts)]
    for rows in (near, far, [(i - 100) ** 3 for i in range(203)]):
        rows = rows if isinstance(rows[0], tuple) else list(zip(rows, texts, strict=True))
        df = spark.createDataFrame(rows[::-1], ["k", "t"]).repartition(7)
        assert [r.digest for r in readout.cohort_digest(df, F.col("t"), "k", bits=2).collect()] == tree(texts, 4)
    ties = spark.createDataFrame([(None, "b"), (None, "a"), (1, "c"), (1, "c"), (2, None)], "k int, t string")
    assert readout.cohort_digest(ties, F.col("t"), "k").first().digest == hashlib.sha256(b"a|b|c|c|").hexdigest()[:16]
    assert readout.cohort_digest(ties.limit(0), F.col("t"), "k").count() == 0


def test_span_ids_of_any_characters(spark):
    s = spark.createDataFrame([("t", "a/b", None), ("t", "c", "a/b"), ("t", "d/e", "c"), ("t", "/", "d/e"), ("t", "x|y", "nobody")], "trace_id string, span_id string, parent_id string")
    got = {r.span_id: (r.root, r.depth, r.path) for r in graph.span_tree(s).collect()}
    assert got == {"a/b": ("a/b", 0, "a/b"), "c": ("a/b", 1, "a/b/c"), "d/e": ("a/b", 2, "a/b/c/d/e"), "/": ("a/b", 3, "a/b/c/d/e//"), "x|y": ("x|y", 0, "x|y")}


def test_reads_open_only_the_partitions_asked_for(spark, tmp_path):
    """Files of all other versions are replaced by rubbish that no reader could open."""
    root = f"{tmp_path}/table"
    rows = spark.range(60).selectExpr("id", "cast(id % 6 + 1 AS int) AS _version", "concat('r', id % 3) AS run_id")
    rows.repartition("_version").write.partitionBy("_version").parquet(f"file://{root}/data")
    log = [(n, f"2024-01-0{n}", f"r{(n - 1) % 3}", "overwrite" if n == 4 else "append", 10) for n in range(1, 7)]
    spark.createDataFrame(log, versions.LOG_SCHEMA).write.parquet(f"file://{root}/log")
    reads = {
        "batch": ([3], lambda d, g: versions.batch(d, 3)),
        "as_of": ([4, 5], lambda d, g: versions.as_of(d, g, 5)),
        "latest": ([4, 5, 6], lambda d, g: versions.latest(d, g)),
        "of_run": ([2, 5], lambda d, g: versions.of_run(d, "r1", g)),
        "newest_run": ([3, 6], lambda d, g: versions.newest_run(d, g)),
    }
    for name, (kept, read) in reads.items():
        copy = tmp_path / name
        shutil.copytree(root, copy)
        for n in set(range(1, 7)) - set(kept):
            for f in (copy / f"data/_version={n}").glob("*.parquet"):
                f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
                f.write_bytes(b"not a parquet file at all")
        data, g = spark.read.schema("id bigint, run_id string, _version int").parquet(f"file://{copy}/data"), versions.read_log(spark, f"file://{copy}")
        assert sorted({r._version for r in read(data, g).collect()}) == kept, name
        assert read(data, g).count() == 10 * len(kept), name
    assert versions.read_data(spark, f"file://{tmp_path}/none", "id bigint").columns == ["id", "run_id", "_version"]
    assert versions.latest(versions.read_data(spark, f"file://{tmp_path}/none"), versions.read_log(spark, f"file://{tmp_path}/none")).count() == 0


def test_span_tree(spark):
    s = spark.createDataFrame(
        [("t", "a", ""), ("t", "b", "a"), ("t", "c", "b"), ("t", "d", "gone"), ("t", "p", "q"), ("t", "q", "p"), ("u", "a", None)], "trace_id string, span_id string, parent_id string"
    )
    got = {(r.trace_id, r.span_id): (r.root, r.depth, r.path) for r in graph.span_tree(s).collect()}
    assert got == {("t", "a"): ("a", 0, "a"), ("t", "b"): ("a", 1, "a/b"), ("t", "c"): ("a", 2, "a/b/c"), ("t", "d"): ("d", 0, "d"), ("u", "a"): ("a", 0, "a")}


def test_deep_chain_takes_few_rounds(spark):
    n = 200
    s = spark.createDataFrame([("t", f"n{i}", f"n{i - 1}" if i else "") for i in range(n)], "trace_id string, span_id string, parent_id string")
    r = graph.span_tree(s).where(f"span_id = 'n{n - 1}'").first()
    assert (r.root, r.depth) == ("n0", n - 1) and r.path.split("/") == [f"n{i}" for i in range(n)]


def test_trace_summary_without_calls(spark):
    s = spark.createDataFrame([("t", "CHAIN", 5.0, 3, 1, False, "p", "m", "OK")], "trace_id string, kind string, duration_ms double, tokens_in int, tokens_out int, cache_hit boolean, provider string, model string, status string")
    r = telemetry.trace_summary(s).first()
    assert (r.spans, r.calls, r.traces, r.tokens_in_total, r.latency_ms_mean, r.cache_hit_rate) == (1, 0, 1, 0, 0.0, 0.0)


def test_run_diff_is_null_safe(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, 5, "y"), (3, 1, "z")], "k int, v int, observation_ts string")
    b = spark.createDataFrame([(1, None, "other"), (2, None, "y"), (4, 1, "z")], "k int, v int, observation_ts string")
    assert rows_of(compare.run_diff(a, b, ["k"]), "k", "state", "columns") == [(2, "differs", "v"), (3, "only_left", ""), (4, "only_right", "")]
    assert readout.fingerprint(a).first() == readout.fingerprint(a.repartition(3)).first()


def test_cache_first_write_wins(spark):
    entries = spark.createDataFrame([("k", 2, "late"), ("k", 1, "early")], "key string, ord int, response string")
    cache = joins.first_per_key(entries, "ord")
    req = spark.createDataFrame([("k",), ("k",), ("z",)], "key string")
    assert rows_of(joins.serve_from_cache(req, cache.select("key", "response")).fillna(""), "key", "response", "cache_hit") == [("k", "early", True), ("k", "early", True), ("z", "", False)]
    assert rows_of(joins.cache_misses(req, cache), "key") == [("z",)]


# --- sources ---------------------------------------------------------------------------
def test_absent_path_gives_an_empty_frame(spark, tmp_path):
    assert tables.read_columns(spark, str(tmp_path / "none"), ["a"]).count() == 0


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    frame = lambda *v: spark.createDataFrame([(x, "a") for x in v], "v int, arm string")
    assert versions.read_log(spark, root).count() == 0
    for rows, run, mode in ((frame(1, 2), "r1", "append"), (frame(3), "r2", "append"), (frame(9), "r3", "overwrite"), (frame(10), "r3", "append")):
        versions.append_batch(rows, root, run, mode, ("arm",))
    data, log = versions.read_data(spark, root), versions.read_log(spark, root)
    values = lambda df: sorted(r.v for r in df.collect())
    assert values(versions.batch(data, 2)) == [3]
    assert values(versions.as_of(data, log, 2)) == [1, 2, 3] and values(versions.as_of(data, log, 3)) == [9]
    assert values(versions.latest(data, log)) == [9, 10] and values(versions.of_run(data, "r3")) == [9, 10]
    assert [r.version for r in versions.history(log, 2).collect()] == [4, 3]
    assert sorted(r.version for r in versions.beyond_retention(log, 1).collect()) == [1, 2, 3]
    assert data.columns.count("arm") == 1
    with pytest.raises(ValueError):
        versions.require_run(log, "zz")
    with pytest.raises(ValueError):
        versions.require_version(log, 99)


def test_nested_columns_to_json(spark):
    df = spark.createDataFrame([Row(a=1, m={"b": 1, "a": 2}, s=Row(z=1, y="q"), l=[1, 2])])
    r = contract.nested_to_json(df).first()
    assert (r.a, r.m, r.s, r.l) == (1, '{"a":2,"b":1}', '{"y":"q","z":1}', "[1,2]")


def test_grouped_map_failures(spark):
    from pyspark.sql.types import LongType, StructType

    schema = StructType().add("k", LongType()).add("n", LongType())

    def f(pdf):
        if pdf["k"].iloc[0] == 2:
            raise RuntimeError("no")
        return pdf.groupby("k", as_index=False).size().rename(columns={"size": "n"})

    df = spark.createDataFrame([(1,), (1,), (2,)], "k long")
    m = grouped.grouped_map(df, "k", f, schema)
    assert rows_of(grouped.results(m), "k", "n") == [(1, 2)]
    assert rows_of(grouped.failures(m), "k", "failure") == [(2, "RuntimeError: no")]
    with pytest.raises(Exception):
        grouped.grouped_map(df, "k", f, schema, fail_fast=True).collect()
    assert grouped.grouped_map(df.where("k > 5"), "k", f, schema).count() == 0


def test_combined_map_isolates_rows_of_a_hot_key(spark):
    from pyspark.sql.types import LongType, StructType

    schema = StructType().add("k", LongType()).add("n", LongType()).add("top", LongType())

    def f(pdf):
        if (pdf["v"] % 1000 == 7).any():
            raise ValueError("bad row")
        k = pdf["k"].iloc[0]
        return pd.DataFrame([{"k": None if pd.isna(k) else int(k), "n": len(pdf), "top": int(pdf["v"].max())}]).astype({"k": "Int64"})

    key = F.when(F.col("id") % 10 == 0, None).when(F.col("id") == 1007, 9).otherwise(F.when(F.col("id") % 3 < 2, 0).otherwise(1))
    df = spark.range(6000).select(key.cast("long").alias("k"), F.col("id").alias("v")).repartition(5)
    out = grouped.combined_map(df, "k", f, schema, {"n": F.sum, "top": F.max})
    got = {r.k: (r.n, r.top, r.failed_rows, r.failure) for r in out.collect()}
    want = {}
    for r in df.collect():
        n, top, bad, _ = want.get(r.k, (None, None, 0, ""))
        want[r.k] = (n, top, bad + 1, "ValueError: bad row") if r.v % 1000 == 7 else ((n or 0) + 1, max(top or 0, r.v), bad, "ValueError: bad row" if bad else "")
    assert got == want and got[9] == (None, None, 1, "ValueError: bad row")
    assert grouped.combined_map(df.limit(0), "k", f, schema, {"n": F.sum, "top": F.max}).count() == 0
    with pytest.raises(ValueError):
        grouped.combined_map(df, "k", f, schema, {"n": F.sum})


def test_closure_with_a_hub(spark, monkeypatch):
    """A node with a third of all edges, cut into several rows, in a cycle; null ends are left out."""
    monkeypatch.setattr(graph, "WIDE", 50)
    hub = [("hub", f"n{i}") for i in range(1000)]
    rest = [(f"n{i}", f"m{i % 7}") for i in range(0, 1000, 2)] + [(f"m{i}", "hub") for i in range(3)] + [("far", "hub"), ("hub", None), (None, "hub"), ("hub", "n1")]
    e = spark.createDataFrame(hub + rest, "source string, target string")
    assert graph._packed(e, "source", "target").where("near = 'hub'").count() > 10
    down = {r.node for r in graph.downstream(e, "far").collect()}
    assert down == {"hub"} | {f"n{i}" for i in range(1000)} | {f"m{i}" for i in range(7)}
    up = {r.node for r in graph.upstream(e, "m4").collect()}
    assert up == {"far", "hub", "m0", "m1", "m2"} | {f"n{i}" for i in range(1000) if i % 2 == 0 and i % 7 in (0, 1, 2, 4)} | {f"n{i}" for i in range(1000) if i % 2 == 0 and i % 7 == 4}
    assert graph.downstream(e, "nobody").count() == 0


def test_batch_map_keeps_the_rest_of_a_failing_batch(spark):
    def fn(pdf):
        if (pdf.v == 500).any():
            raise ValueError("bad row")
        return pdf

    df = spark.range(1000).select(F.when(F.col("id") >= 0, F.col("id")).alias("v"))
    out = grouped.batch_map(df, fn, df.schema)
    assert grouped.results(out).count() == 999 and grouped.failures(out).count() == 1


def test_event_grades_out_of_range_do_not_stop_the_job(spark):
    rows = [('[{"term": "a", "ctcae_grade": 1e12}, {"term": "b", "ctcae_grade": "NaN"}, {"term": "c", "ctcae_grade": "3"}]',)]
    got = events.explode_events(spark.createDataFrame(rows, "adverse_events_json string")).collect()
    assert {r.term: r.ctcae_grade for r in got} == {"a": 1, "b": 1, "c": 3}


def test_white_space_around_grades_and_words(spark):
    df = spark.createDataFrame([("\tsevere", "poor\n")], "a string, b string")
    row = df.select(text.coerce_grade(F.col("a")).alias("a"), text.normalise_enum(F.col("b"), ("poor",), "good").alias("b")).first()
    assert (row.a, row.b) == (3, "poor")


def test_percentiles_of_no_rows_are_zero(spark):
    df = spark.createDataFrame([], "v double")
    assert telemetry.percentiles(df, "v", {"p50": 0.5}).collect()[0].p50 == 0.0


def test_shared_folder_must_be_named_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_report_words_each_term(spark):
    """A term's sentence comes from the wording, else from the term; top three of at least the threshold."""
    probs = F.create_map(F.lit("rash"), F.lit(0.2), F.lit("dry_mouth"), F.lit(0.5), F.lit("cough"), F.lit(0.1))
    report = text.rule_based_report(probs, F.lit(3), F.lit(2), wording={"rash": "It itches."}, source="rule")
    got = json.loads(spark.range(1).select(report.alias("r")).first().r)
    assert [(x["term"], x["verbatim"]) for x in got["symptoms"]] == [("dry_mouth", "I have some dry mouth since the dose."), ("rash", "It itches.")]
    assert got["source"] == "rule" and got["adherence_intent"] == "unsure"
    plain = json.loads(spark.range(1).select(text.rule_based_report(probs, F.lit(1), F.lit(2)).alias("r")).first().r)
    assert [x["verbatim"] for x in plain["symptoms"]] == ["I have some dry mouth since the dose.", "I have some rash since the dose."]
