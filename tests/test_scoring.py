"""Hand-made scoring cases (FIXTURES.md section 4) and explanation rules."""

from pyspark.sql import functions as F

from noteflare.operators.scoring import (
    interpretable,
    patient_rollup,
    patients_without_notes,
    text_signals,
    top_influences,
)

CASES = {
    "tie": ([0.6, 0.4], 2, 0, 0.5, "Elevated"),
    "majority": ([0.75, 0.75, 0.1], 3, 1, 0.533333, "Elevated"),
    "low": ([0.329], 1, 0, 0.329, "Low"),
    "edge": ([0.33], 1, 0, 0.33, "Moderate"),
    "high": ([0.67], 1, 1, 0.67, "High"),
}


def test_patient_rollup_bands(spark):
    rows = [(pid, p, int(p >= 0.5)) for pid, (ps, *_rest) in CASES.items() for p in ps]
    notes = spark.createDataFrame(rows, "patientId string, flare_probability double, flare_label int")
    got = {r["patientId"]: r for r in patient_rollup(notes).collect()}
    for pid, (_ps, total, label, mean, risk) in CASES.items():
        r = got[pid]
        assert r["total_notes"] == total
        assert r["final_flare_label"] == label
        assert abs(r["mean_probability"] - mean) < 1e-6
        assert r["final_risk_level"] == risk


def test_rollup_is_order_independent(spark):
    rows = [(pid, p, int(p >= 0.5)) for pid, (ps, *_r) in CASES.items() for p in ps]
    a = spark.createDataFrame(rows, "patientId string, flare_probability double, flare_label int")
    b = spark.createDataFrame(list(reversed(rows)), a.schema).repartition(3)
    assert sorted(patient_rollup(a).collect()) == sorted(patient_rollup(b).collect())


def test_patient_without_notes(spark):
    rollup = patient_rollup(spark.createDataFrame([("p1", 0.7, 1)],
                                                  "patientId string, flare_probability double, flare_label int"))
    req = spark.createDataFrame([("p1",), ("none",)], "patientId string")
    got = {r["patientId"]: r for r in patients_without_notes(req, rollup).collect()}
    assert got["none"]["total_notes"] == 0
    assert got["none"]["final_flare_label"] is None
    assert got["none"]["final_risk_level"] == "Unknown"
    assert got["none"]["message"] == "No notes found"
    assert got["p1"]["final_risk_level"] == "High"


def test_influences_rename_dedup_and_filter(spark):
    impacts = [("svd_3", 0.9), ("svd_7", -0.8), ("itch_present", 0.5), ("patient_age", -0.4),
               ("dry_skin", 0.3), ("smoker", 0.2)]
    df = spark.createDataFrame([(1,)], "id int")
    contrib = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(v).alias("impact")) for n, v in impacts])
    row = df.select(top_influences(contrib).alias("k")).select(
        "k", interpretable(F.col("k")).alias("shown")).select(
        "k", "shown", text_signals(F.col("shown")).alias("ts")).first()
    assert [(s["feature"], s["impact"]) for s in row["k"]] == [
        ("text_signal", 0.9), ("itch_present", 0.5), ("patient_age", -0.4), ("dry_skin", 0.3)]
    assert [s["direction"] for s in row["k"]] == ["↑ flare risk up", "↑ flare risk up", "↓ flare risk down",
                                                  "↑ flare risk up"]
    assert [s["feature"] for s in row["shown"]] == ["itch_present", "dry_skin"]
    assert row["ts"] == {}


def test_contract_check_quarantines_bad_rows(spark):
    from noteflare.operators.scoring import contract_check

    rows = [("p1", 0.4, 0), ("", 0.5, 1), (None, 0.2, 0), ("p4", 1.5, 1), ("p5", None, 1), ("p6", 0.7, 2)]
    df = spark.createDataFrame(rows, "patientId string, flare_probability double, flare_label int")
    valid, bad = contract_check(df)
    assert [r["patientId"] for r in valid.collect()] == ["p1"]
    got = {(r["patientId"], r["flare_probability"]): r["violations"] for r in bad.collect()}
    assert got[("", 0.5)] == ["patientId empty"]
    assert got[(None, 0.2)] == ["patientId empty"]
    assert got[("p4", 1.5)] == ["probability out of [0,1]"]
    assert got[("p5", None)] == ["probability out of [0,1]"]
    assert got[("p6", 0.7)] == ["label not in {0,1}"]


def test_influences_are_ranked_once_a_note(spark):
    """No comparator function, one sort in the plan, and the order of size, later first among equals."""
    values = [0.5, -0.5, 0.0, -0.0, 2.0, 0.5, -3.0]
    df = spark.createDataFrame([(values,)], "x array<double>")
    contrib = F.array(*[F.struct(F.lit("svd_1" if i in (4, 6) else f"f{i}").alias("feature"), F.col("x")[i].alias("impact"))
                        for i in range(len(values))])
    out = df.repartition(2).select(top_influences(contrib, k=6).alias("k"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(") == 1 and "array_sort(" not in plan
    assert [(s["feature"], s["impact"]) for s in out.first()["k"]] == [
        ("text_signal", -3.0), ("f5", 0.5), ("f1", -0.5), ("f0", 0.5), ("f3", 0.0)]
