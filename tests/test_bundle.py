"""A saved bundle scores raw notes as the session that fitted it; half-written versions are never chosen."""

import pytest
from pyspark.sql import functions as F

from noteflare.operators import bundle as B
from noteflare.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("models") / "flare")
    run = Q.gbt_run(spark, SF)
    assert B.latest_complete(spark, root) == 0
    assert B.save_bundle(spark, run["bundle"], root) == 1
    return root, run


def test_fresh_session_scores_raw_notes_the_same(spark, saved):
    root, run = saved
    other = spark.newSession()
    loaded = B.load_bundle(other, root)
    assert loaded.version == 1 and loaded.facts == run["bundle"].facts
    raw = Q.request_rows(spark, SF)
    path = root + "-notes"
    raw.write.mode("overwrite").parquet(path)
    got = {int(r.noteId): (r.p, r.p_calibrated) for r in loaded.score_notes(other.read.parquet(path)).collect()}
    from noteflare.operators import ml
    want = ml.calibrate(run["scored"], run["platt"]).select("noteId", "p", "p_calibrated").collect()
    assert len(want) > 50
    assert all(abs(got[r.noteId][0] - r.p) < 1e-9 and abs(got[r.noteId][1] - r.p_calibrated) < 1e-9 for r in want)


def test_scoring_has_no_exchange(spark, saved):
    notes = Q.request_rows(spark, SF)
    path = saved[0] + "-plan"
    notes.write.mode("overwrite").parquet(path)
    out = B.load_bundle(spark, saved[0]).score_notes(spark.read.parquet(path))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_single_minimal_and_empty_notes(spark, saved):
    loaded = B.load_bundle(spark, saved[0])
    notes = spark.createDataFrame([
        ("1", "11", "2024-01-02", "<p>58 year old Female</p>", "plaques worse, itching", "psoriasis flare; start clobetasol"),
        ("1", "12", None, None, None, None), ("2", "13", "", "", "", "")],
        "patientId string, noteId string, noteDate string, patientSummary string, complaints string, assesment string")
    out = {r.noteId: r for r in loaded.score_notes(notes).collect()}
    assert set(out) == {"11", "12", "13"}
    assert all(0 < r.p < 1 and 0 < r.p_calibrated < 1 and r.flare_risk_level in ("Low", "Moderate", "High") for r in out.values())
    assert out["12"].p == out["13"].p  # null and empty texts are the same
    single = loaded.score_notes(notes.where("noteId = '11'")).collect()
    assert len(single) == 1 and single[0].p == out["11"].p
    assert loaded.score_notes(notes.limit(0)).collect() == []


def test_half_written_versions_are_passed_by(spark, saved):
    root, run = saved
    fs, path = B._fs(spark, root)
    run["bundle"].stages.write().save(f"{root}/version=7/stages")  # all stages, no manifest
    assert B.latest_complete(spark, root) == 1 and B.load_bundle(spark, root).version == 1
    assert B.save_bundle(spark, run["bundle"], root) == 8
    fs.create(path(f"{root}/version=9/_CLAIM")).close()  # another writer claimed 9 and died
    assert B.save_bundle(spark, run["bundle"], root) == 10
    assert B.load_bundle(spark, root).version == 10 and B.load_bundle(spark, root, 1).version == 1
    with pytest.raises(FileNotFoundError):
        B.load_bundle(spark, root, 7)
    with pytest.raises(FileNotFoundError):
        B.load_bundle(spark, root + "-none")


def test_manifest_and_stages_must_agree(spark, saved):
    root, _ = saved
    fs, path = B._fs(spark, root)
    spark.read.text(f"{root}/version=1/{B.MANIFEST}").select(F.regexp_replace("value", "GBTClassificationModel", "Other")).coalesce(
        1).write.text(f"{root}/tmp-text")
    part = next(s.getPath() for s in fs.listStatus(path(f"{root}/tmp-text")) if s.getPath().getName().startswith("part-"))
    fs.mkdirs(path(f"{root}/version=20"))
    fs.rename(part, path(f"{root}/version=20/{B.MANIFEST}"))
    fs.rename(path(f"{root}/version=7/stages"), path(f"{root}/version=20/stages"))
    with pytest.raises(ValueError, match="manifest names"):
        B.load_bundle(spark, root)
