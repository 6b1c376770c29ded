"""Broadcast guard: huge frames are refused from the planner estimate without a job;
small ones pass the exact row check; the byte bound scales with row width."""

import time

from noteflare.operators.joins import dimension, estimated_bytes, fits_broadcast, row_width


def test_huge_frame_refused_without_scanning(spark):
    huge = spark.range(10 ** 13).selectExpr("id", "cast(id as string) s")
    t0 = time.time()
    assert estimated_bytes(huge) > 10 ** 12
    assert not fits_broadcast(huge)
    assert time.time() - t0 < 30  # no scan of 10^13 rows happened


def test_small_dimension_passes_and_is_hinted(spark):
    small = spark.range(100).selectExpr("id", "cast(id as string) name")
    assert fits_broadcast(small)
    plan = dimension(small)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in plan or "broadcast" in plan.lower()


def test_byte_bound_limits_rows(spark):
    wide = spark.range(1000).selectExpr("id", *[f"cast(id as string) c{i}" for i in range(20)])
    assert row_width(wide) > 20 * 20
    assert not fits_broadcast(wide, max_rows=10 ** 6, max_bytes=row_width(wide) * 999)
    assert fits_broadcast(wide, max_rows=10 ** 6, max_bytes=row_width(wide) * 1000)


def test_labelled_notes_are_not_broadcast(spark, monkeypatch):
    """Kept tables look small on disk: neither the features nor the labels may be sent to the driver whole."""
    from noteflare.operators import joins
    from noteflare.plans import queries as Q
    from noteflare.session import materialize

    monkeypatch.setattr(joins, "FEW_ROWS", 2499)
    feats = materialize(spark.range(5000).selectExpr("id as noteId", "id % 7 as patientId", "true as itch_present"), "feats")
    labels = materialize(spark.range(0, 5000, 2).selectExpr("id as noteId", "1 as flare_label_next"), "labels")
    monkeypatch.setattr(Q, "features", lambda *_: feats)
    monkeypatch.setattr(Q, "next_labels", lambda *_: labels)
    out = Q.labelled(spark, "unused")
    assert out.count() == 2500
    out.collect()
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_next_visit_labels_broadcast_no_visit_days(spark):
    from noteflare.operators.label import next_visit_labels
    from noteflare.session import materialize

    feats = materialize(spark.range(5000).selectExpr(
        "id as noteId", "id % 700 as patientId", "if(id % 9 = 0, null, timestamp'2024-01-01' + make_interval(0, 0, 0, int(id / 1400))) as noteDate",
        "cast(id % 3 = 0 as int) as flare_label"), "dated")
    out = next_visit_labels(feats)
    rows = {r[0]: r[1] for r in out.collect()}
    assert len(rows) == 5000 - 700
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_chosen_notes_are_extracted_alone(spark):
    """``only`` gives the rows that a later filter gives, and bodies are cut to them before they are joined."""
    from noteflare.plans import queries as Q

    sf = "/root/testdata/sf0.001"
    ids = Q.notes(spark, sf, with_names=False).select("noteId").where("noteId % 3 = 0")
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    every, chosen = Q.request_rows(spark, sf), Q.request_rows(spark, sf, only=ids)
    assert rows(chosen) == rows(every.where("cast(noteId as long) % 3 = 0")) and 0 < chosen.count() < every.count()
