"""A restarted stream resumes from its checkpoint (no note scored twice or lost)."""

from pyspark.sql import functions as F

from noteflare.constants import SAFE_NUMERIC_COLS
from noteflare.operators.model import LinearScorer
from noteflare.plans import queries as Q
from noteflare.sources import io as IO
from noteflare.streaming.score_stream import rejected_notes, scored_notes, start_reject_stream, start_scoring_stream

SF = "/root/testdata/sf0.001"


def test_restart_scores_only_new_files(spark):
    scorer = LinearScorer(tuple(SAFE_NUMERIC_COLS), {c: 0.2 for c in SAFE_NUMERIC_COLS}, -1.0,
                          {c: 0.0 for c in SAFE_NUMERIC_COLS})
    rows = Q.request_rows(spark, SF).withColumn("_shape", F.lit("object"))
    first, second = rows.where(F.col("noteId").cast("long") % 2 == 0), rows.where(F.col("noteId").cast("long") % 2 == 1)
    src = IO.scratch_dir(spark, "t-stream-src")
    sink, ckpt = IO.scratch_dir(spark, "t-stream-out"), IO.scratch_dir(spark, "t-stream-ckpt")
    IO.write_note_batches(first, src + "/batch=1")
    start_scoring_stream(spark, src + "/*", sink, ckpt, scorer).awaitTermination()
    n1 = spark.read.parquet(sink).count()
    IO.write_note_batches(second, src + "/batch=2")
    start_scoring_stream(spark, src + "/*", sink, ckpt, scorer).awaitTermination()
    out = spark.read.parquet(sink)
    assert n1 == first.count()
    assert out.count() == rows.count()
    assert out.select("noteId").distinct().count() == rows.count()
    batch = scored_notes(IO.read_note_batch_json(spark, src + "/*"), scorer)
    key = ["noteId", "flare_probability", "flare_risk_level"]
    assert sorted(out.select(*key).collect()) == sorted(batch.select(*key).collect())


def test_bad_rows_never_fail_or_get_scored(spark):
    scorer = LinearScorer(tuple(SAFE_NUMERIC_COLS), {c: 0.2 for c in SAFE_NUMERIC_COLS}, -1.0,
                          {c: 0.0 for c in SAFE_NUMERIC_COLS})
    src = IO.scratch_dir(spark, "t-bad-src")
    lines = ['{"noteId": "1", "patientId": "2"}', '{"noteId": "P-7", "patientId": "2"}', "not json",
             '{"noteId": "3", "patientId": ""}', '{"notes": [{"noteId": "4", "patientId": "5"}, {"noteId": "x", "patientId": "y"}]}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(src)
    good, bad = IO.scratch_dir(spark, "t-bad-good"), IO.scratch_dir(spark, "t-bad-bad")
    start_scoring_stream(spark, src, good, IO.scratch_dir(spark, "t-bad-c1"), scorer).awaitTermination()
    start_reject_stream(spark, src, bad, IO.scratch_dir(spark, "t-bad-c2")).awaitTermination()
    assert sorted(r.noteId for r in spark.read.parquet(good).collect()) == [1, 4]
    got = sorted((r.noteId or "", r.patientId or "", r.reasons) for r in spark.read.parquet(bad).collect())
    assert got == [("", "", "noteId not a number; patientId not a number"), ("3", "", "patientId not a number"),
                   ("P-7", "2", "noteId not a number"), ("x", "y", "noteId not a number; patientId not a number")]
    assert rejected_notes(IO.read_note_batch_json(spark, src)).count() == 4


def test_a_batch_that_fails_between_the_sinks_is_neither_doubled_nor_lost(spark):
    import pytest
    from pyspark.errors import StreamingQueryException

    from noteflare.streaming.score_stream import read_batches, start_scoring_and_reject_stream
    scorer = LinearScorer(tuple(SAFE_NUMERIC_COLS), {c: 0.2 for c in SAFE_NUMERIC_COLS}, -1.0,
                          {c: 0.0 for c in SAFE_NUMERIC_COLS})
    src, good, bad, ckpt = (IO.scratch_dir(spark, f"t-both-{x}") for x in ("src", "good", "bad", "ckpt"))
    lines = [f'{{"noteId": "{i if i % 3 else "x"}", "patientId": "{i}"}}' for i in range(60)]
    spark.createDataFrame([(x,) for x in lines], "value string").repartition(6).write.text(src)
    calls = []

    def fail_once(batch_id):
        calls.append(batch_id)
        if batch_id == 1 and calls.count(1) == 1:
            raise RuntimeError("lost between the sinks")

    start = lambda: start_scoring_and_reject_stream(spark, src, good, bad, ckpt, scorer, max_files_per_trigger=2,
                                                    between=fail_once)
    with pytest.raises(StreamingQueryException):
        start().awaitTermination()
    assert read_batches(spark, good).count() + read_batches(spark, bad).count() < 60
    start().awaitTermination()
    assert calls.count(1) == 2 and calls.count(0) == 1
    assert sorted(r.noteId for r in read_batches(spark, good).collect()) == [i for i in range(60) if i % 3]
    assert sorted(int(r.patientId) for r in read_batches(spark, bad).collect()) == [i for i in range(60) if i % 3 == 0]
