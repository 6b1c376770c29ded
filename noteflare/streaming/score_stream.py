"""Continuous note scoring with Structured Streaming.

Stateless: each micro-batch runs the same cleaning, feature and scoring
columns as the batch job (so stream output equals batch output), with no
watermark or state store.  The file source tracks which files it has
consumed in the checkpoint, so a restarted query (or a lost executor)
resumes without double-scoring; the Parquet sink commits each batch
atomically through its metadata log.

``start_scoring_and_reject_stream`` fills two sinks from one read.  Each
micro-batch replaces its own folder ``batch_id=N`` in both, so a batch that
failed between the sinks and runs again neither doubles nor loses a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from noteflare.functions.features import note_features
from noteflare.operators.model import LinearScorer
from noteflare.operators.scoring import explain_notes
from noteflare.sources.io import BATCH_DDL, conform_notes, flatten_batch

OUTPUT_COLS = ("noteId", "patientId", "noteDate", "flare_probability", "flare_label", "flare_risk_level",
               "explanation_summary", "key_influences")


def _violations() -> F.Column:
    """Why a request row can't be scored; empty for a good one.  Ids arrive as text."""
    checks = [F.when(F.col(c).cast("string").try_cast("long").isNull(), F.lit(f"{c} not a number"))
              for c in ("noteId", "patientId")]
    return F.array_compact(F.array(*checks))


def rejected_notes(notes: DataFrame) -> DataFrame:
    """The request rows that ``scored_notes`` leaves out, with the reasons.

    A line that isn't JSON reads as a row without ids and ends up here.
    """
    bad = notes.withColumn("violations", _violations()).where(F.size("violations") > 0)
    return bad.select(F.col("noteId").cast("string").alias("noteId"), F.col("patientId").cast("string").alias("patientId"),
                      F.array_join("violations", "; ").alias("reasons"))


def scored_notes(notes: DataFrame, scorer: LinearScorer) -> DataFrame:
    """Request rows -> scored, explained note records (batch or stream).

    A row whose ids aren't numbers never fails the others and is never
    scored; ``rejected_notes`` gives it with its reasons.
    """
    feats = note_features(conform_notes(notes.where(F.size(_violations()) == 0)))
    out = explain_notes(scorer.transform(feats), scorer.contributions())
    return out.select(F.col("noteId").cast("long").alias("noteId"), F.col("patientId").cast("long").alias("patientId"),
                      *OUTPUT_COLS[2:])


def start_scoring_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                         scorer: LinearScorer, available_now: bool = True,
                         max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Score every JSON note batch landing in ``source_dir`` into Parquet at ``sink_dir``."""
    notes = _incoming(spark, source_dir, max_files_per_trigger)
    return _start(scored_notes(notes, scorer), sink_dir, checkpoint_dir, available_now)


def start_reject_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                        available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """The rows the scoring stream leaves out, with reasons, into Parquet at ``sink_dir``."""
    notes = _incoming(spark, source_dir, max_files_per_trigger)
    return _start(rejected_notes(notes), sink_dir, checkpoint_dir, available_now)


def start_scoring_and_reject_stream(spark: SparkSession, source_dir: str, score_dir: str, reject_dir: str,
                                    checkpoint_dir: str, scorer: LinearScorer, available_now: bool = True,
                                    max_files_per_trigger: int | None = None, between=None) -> StreamingQuery:
    """Scores and rejects of every JSON note batch, from one read of the source.

    ``between(batch_id)`` runs after a batch's scores and before its rejects (a hook for tests and monitoring).
    Read the results with :func:`read_batches`.
    """
    def both(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # the parsed rows serve both sinks; a lost copy is read again from the source
        try:
            scored_notes(batch, scorer).write.mode("overwrite").parquet(f"{score_dir}/batch_id={batch_id}")
            if between is not None:
                between(batch_id)
            rejected_notes(batch).write.mode("overwrite").parquet(f"{reject_dir}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    notes = _incoming(spark, source_dir, max_files_per_trigger)
    writer = notes.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint_dir)
    return _trigger(writer, available_now).start()


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches of one sink of :func:`start_scoring_and_reject_stream`."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch_id=*").drop("batch_id")


def _incoming(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.schema(BATCH_DDL)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return flatten_batch(reader.json(source_dir))


def _start(rows: DataFrame, sink_dir: str, checkpoint_dir: str, available_now: bool) -> StreamingQuery:
    writer = (rows.writeStream.format("parquet")
              .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    return _trigger(writer, available_now).start(sink_dir)


def _trigger(writer, available_now: bool):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
