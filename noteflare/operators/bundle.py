"""One versioned artefact that scores raw notes.

A bundle is everything a fit learned, as one persisted ``PipelineModel``: vocabulary, idf weights, SVD axes, scaler, trees
and calibration.  Versions are folders ``version=N``.  A writer claims its folder, writes the stages, and commits a
manifest last; a folder without a manifest is a write that never ended, and readers pass it by.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteflare.constants import TFIDF_INPUT_COLS
from noteflare.functions import text as X
from noteflare.functions.features import add_masked_text, note_features
from noteflare.operators import ml
from noteflare.operators.scoring import note_risk
from noteflare.sources.io import conform_notes

MANIFEST = "MANIFEST.json"
FORMAT = 1


@dataclass(frozen=True)
class Bundle:
    """``stages`` turn a note's features and ``tfidf_text`` into probability and calibrated probability."""

    stages: PipelineModel
    facts: dict = field(default_factory=dict)  # numbers about the fit, kept in the manifest
    version: int = 0

    def score_features(self, features: DataFrame) -> DataFrame:
        """``features`` (numeric inputs and ``tfidf_text``) with ``p`` and ``p_calibrated``; no exchange."""
        out = ml.calibrated_probability(ml.positive_probability(self.stages.transform(features)))
        return out.drop("text_vec", "svd_vec", "features", "rawPrediction", "probability", "prediction")

    def score_notes(self, notes: DataFrame) -> DataFrame:
        """Raw note rows (ids, date, text fields as they come; absent ones are empty) with p, p_calibrated and the risk of p.

        The same cleaning, feature and masking columns as in training, then the bundle's stages.
        """
        feats = add_masked_text(note_features(conform_notes(notes)))
        scored = self.score_features(feats.withColumn("tfidf_text", X.join_fields(*TFIDF_INPUT_COLS)))
        return note_risk(scored, "p").select("noteId", "patientId", "noteDate", "p", "p_calibrated",
                                             "flare_probability", "flare_label", "flare_risk_level")


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _write_new(fs, path, text: str) -> bool:
    """Create a small file; False if it exists already."""
    if fs.exists(path):
        return False
    try:
        out = fs.create(path, False)
    except Exception as e:  # noqa: BLE001 - another writer was first
        if "FileAlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    out.write(text.encode())
    out.close()
    return True


def _versions(spark: SparkSession, root: str) -> list[int]:
    fs, path = _fs(spark, root)
    if not fs.exists(path(root)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path(root))]
    return sorted(int(n[8:]) for n in names if n.startswith("version=") and n[8:].isdigit())


def save_bundle(spark: SparkSession, bundle: Bundle, root: str) -> int:
    """Write a new version above all there are, finished or not; returns its number."""
    fs, path = _fs(spark, root)
    root = root.rstrip("/")
    version = max(_versions(spark, root), default=0) + 1
    while not _write_new(fs, path(f"{root}/version={version}/_CLAIM"), str(time.time())):
        version += 1
    folder = f"{root}/version={version}"
    bundle.stages.write().save(f"{folder}/stages")
    manifest = {"format": FORMAT, "version": version, "written": time.time(), "facts": bundle.facts,
                "stages": [type(s).__name__ for s in bundle.stages.stages]}
    # Written aside and renamed: a reader sees the whole manifest or none.
    _write_new(fs, path(f"{folder}/_{MANIFEST}"), json.dumps(manifest))
    fs.rename(path(f"{folder}/_{MANIFEST}"), path(f"{folder}/{MANIFEST}"))
    return version


def latest_complete(spark: SparkSession, root: str) -> int:
    """The highest version with a manifest; 0 if there is none."""
    fs, path = _fs(spark, root)
    done = [v for v in _versions(spark, root) if fs.exists(path(f"{root.rstrip('/')}/version={v}/{MANIFEST}"))]
    return max(done, default=0)


def load_bundle(spark: SparkSession, root: str, version: int | None = None) -> Bundle:
    """A complete version, by default the latest."""
    version = version or latest_complete(spark, root)
    folder = f"{root.rstrip('/')}/version={version}"
    fs, path = _fs(spark, root)
    if not version or not fs.exists(path(f"{folder}/{MANIFEST}")):
        raise FileNotFoundError(f"no complete bundle under {root}")
    manifest = json.loads(spark.read.text(f"{folder}/{MANIFEST}", wholetext=True).first()[0])
    if manifest["format"] != FORMAT:
        raise ValueError(f"{folder}: format {manifest['format']}, this code reads {FORMAT}")
    stages = PipelineModel.load(f"{folder}/stages")
    found = [type(s).__name__ for s in stages.stages]
    if found != manifest["stages"]:
        raise ValueError(f"{folder}: stages {found}, the manifest names {manifest['stages']}")
    return Bundle(stages, manifest["facts"], version)


def metrics_rows(bundle: Bundle) -> list[tuple[str, float]]:
    """The manifest's numbers as (name, value), e.g. for the metric log."""
    return [(k, float(v)) for k, v in sorted(bundle.facts.items())]


def as_request(notes: DataFrame, fields) -> DataFrame:
    """Extracted notes in the layout of a scoring request: ids and dates as text."""
    return notes.select(F.col("patientId").cast("string").alias("patientId"), F.col("noteId").cast("string").alias("noteId"),
                        F.date_format("noteDate", "yyyy-MM-dd HH:mm:ss").alias("noteDate"), *[F.col(f"`{c}`") for c in fields])
