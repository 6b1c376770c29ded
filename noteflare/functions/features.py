"""Clinical feature columns F1-F30: per-note projections, no shuffle.

All features of a note are derived in two ``withColumns`` projections
(base flags, then the composites), which keeps them in one codegen stage
and lets the features be computed before any shuffle of the note rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteflare.constants import (
    AGE_PATTERN,
    GENDER_PATTERN,
    ICD10_CODE_PATTERN,
    LEXICON_PIPELINE,
    MASK_COLS,
    PSORIASIS_TYPE_PATTERN,
    TEXT_COLS,
)
from noteflare.functions import text as T


def _int(c: Column) -> Column:
    return c.cast("int")


def base_feature_columns(lexicon: Mapping = LEXICON_PIPELINE) -> dict[str, Column]:
    """F1-F25 over cleaned text columns (all text non-null after cleaning)."""
    lx = lexicon
    return {
        "diagnosis_codes": T.find_all("diagnoses", ICD10_CODE_PATTERN),
        "has_psoriasis": _int(T.matches("diagnoses", "L40")),
        "psoriasis_type": T.extract_first("diagnoses", PSORIASIS_TYPE_PATTERN),
        "complaint_flare_kw": T.flag_any("complaints", lx["complaint_flare_terms"]),
        "complaint_no_relief": _int(T.matches("complaints", lx["complaint_no_relief_pattern"])),
        "flare_in_assessment": T.flag_any("assesment", lx["assessment_flare_terms"]),
        "trigger_mentioned": T.flag_any("assesment", lx["assessment_trigger_terms"]),
        "steroid_started": T.flag_any("assesment", lx["assessment_steroid_terms"]),
        "has_medications": ~T.matches("currentmedication", lx["no_medication_pattern"]),
        "on_steroid_med": T.matches("currentmedication", lx["steroid_med_pattern"]),
        "on_biologic": T.matches("currentmedication", lx["biologic_pattern"]),
        "plaques_present": T.matches("examination", "plaque"),
        "silvery_scale": T.matches("examination", "silvery|scale"),
        "elbows_involved": T.matches("examination", "elbow"),
        "hyperpigmentation": T.matches("examination", "hyperpigment"),
        "itch_present": T.matches("reviewofsystem", "itch"),
        "dry_skin": T.matches("reviewofsystem", "dry skin"),
        "fever_absent": T.matches("reviewofsystem", "no fever"),
        "smoker": T.matches("pastHistory", "smoker"),
        "alcohol_use": T.matches("pastHistory", "alcohol.*yes"),
        "family_melanoma": T.matches("pastHistory", "melanoma.*yes"),
        # NULL when no "<n> year" is present (imputed to 0 only when vectorised).
        "patient_age": T.parse_number(T.extract_first("patientSummary", AGE_PATTERN), default=None),
        "patient_gender": T.extract_first("patientSummary", GENDER_PATTERN),
        "follow_up_visit": T.matches("patientSummary", "follow up"),
        "has_allergy": ~T.matches("allergy", "no known"),
    }


def composite_feature_columns() -> dict[str, Column]:
    """F26-F28."""
    flare_signal = _int(
        (F.col("complaint_flare_kw") == 1) | (F.col("flare_in_assessment") == 1) | F.col("itch_present")
    )
    any_steroid = _int((F.col("steroid_started") == 1) | F.col("on_steroid_med"))
    return {
        "flare_signal": flare_signal,
        "any_steroid_use": any_steroid,
        "flare_risk_score": flare_signal * 2 + any_steroid + F.col("trigger_mentioned"),
    }


def clean_notes(notes: DataFrame, text_cols=TEXT_COLS) -> DataFrame:
    """Parse the visit date and clean every text column.

    Text columns absent from the input are added as "" (scoring inputs
    may omit fields).
    """
    present = set(notes.columns)
    cols = {c: T.clean_html(c) if c in present else F.lit("") for c in text_cols}
    if "noteDate" in present:
        cols["noteDate"] = T.parse_timestamp("noteDate")
    return notes.withColumns(cols)


def add_features(cleaned: DataFrame, lexicon: Mapping = LEXICON_PIPELINE) -> DataFrame:
    """F1-F28 on cleaned notes."""
    return cleaned.withColumns(base_feature_columns(lexicon)).withColumns(composite_feature_columns())


def flare_label(df: DataFrame) -> DataFrame:
    """a note is a flare when it shows a flare signal and steroid use."""
    return df.withColumn(
        "flare_label", _int((F.col("flare_signal") == 1) & (F.col("any_steroid_use") == 1))
    )


def add_masked_text(df: DataFrame, cols=MASK_COLS) -> DataFrame:
    """``<col>_clean`` = leak-masked copy of each column."""
    return df.withColumns({c + "_clean": T.mask_terms(c) for c in cols})


def note_features(notes: DataFrame, lexicon: Mapping = LEXICON_PIPELINE) -> DataFrame:
    """Clean + F1-F29 in one narrow pass."""
    return flare_label(add_features(clean_notes(notes), lexicon))
