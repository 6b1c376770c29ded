"""Cohort selection and the one-row-per-note extract.

Plan shape (all lazy, one Catalyst plan):

* cohort: assessments filtered on the diagnosis ids (pushed into the scan)
  joined to dated notes -> distinct patient ids;
* notes: signed, dated notes, left-semi joined to the cohort;
* diagnoses: assessment rows pre-aggregated per (note, dx, code) with a
  map-side combine *before* anything is joined back to notes, so a note
  with many (or duplicate) assessment rows never fans the note out and a
  hot note is reduced before the shuffle;
* dimensions (providers x4 roles, place of service, diagnosis, codes) are
  broadcast only after a size check (planner estimate, then an exact row
  count within a row and byte bound), else shuffle-joined; the provider
  frame is broadcast once and reused by its four role joins.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteflare.constants import DEFAULT_SINCE, PSORIASIS_DX_IDS
from noteflare.functions.text import person_name
from noteflare.operators.joins import dimension, fits_broadcast

NOTE_BODY_COLS = (
    "complaints", "pastHistory", "assesment", "reviewofsystem", "currentmedication",
    "procedure", "biopsyNotes", "mohsNotes", "allergy", "examination", "patientSummary",
)
PROVIDER_ROLES = (
    ("provider", "rendering_name"),
    ("physician", "physician_name"),
    ("referringPhysician", "referring_name"),
    ("billingProvider", "billing_name"),
)


def _since(df: DataFrame, since: str, col: str = "noteDate") -> F.Column:
    """Timestamp literal typed like ``df[col]`` so the filter reaches the scan."""
    return F.lit(since).cast(df.schema[col].dataType)


def cohort_patients(tables: Mapping[str, DataFrame], dx_ids: Iterable[int] = PSORIASIS_DX_IDS,
                    since: str = DEFAULT_SINCE) -> DataFrame:
    """Distinct patients with a cohort diagnosis on a note since ``since``."""
    pa = tables["pnAssessment"].where(F.col("dxId").isin(list(dx_ids))).select("noteId")
    pn = tables["progressNotes"]
    pn = pn.where(F.col("noteDate") >= _since(pn, since)).select("noteId", "patientId")
    return pn.join(pa, "noteId", "left_semi").select("patientId").distinct()


def diagnosis_labels(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(dxId, dxCodeId, label) with label = ``icd10Code || ' ' || dxDescription`` non-null."""
    d = tables["diagnosis"].select("dxId", "dxDescription")
    dc = tables["diagnosisCodes"].select("dxId", "dxCodeId", "icd10Code")
    lab = dc.join(dimension(d), "dxId").select(
        "dxId", "dxCodeId", person_name("icd10Code", "dxDescription").alias("label")
    )
    return lab.where(F.col("label").isNotNull())


def diagnoses_per_note(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``noteId -> diagnoses`` = labels joined by ',' in label order.

    Duplicates are kept (as the source's string aggregation does).  Notes
    with no labelled assessment row are absent (the left join makes them NULL).
    The per-(note, dx, code) count collapses repeated assessment rows map-side;
    the ordered string is rebuilt by repeating each label ``n`` times.
    """
    pa = tables["pnAssessment"].groupBy("noteId", "dxId", "dxCodeId").agg(F.count(F.lit(1)).alias("n"))
    labelled = pa.join(dimension(diagnosis_labels(tables)), ["dxId", "dxCodeId"])
    parts = F.array_sort(F.collect_list(F.struct("label", "n")))
    repeated = F.flatten(F.transform(parts, lambda s: F.array_repeat(s["label"], s["n"].cast("int"))))
    return labelled.groupBy("noteId").agg(F.array_join(repeated, ",").alias("diagnoses"))


def _names(tables: Mapping[str, DataFrame], notes: DataFrame) -> DataFrame:
    """Four role-playing left joins to providers.

    The same (size-checked) provider frame is joined under four aliases,
    so the four joins share one broadcast (a reused exchange) instead of
    shipping the table four times.
    """
    prov = tables["providers"].select("providerId", person_name("firstName", "lastName").alias("_name"))
    side = F.broadcast(prov) if fits_broadcast(prov) else prov
    out = notes
    for key, name in PROVIDER_ROLES:
        role = side.alias(f"_p_{key}")
        joined = out.join(role, out[key] == F.col(f"_p_{key}.providerId"), "left")
        out = joined.select(*[out[c] for c in out.columns], F.col(f"_p_{key}._name").alias(name))
    return out


def signed_notes(tables: Mapping[str, DataFrame], since: str = DEFAULT_SINCE) -> DataFrame:
    """P2, P3."""
    pn = tables["progressNotes"]
    return pn.where(F.col("physicianSignDate").isNotNull() & (F.col("noteDate") >= _since(pn, since)))


def note_base(tables: Mapping[str, DataFrame], dx_ids: Iterable[int] = PSORIASIS_DX_IDS,
              since: str = DEFAULT_SINCE, with_names: bool = True,
              patient_id: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """One row per signed cohort note since ``since``.

    ``with_names=False`` skips the four provider joins (the training path
    drops the names right away).  ``patient_id`` looks up one patient (P4),
    in the cohort or not: the filter reaches the notes scan before any join.  ``only`` (noteId) keeps those
    notes of the cohort, before any assessment or body is read for others.
    Assessments and note bodies are cut to the selected notes by a semi join
    before they are grouped or joined.
    """
    notes = signed_notes(tables, since).withColumnRenamed("placeOfService", "_pos_code")
    if patient_id is not None:
        notes = notes.where(F.col("patientId") == F.lit(patient_id))
    else:
        notes = notes.join(cohort_patients(tables, dx_ids, since), "patientId", "left_semi")
    if only is not None:
        notes = notes.join(only, "noteId", "left_semi")
    body = tables["newProgressNotes"].select("noteId", *NOTE_BODY_COLS)
    wanted = notes.select("noteId")
    assessed = {**tables, "pnAssessment": tables["pnAssessment"].join(wanted, "noteId", "left_semi")}
    out = notes.join(body, "noteId", "left").join(diagnoses_per_note(assessed), "noteId", "left")
    pos = tables["placeOfService"].select(
        F.col("posCodes").alias("_pos"), F.col("posName").alias("PlaceOfService"))
    out = out.join(dimension(pos), out["_pos_code"] == F.col("_pos"), "left").drop("_pos", "_pos_code")
    if with_names:
        out = _names(tables, out)
    cols = ["noteId", "provider", "physician", "referringPhysician", "noteDate", "patientId",
            *NOTE_BODY_COLS, "diagnoses", "PlaceOfService"]
    if with_names:
        cols += [name for _, name in PROVIDER_ROLES]
    return out.select(*cols)


def dedup_notes(df: DataFrame, key: str | list[str] = "noteId", order: str = "noteDate") -> DataFrame:
    """Keep the first row per key in ``order`` (nulls last).

    An aggregate (``min_by`` over the whole row) rather than a ranking
    window: it combines map-side, so a hot key is reduced before the
    shuffle.  Deterministic when ``order`` is total within a key (ties fall
    back to the smallest remaining row).
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(F.col(order).isNull().alias("_null_last"), F.col(order).alias("_o"),
                    *[F.col(c) for c in rest if c != order])
    row = F.min_by(F.struct(*[F.col(c) for c in rest]), rank).alias("_r")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def tidy_columns(df: DataFrame, drop: Iterable[str]) -> DataFrame:
    """Trim labels, keep the first of duplicated names, drop listed columns."""
    seen: set[str] = set()
    keep = []
    for i, name in enumerate(df.columns):
        clean = name.strip()
        if clean.lower() in seen:
            continue
        seen.add(clean.lower())
        keep.append((i, clean))
    positional = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    out = positional.select(*[F.col(f"_c{i}").alias(clean) for i, clean in keep])
    dropset = set(drop)
    return out.select(*[c for c in out.columns if c not in dropset])
