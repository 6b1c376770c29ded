"""Scoring (K1-K8, W2, W3, P18, X13, X14): note records, explanations, patient roll-up.

Per-note work (bands, top influences, summary sentence) is array and column
arithmetic inside the row: no shuffle.  The patient roll-up is one
map-side-combined aggregate on ``patientId``; the ranked list of a
patient's notes is a global sort on ``(patientId, probability desc)``, which
range-partitions, so a patient with very many notes is spread over tasks
instead of being gathered into one.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteflare.constants import (
    DOWN_TEXT,
    INTERPRETABLE_FEATURES,
    NOTE_RISK_BANDS,
    PATIENT_RISK_BANDS,
    UP_TEXT,
)
from noteflare.session import materialize

TEXT_SIGNAL = "text_signal"


def band(c: Column, bands: Sequence[tuple[float, str]], top: str = "High") -> Column:
    """``when(c < edge, name)...otherwise(top)`` over ascending band edges."""
    out = None
    for edge, name in bands:
        out = F.when(c < F.lit(edge), F.lit(name)) if out is None else out.when(c < F.lit(edge), F.lit(name))
    return out.otherwise(F.lit(top))


def note_risk(df: DataFrame, prob_col: str = "probability") -> DataFrame:
    """K1: rounded probability (3 dp), label (unrounded >= 0.5), three-band risk."""
    p = F.col(prob_col)
    return df.withColumns({
        "flare_probability": F.round(p, 3),
        "flare_label": (p >= F.lit(0.5)).cast("int"),
        "flare_risk_level": band(p, NOTE_RISK_BANDS),
    })


def top_influences(contrib: Column, k: int = 5, hide_text: bool = True) -> Column:
    """The ``k`` largest |impact| (ties: later feature first), then
    ``svd_*`` renamed to ``text_signal``, then keep-first dedup of names.

    ``contrib`` is ``array<struct<feature, impact>>`` in model feature order.
    Result: ``array<struct<feature, impact (4 dp), direction>>``.
    """
    # Ordered by the fields of one struct: a comparator function is interpreted for every pair it is asked about.
    ranked = F.transform(contrib, lambda s, i: F.struct(F.abs(s["impact"]).alias("size"), i.alias("pos"),
                                                        s["feature"].alias("feature"), s["impact"].alias("impact")))
    top = F.slice(F.sort_array(ranked, asc=False), 1, k)

    def shown(s: Column) -> Column:
        name = s["feature"]
        if hide_text:
            name = F.when(name.startswith("svd_"), F.lit(TEXT_SIGNAL)).otherwise(name)
        return F.struct(name.alias("feature"), F.round(s["impact"], 4).alias("impact"),
                        F.when(s["impact"] > 0, F.lit(UP_TEXT)).otherwise(F.lit(DOWN_TEXT)).alias("direction"))

    named = F.transform(top, shown)
    if not hide_text:
        return named

    def first_of_name(found: Column) -> Column:
        return F.filter(found, lambda s, i: ~F.exists(F.slice(found, 1, i), lambda t: t["feature"] == s["feature"]))

    # As an element of an array the list is bound once; written into the filter's function, it is ranked again for each element.
    return F.get(F.transform(F.array(named), first_of_name), F.lit(0))


def explanation_summary(risk: Column, prob: Column, influences: Column) -> Column:
    """X13: 'Model predicted <risk> risk of flare (probability <p>%). Top influencing factors: a, b'."""
    pct = F.round(prob * 100, 1).cast("string")
    names = F.array_join(F.transform(influences, lambda s: s["feature"]), ", ")
    return F.concat(F.lit("Model predicted "), risk, F.lit(" risk of flare (probability "), pct,
                    F.lit("%). Top influencing factors: "), names)


def interpretable(influences: Column, names: Sequence[str] = INTERPRETABLE_FEATURES) -> Column:
    """K4: keep influences a clinician can read."""
    allowed = F.array(*[F.lit(n) for n in names])
    return F.filter(influences, lambda s: F.array_contains(allowed, s["feature"]))


SIGNAL_WORDS = ("complaint", "flare")


def text_signals(influences: Column, words: Sequence[str] = SIGNAL_WORDS) -> Column:
    """Map feature -> impact for names containing one of ``words``."""
    picked = F.filter(influences, lambda s: functools.reduce(operator.or_, [s["feature"].contains(w) for w in words]))
    return F.map_from_entries(F.transform(picked, lambda s: F.struct(s["feature"], s["impact"])))


def explain_notes(scored: DataFrame, contrib: Column, prob_col: str = "probability") -> DataFrame:
    """K1-K4, X13, X14 for every note row."""
    out = note_risk(scored, prob_col).withColumn("key_influences", top_influences(contrib))
    out = out.withColumn("explanation_summary",
                         explanation_summary(F.col("flare_risk_level"), F.col(prob_col), F.col("key_influences")))
    shown = interpretable(F.col("key_influences"))
    return out.withColumns({"patient_influences": shown, "text_signals": text_signals(shown)})


def patient_rollup(notes: DataFrame) -> DataFrame:
    """K5: per patient total notes, strict-majority label, mean of the rounded
    probabilities and four-band risk.  One aggregate, map-side combined."""
    agg = notes.groupBy("patientId").agg(
        F.count(F.lit(1)).alias("total_notes"),
        F.sum("flare_label").alias("_pos"),
        F.avg("flare_probability").alias("mean_probability"),
    )
    label = F.when(F.col("_pos") * 2 > F.col("total_notes"), 1).otherwise(0)
    return agg.select("patientId", "total_notes", label.alias("final_flare_label"), "mean_probability",
                      band(F.col("mean_probability"), PATIENT_RISK_BANDS).alias("final_risk_level"))


def patients_without_notes(patients: DataFrame, rollup: DataFrame, key: str = "patientId") -> DataFrame:
    """K7: every requested patient; those without notes get 0 notes, NULL label
    and risk 'Unknown'."""
    r = rollup.select(key, "total_notes", "final_flare_label", "mean_probability", "final_risk_level")
    out = patients.select(key).join(r, key, "left")
    return out.select(
        key, F.coalesce("total_notes", F.lit(0)).alias("total_notes"), "final_flare_label",
        "mean_probability", F.coalesce("final_risk_level", F.lit("Unknown")).alias("final_risk_level"),
        F.when(F.col("total_notes").isNull(), F.lit("No notes found")).alias("message"))


def risky_notes(explained: DataFrame, cols: Sequence[str] = ("noteId", "noteDate", "flare_probability",
                                                                "flare_risk_level")) -> DataFrame:
    """K6: each patient's notes by probability, highest first (ties: date, id).

    A global sort rather than a per-patient window: the range partitioner
    splits a patient with very many notes over several tasks.
    """
    ordered = explained.select("patientId", *cols, "patient_influences", "text_signals")
    return ordered.orderBy(F.col("patientId").asc(), F.col("flare_probability").desc(),
                           F.col("noteDate").asc_nulls_last(), F.col("noteId").asc())


def patient_records(explained: DataFrame, max_notes: int = 1000, n_ranges: int | None = None) -> DataFrame:
    """S5 + K6: each patient's roll-up with its ranked notes nested, in numbered parts.

    (patientId, total_notes, final_flare_label, mean_probability, final_risk_level, part, parts, first_rank, risky_notes).
    Notes are range-partitioned in rank order, so a patient with very many is spread over ranges; a range's notes of a
    patient are cut into parts of at most ``max_notes``.  Part numbers and first ranks come from
    counts by (patient, range).  Most patients have one part; one that lies on a range border has two.
    """
    rank = [F.col("flare_probability").desc(), F.col("noteDate").asc_nulls_last(), F.col("noteId").asc()]
    cols = ("noteId", "noteDate", "flare_probability", "flare_risk_level", "patient_influences", "text_signals")
    keys = ["patientId", *rank]
    rows = explained.select("patientId", *cols)
    rows = rows.repartitionByRange(n_ranges, *keys) if n_ranges else rows.repartitionByRange(*keys)
    rows = materialize(rows.withColumn("range", F.spark_partition_id()), "ranked-notes")
    counts = rows.groupBy("patientId", "range").agg(F.count(F.lit(1)).alias("n"))
    patient = Window.partitionBy("patientId")
    earlier = patient.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    chunks = F.ceil(F.col("n") / max_notes)
    places = counts.select(
        "patientId", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("notes_before"),
        F.coalesce(F.sum(chunks).over(earlier), F.lit(0)).alias("parts_before"), F.sum(chunks).over(patient).alias("parts"))
    inside = F.row_number().over(Window.partitionBy("patientId", "range").orderBy(*rank)) - 1
    part = rows.withColumn("at", inside).withColumn("chunk", F.floor(F.col("at") / max_notes))
    nested = part.groupBy("patientId", "range", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("at", F.struct(*cols).alias("note"))), lambda a, b: (a["at"] - b["at"]).cast("int")).alias("n"))
    out = nested.join(places, ["patientId", "range"]).join(patient_rollup(explained), "patientId")
    return out.select(
        "patientId", "total_notes", "final_flare_label", "mean_probability", "final_risk_level",
        (F.col("parts_before") + F.col("chunk") + 1).cast("long").alias("part"), F.col("parts").cast("long").alias("parts"),
        (F.col("notes_before") + F.col("chunk") * max_notes + 1).cast("long").alias("first_rank"),
        F.transform("n", lambda x: x["note"]).alias("risky_notes"))


def contract_check(df: DataFrame, prob_col: str | None = "flare_probability",
                   label_col: str | None = "flare_label") -> tuple[DataFrame, DataFrame]:
    """Split rows into (valid, quarantined); quarantined rows carry ``violations``.

    Rules: patientId present and non-empty; probability in [0, 1]; label in {0, 1}.
    """
    checks = [(F.coalesce(F.length(F.col("patientId").cast("string")), F.lit(0)) < 1, "patientId empty")]
    if prob_col and prob_col in df.columns:
        p = F.col(prob_col)
        checks.append((p.isNull() | (p < 0) | (p > 1), "probability out of [0,1]"))
    if label_col and label_col in df.columns:
        checks.append((~F.coalesce(F.col(label_col).isin(0, 1), F.lit(False)), "label not in {0,1}"))
    viol = F.filter(F.array(*[F.when(c, F.lit(msg)) for c, msg in checks]), lambda x: x.isNotNull())
    tagged = df.withColumn("violations", viol)
    valid = tagged.where(F.size("violations") == 0).drop("violations")
    bad = tagged.where(F.size("violations") > 0)
    return valid, bad
