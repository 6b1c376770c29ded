"""Golden feature values of three invented notes."""

import pytest
from pyspark.sql import functions as F

from noteflare.functions.features import add_masked_text, note_features
from noteflare.operators.label import next_visit_label
from noteflare.sources.io import NOTE_REQUEST_DDL, conform_notes

# Invented notes; the expected values were worked out by hand from the rules.
NOTE_A = {
    "patientId": "OWN1", "noteId": "N1", "noteDate": "2023-03-09",
    "patientSummary": "A 62 years old Female, follow up visit",
    "complaints": "Burning rash on the scalp, no improvement since spring.",
    "assesment": "Infection brought this flare",
    "examination": "Scale on both shins, one plaque at the elbow.",
    "reviewofsystem": "Dry skin, no fever, sleeps well.", "currentmedication": "No active medication",
    "pastHistory": "Former smoker; alcohol: yes; melanoma: yes (aunt)",
    "diagnoses": "L40.4 Guttate psoriasis,M19.9 Osteoarthritis", "procedure": "", "allergy": "Penicillin",
}
NOTE_B1 = {
    "patientId": "OWN2", "noteId": "N1", "noteDate": "2023-05-02",
    "patientSummary": "Patient is a Male of unknown age", "complaints": "Feels well.", "assesment": "Stable disease.",
    "examination": "Clear skin.", "reviewofsystem": "Itch at night.", "currentmedication": "Secukinumab monthly",
    "diagnoses": "I10.0 Hypertension", "allergy": "No known allergies",
}
NOTE_B2 = {
    "patientId": "OWN2", "noteId": "N2", "noteDate": "2023-06-20", "patientSummary": "Male, 30 year old",
    "complaints": "Lesion spreading", "assesment": "Stress made it worsen; steroid course",
    "examination": "Hyperpigmented plaque", "currentmedication": "Hydrocortisone at bedtime",
    "pastHistory": "Alcohol: no", "diagnoses": "L40.0 Psoriasis, Plaque",
}

# Column -> (A, B1, B2)
GOLDEN = {
    "diagnosis_codes": (["L40.4", "M19.9"], ["I10.0"], ["L40.0"]),
    "has_psoriasis": (1, 0, 1),
    "psoriasis_type": ("Guttate", None, "Plaque"),
    "complaint_flare_kw": (1, 0, 1),
    "complaint_no_relief": (1, 0, 0),
    "flare_in_assessment": (1, 0, 1),
    "trigger_mentioned": (1, 0, 1),
    "steroid_started": (0, 0, 1),
    "has_medications": (False, True, True),
    "on_steroid_med": (False, False, True),
    "on_biologic": (False, True, False),
    "plaques_present": (True, False, True),
    "silvery_scale": (True, False, False),
    "elbows_involved": (True, False, False),
    "hyperpigmentation": (False, False, True),
    "itch_present": (False, True, False),
    "dry_skin": (True, False, False),
    "fever_absent": (True, False, False),
    "smoker": (True, False, False),
    "alcohol_use": (True, False, False),
    "family_melanoma": (True, False, False),
    "patient_age": (62.0, None, 30.0),
    "patient_gender": ("Female", "Male", "Male"),
    "follow_up_visit": (True, False, False),
    "has_allergy": (True, False, True),
    "flare_signal": (1, 1, 1),
    "any_steroid_use": (0, 0, 1),
    "flare_risk_score": (3, 2, 4),
    "flare_label": (0, 0, 1),
    "assesment_clean": ("Infection brought this", "Stable disease.", "Stress made it worsen; steroid course"),
    "currentmedication_clean": ("No active medication", "Secukinumab monthly", "at bedtime"),
}


def _notes(spark, rows):
    fields = [f.split()[0] for f in NOTE_REQUEST_DDL.split(", ")]
    data = [tuple(r.get(f.strip("`")) for f in fields) for r in rows]
    return conform_notes(spark.createDataFrame(data, NOTE_REQUEST_DDL))


@pytest.fixture(scope="module")
def golden_rows(spark):
    df = add_masked_text(note_features(_notes(spark, [NOTE_A, NOTE_B1, NOTE_B2])))
    rows = {(r["patientId"], r["noteId"]): r for r in df.collect()}
    return [rows[("OWN1", "N1")], rows[("OWN2", "N1")], rows[("OWN2", "N2")]]


@pytest.mark.parametrize("column", sorted(GOLDEN))
def test_golden_column(golden_rows, column):
    got = tuple(r[column] for r in golden_rows)
    assert got == GOLDEN[column]


def test_next_visit_label(spark):
    df = note_features(_notes(spark, [NOTE_A, NOTE_B1, NOTE_B2]))
    # The sample notes come from separate requests and reuse note ids: key by (patient, note).
    labelled = next_visit_label(df, key=["patientId", "noteId"])
    out = {(r["patientId"], r["noteId"]): r["flare_label_next"] for r in labelled.collect()}
    assert out == {("OWN2", "N1"): 1}


def test_minimal_and_empty_notes_score(spark):
    from noteflare.operators.model import LinearScorer
    from noteflare.constants import SAFE_NUMERIC_COLS
    from noteflare.operators.scoring import explain_notes

    minimal = {"patientId": "OWN3", "noteId": "N1", "complaints": "Sore"}
    empty = {"patientId": "OWN4", "noteId": "N1", "complaints": "", "assesment": "", "examination": ""}
    feats = note_features(_notes(spark, [minimal, empty]))
    scorer = LinearScorer(tuple(SAFE_NUMERIC_COLS), {c: 0.1 for c in SAFE_NUMERIC_COLS}, -0.5,
                          {c: 0.0 for c in SAFE_NUMERIC_COLS})
    rows = explain_notes(scorer.transform(feats), scorer.contributions()).collect()
    assert len(rows) == 2
    assert all(0.0 <= r["flare_probability"] <= 1.0 for r in rows)
    assert {r["flare_risk_level"] for r in rows} <= {"Low", "Moderate", "High"}
