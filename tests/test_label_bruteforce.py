"""W1 and P8 against brute force on random notes with ties, undated notes,
notes without a patient and one hot patient holding a third of all rows."""

import datetime as dt
import random

import pytest

from noteflare.operators.extract import dedup_notes
from noteflare.operators.label import next_visit_label


def _notes(seed, n=600):
    rnd = random.Random(seed)
    base = dt.datetime(2023, 1, 1)
    rows = []
    for i in range(n):
        pid = 7 if i % 3 == 0 else rnd.choice([None, 1, 2, 3, 4, 5])
        day = None if rnd.random() < 0.05 else base + dt.timedelta(days=rnd.randint(0, 40),
                                                                    hours=rnd.choice([0, 0, 9]))
        rows.append((i + 1, pid, day, rnd.randint(0, 1)))
    rnd.shuffle(rows)
    return rows


def _brute_next(rows):
    out = {}
    by_pid = {}
    for r in rows:
        if r[1] is not None:
            by_pid.setdefault(r[1], []).append(r)
    for notes in by_pid.values():
        notes.sort(key=lambda r: (r[2] is None, r[2] or dt.datetime.min, r[0]))
        for a, b in zip(notes, notes[1:]):
            out[a[0]] = b[3]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_next_visit_label_matches_brute_force(spark, seed):
    rows = _notes(seed)
    df = spark.createDataFrame(rows, "noteId long, patientId long, noteDate timestamp, flare_label int")
    got = {r["noteId"]: r["flare_label_next"] for r in next_visit_label(df.repartition(7)).collect()}
    assert got == _brute_next(rows)
    kept = next_visit_label(df, keep_unlabelled=True)
    assert kept.count() == len(rows)


@pytest.mark.parametrize("seed", [4, 5])
def test_dedup_keeps_first_by_order(spark, seed):
    rows = _notes(seed)
    df = spark.createDataFrame(rows, "noteId long, patientId long, noteDate timestamp, flare_label int")
    got = {(r["patientId"], r["noteDate"]): r["noteId"]
           for r in dedup_notes(df, key=["patientId", "noteDate"], order="noteId").collect()}
    want = {}
    for nid, pid, day, _ in rows:
        k = (pid, day)
        want[k] = min(want.get(k, nid), nid)
    assert got == want
