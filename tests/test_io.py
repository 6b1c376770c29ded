"""Sources and sinks: CSV with multi-line quoted text, the three JSON batch shapes, metrics append."""

import random

import pytest
from pyspark.sql import functions as F

from noteflare.sources import io as IO
from noteflare.sources.csv_records import read_csv, records


def _rows(spark):
    data = [("p1", "n1", "2024-01-15", 'Line one\nline "two", with comma', "L40.0 Psoriasis"),
            ("p2", "n2", None, "", None)]
    return spark.createDataFrame(data, "patientId string, noteId string, noteDate string, complaints string, "
                                       "diagnoses string")


def test_csv_roundtrip_keeps_multiline_quoted_text(spark):
    path = IO.scratch_dir(spark, "test-csv")
    IO.write_csv(_rows(spark), path)
    back = {r["noteId"]: r for r in IO.read_note_csv(spark, path).collect()}
    assert back["n1"]["complaints"] == 'Line one\nline "two", with comma'
    assert back["n1"]["diagnoses"] == "L40.0 Psoriasis"


def test_json_batch_shapes(spark):
    path = IO.scratch_dir(spark, "test-json")
    notes = IO.conform_notes(_rows(spark))
    shaped = notes.withColumn("_shape", F.when(F.col("noteId") == "n1", "wrapped").otherwise("list"))
    IO.write_note_batches(shaped, path)
    back = IO.read_note_batch_json(spark, path)
    got = {r["noteId"]: r for r in back.collect()}
    assert set(got) == {"n1", "n2"}
    assert got["n1"]["complaints"] == 'Line one\nline "two", with comma'
    assert got["n2"]["allergy"] == ""  # absent field -> ""
    obj_path = IO.scratch_dir(spark, "test-json-obj")
    IO.write_note_batches(notes.withColumn("_shape", F.lit("object")), obj_path)
    assert IO.read_note_batch_json(spark, obj_path).count() == 2


def test_logging_a_run_again_replaces_it(spark):
    path = IO.scratch_dir(spark, "test-metrics")
    m = spark.createDataFrame([("auc", 0.9), ("f1", 0.8)], "name string, value double")
    IO.log_metrics(spark, path, "2024", m)
    IO.log_metrics(spark, path, "r2", m)
    out = IO.log_metrics(spark, path, "2024", m.where("name = 'auc'").selectExpr("name", "0.95 value"))
    assert out.columns == ["name", "value", "logged_at", "run_id"]
    assert sorted((r.run_id, r.name, r.value) for r in out.collect()) == [("2024", "auc", 0.95), ("r2", "auc", 0.9), ("r2", "f1", 0.8)]


# ---------------------------------------------------------------------------
# quoted CSV in splits
# ---------------------------------------------------------------------------

def _fields(rnd):
    text = lambda: "".join(rnd.choice(['a', 'é', ' ', ',', '"', '\n', '\r\n', '""', "x" * 30]) for _ in range(rnd.randint(0, 25)))
    return [str(rnd.random()), text(), text(), "" if rnd.random() < .3 else "plain"]


def _write(path, rows, end="\n", header=("id", "note, one", "two", "three")):
    import csv
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(header)
        w.writerows(rows)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_records_over_split_borders(spark, tmp_path, end):
    """Quotes and line breaks over split borders, against the standard library's reader."""
    rnd = random.Random(4)
    files = {"a.csv": [_fields(rnd) for _ in range(700)], "b.csv": [_fields(rnd) for _ in range(3)], "empty.csv": []}
    files["a.csv"][350] = ["giant", '"\n,' * 30_000, "", "spans many splits"]
    for name, rows in files.items():
        _write(tmp_path / name, rows, end)
    small = spark.newSession()
    small.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    small.conf.set("spark.sql.files.openCostInBytes", "0")
    got = read_csv(small, str(tmp_path))
    assert got.columns == ["id", "note, one", "two", "three"]
    found = sorted(tuple(x or "" for x in r) for r in got.collect())
    assert found == sorted(tuple(r) for rows in files.values() for r in rows)
    blocks = records(small, str(tmp_path)).select("file", "block").distinct().count()
    assert blocks > 20  # one file is read in many splits


def test_csv_headers_must_agree_and_nothing_reads_as_nothing(spark, tmp_path):
    _write(tmp_path / "a.csv", [["1", "x", "y", "z"]])
    _write(tmp_path / "b.csv", [["1", "x"]], header=("id", "other"))
    with pytest.raises(ValueError, match="differ"):
        read_csv(spark, str(tmp_path))
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.csv").write_text("")
    assert read_csv(spark, str(tmp_path / "none")).collect() == []


# ---------------------------------------------------------------------------
# Predicates of a partitioned table read
# ---------------------------------------------------------------------------

@pytest.mark.parametrize("keys", [
    [*range(1000)], [7] * 900 + [*range(100)], [None] * 400 + [*range(600)], [None] * 5, [3], [],
    [-10 ** 12, *[5] * 50, 10 ** 12], [1, 1, 2, 2, 2, 2, 2, 3, None]])
def test_range_predicates_are_disjoint_and_complete(spark, keys):
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i int").cache()
    preds = IO.range_predicates(df, "k", 8)
    hits = [{r.i for r in df.where(p).collect()} for p in preds]
    assert sum(len(h) for h in hits) == len(keys) and set().union(*hits) == set(range(len(keys)))
    if len(set(keys)) == 1000:
        assert max(map(len, hits)) < 2 * 1000 / 8


def test_predicates_of_text_keys_are_quoted(spark):
    df = spark.createDataFrame([(k,) for k in ["a", "b'c", "d", None, "", "é", "z"] * 20], "k string")
    preds = IO.range_predicates(df, "k", 4)
    assert sum(df.where(p).count() for p in preds) == 140 and len(preds) > 2
