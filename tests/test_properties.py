"""Properties: split by patient, one row per note, mask idempotence, exact AUC."""

import random

import pytest
from pyspark.sql import functions as F

from noteflare.functions.text import mask_terms
from noteflare.operators import evaluate as E
from noteflare.plans import queries as Q

SF = "/root/testdata/sf0.001"


def test_split_never_shares_a_patient(spark):
    lab = Q.label.group_split(Q.labelled(spark, SF))
    per = lab.groupBy("patientId").agg(F.countDistinct("split").alias("k"))
    assert per.where(F.col("k") > 1).count() == 0


def test_one_row_per_note(spark):
    nb = Q.notes(spark, SF)
    assert nb.count() == nb.select("noteId").distinct().count()


@pytest.mark.parametrize("text", [
    "Psoriasis flare-up, apply ointment", "use the cream gel", "flare flares flaring", "Stable", "",
    "Start triamcinolone ointment", "use steroid cream & follow up"])
def test_mask_is_idempotent(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    once = df.select(mask_terms("t").alias("t"))
    twice = once.select(mask_terms("t").alias("t"))
    assert once.first()["t"] == twice.first()["t"]


def _brute_auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    tot = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bucketed_auc_is_exact(spark, seed):
    rnd = random.Random(seed)
    pairs = [(round(rnd.random(), 2), rnd.randint(0, 1)) for _ in range(600)]
    df = spark.createDataFrame(pairs, "score double, y int")
    got = E.roc_auc(df, "score", "y", n_buckets=7).first()["auc"]
    assert abs(got - _brute_auc(pairs)) < 1e-12


def test_grouped_auc_matches_brute_force(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice("ab"), round(rnd.random(), 1), rnd.randint(0, 1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, score double, y int")
    got = {r["g"]: r["auc"] for r in E.roc_auc(df, "score", "y", ["g"], n_buckets=5).collect()}
    for g in "ab":
        assert abs(got[g] - _brute_auc([(s, y) for gg, s, y in rows if gg == g])) < 1e-12


def test_hot_score_spreads_over_ranges(spark):
    """198,000 of 200,000 rows on one score: the distinct scores still spread evenly."""
    hot = spark.range(198_000).select(F.lit(0.5).alias("score"), (F.col("id") % 2).alias("y"))
    rest = spark.range(2_000).select((F.col("id") / 2_000).alias("score"), (F.col("id") % 3 == 0).cast("long").alias("y"))
    df = hot.unionByName(rest)
    sizes = [r["count"] for r in E.score_ranges(df, "score", "y", n_buckets=16).groupBy("bucket").count().collect()]
    assert sum(sizes) == 2_000 and len(sizes) >= 12 and max(sizes) <= 400


def test_roc_points_start_and_end(spark):
    df = spark.createDataFrame([(0.2, 0), (0.2, 1), (0.9, 1), (0.4, 0)], "score double, y int")
    got = {r["threshold"]: (r["tp"], r["fp"]) for r in E.roc_points(df, "score", "y", n_buckets=3).collect()}
    assert got == {None: (0, 0), 0.9: (1, 0), 0.4: (1, 1), 0.2: (2, 2)}
    assert E.roc_points(df.where("score > 2"), "score", "y").count() == 0


def test_materialized_tables_are_parquet_scans(spark):
    plan = Q.features(spark, SF).select("patientId")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "ReadSchema: struct<patientId" in plan
    assert "ExistingRDD" not in plan


def test_tfidf_vectors_equal_long_form(spark):
    """V4 as ML vectors (no shuffle) equals the long-form weights, document by document."""
    from noteflare.operators import vectors as V
    from noteflare.sources.fixtures import base_table

    docs = base_table(spark, SF, "documents").select("doc_id", "text")
    voc = V.fit_vocabulary(docs.where("doc_id % 5 != 0"), "text", max_features=300, min_df=2)
    long = {}
    for r in V.tfidf(docs, voc, "doc_id", "text").collect():
        long.setdefault(r["doc_id"], {})[r["term_index"]] = r["tfidf"]
    vec = V.tfidf_vectors(V.tokens(docs, "text"), voc).select("doc_id", "text_vec").collect()
    assert len(vec) == docs.count()
    for r in vec:
        v = r["text_vec"]
        got = {int(i): float(x) for i, x in zip(v.indices, v.values)}
        want = long.get(r["doc_id"], {})
        assert got.keys() == want.keys()
        assert all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_roc_curve_is_the_same_curve_in_fewer_rows(spark):
    """Against a brute-force removal of collinear points; same area; any number of ranges."""
    import random

    from noteflare.operators import evaluate as E
    rnd = random.Random(9)
    rows = [(round(rnd.random(), 2), int(rnd.random() < 0.3)) for _ in range(3000)]
    rows += [(2 + i, 1) for i in range(500)] + [(-2.0 - i, i % 2) for i in range(100)]
    df = spark.createDataFrame([(float(a), b) for a, b in rows], "score double, y int").cache()
    full = sorted((r.fp, r.tp) for r in E.roc_points(df, "score", "y").collect())
    want = [p for i, p in enumerate(full) if i in (0, len(full) - 1) or
            (p[0] - full[i - 1][0]) * (full[i + 1][1] - p[1]) != (p[1] - full[i - 1][1]) * (full[i + 1][0] - p[0])]
    for n in (None, 1, 7, 40):
        got = sorted((r.fp, r.tp) for r in E.roc_curve(df, "score", "y", n).collect())
        assert got == want and len(got) < len(full) / 2
    area = lambda ps: sum((b[0] - a[0]) * (a[1] + b[1]) for a, b in zip(ps, ps[1:]))
    assert area(want) == area(full)
    assert E.roc_curve(df.limit(0), "score", "y").count() == 0


def test_patient_records_number_their_parts(spark):
    """A patient with a third of all notes gets many parts; ranks run through them."""
    from noteflare.operators import scoring as S
    n = 3000
    notes = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("patientId"), F.col("id").alias("noteId"),
        F.when(F.col("id") % 7 == 0, None).otherwise(F.timestamp_seconds(F.col("id") % 50)).alias("noteDate"),
        F.round((F.col("id") * 37 % 100) / 100, 3).alias("flare_probability"), F.lit(1).alias("flare_label"),
        F.lit("Low").alias("flare_risk_level"), F.array().cast("array<string>").alias("patient_influences"),
        F.map_from_arrays(F.array(F.lit("k")), F.array(F.lit(1.0))).alias("text_signals"))
    for ranges in (1, 5):
        rows = S.patient_records(notes, max_notes=100, n_ranges=ranges).collect()
        assert sum(len(r.risky_notes) for r in rows) == n and max(len(r.risky_notes) for r in rows) <= 100
        hot = sorted((r for r in rows if r.patientId == -1), key=lambda r: r.part)
        assert [r.part for r in hot] == [*range(1, hot[0].parts + 1)] and len(hot) >= 10
        flat = [x for r in hot for x in r.risky_notes]
        order = lambda x: (-x.flare_probability, x.noteDate is None, str(x.noteDate), x.noteId)
        assert flat == sorted(flat, key=order) and len(flat) == n // 3
        at = 1
        for r in hot:
            assert r.first_rank == at and r.total_notes == n // 3
            at += len(r.risky_notes)
    single = S.patient_records(notes.limit(0))
    assert single.count() == 0
