"""Spark ML path: planted signal, patience, SVD against the exact one, and the registered run."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from noteflare.constants import SAFE_NUMERIC_COLS
from noteflare.operators import evaluate as E
from noteflare.operators import ml
from noteflare.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    return Q.gbt_run(spark, SF)


# ---------------------------------------------------------------------------
# M1, M5
# ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def planted(spark):
    """Labels from a product and a threshold of the features, a tenth of them flipped."""
    rnd = random.Random(1)
    rows = []
    for i in range(4000):
        x = [rnd.gauss(0, 1) for _ in range(6)]
        y = int(x[0] * x[1] + (x[2] > 0.5) > 0.4)
        rows.append((i, x, y if rnd.random() > 0.1 else 1 - y))
    df = spark.createDataFrame(rows, "id long, x array<double>, y int")
    return df.withColumns({"features": array_to_vector("x"), "weight": F.lit(1.0)}).repartition(4).cache()


@pytest.fixture(scope="module")
def fit(planted):
    p = ml.GbtParams(max_iter=100, patience=12, step_size=0.3, max_depth=3)
    return ml.fit_gbt(planted.where("id % 4 < 2"), planted.where("id % 4 = 2"), "y", "weight", p)


def test_planted_signal_is_learned(planted, fit):
    test = ml.positive_probability(fit.model.transform(planted.where("id % 4 = 3")))
    assert E.roc_auc(test, "p", "y").first()["auc"] > 0.8
    assert fit.model.getNumTrees == fit.best_round > 1


def test_one_worse_round_does_not_end_the_fit(fit):
    auc = fit.validation_auc
    assert any(b < a for a, b in zip(auc[:fit.best_round], auc[1:fit.best_round]))
    assert fit.rounds_fitted == len(auc) >= min(100, fit.best_round + 12)
    assert auc[fit.best_round - 1] >= max(auc[:fit.best_round + 12])


def test_best_round_by_patience():
    assert ml.best_round([.6, .5, .7, .6, .6], 3) == (3, False)
    assert ml.best_round([.6, .5, .7, .6, .6, .6], 3) == (3, True)
    assert ml.best_round([.6, .5, .5, .5, .9], 3) == (1, True)
    assert ml.best_round([math.nan, .5, .4], 5) == (2, False)
    assert ml.best_round([.6, .6, .6], 2) == (1, True)


def test_prefix_auc_equals_the_cut_models_own(planted, fit):
    rows = planted.where("id % 4 = 2")
    auc = ml.prefix_auc(rows, fit.model, "y", bins=1 << 16)
    for n in {1, 2, fit.best_round}:
        own = ml.positive_probability(ml.cut_model(fit.model, n).transform(rows))
        assert abs(E.roc_auc(own, "p", "y").first()["auc"] - auc[n - 1]) < 1e-4
    assert all(abs(a - b) < 2e-3 for a, b in zip(auc, ml.prefix_auc(rows, fit.model, "y")))
    assert all(math.isnan(a) for a in ml.prefix_auc(rows.where("y = 1"), fit.model, "y"))


def test_split_counts_equal_a_walk(fit):
    want = {}

    def walk(node):
        if node.getClass().getSimpleName() == "InternalNode":
            n, gain = want.get(node.split().featureIndex(), (0, 0.0))
            want[node.split().featureIndex()] = n + 1, gain + node.gain()
            walk(node.leftChild())
            walk(node.rightChild())

    for tree in fit.model._java_obj.trees():
        walk(tree.rootNode())
    got = {int(r.feature[1:]): (r.n_splits, r.total_gain) for r in ml.split_counts(fit.model, [f"f{i}" for i in range(6)]).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] == n and abs(got[i][1] - g) < 1e-9 for i, (n, g) in want.items())


def test_calibration_brings_scores_to_rates(planted, fit):
    scored = ml.positive_probability(fit.model.transform(planted))
    platt = ml.fit_platt(scored.where("id % 4 = 2"), "y")
    out = ml.calibrate(scored.where("id % 4 = 3"), platt)
    assert out.columns[-2:] == ["p", "p_calibrated"]
    r = out.agg(F.avg("p_calibrated").alias("p"), F.avg("y").alias("y"), F.corr("p", "p_calibrated").alias("c")).first()
    assert abs(r.p - r.y) < 0.05 and r.c > 0.9
    w, b = float(platt.stages[1].coefficients[0]), platt.stages[1].intercept  # the sigmoid, by hand
    for row in out.select("rawPrediction", "p_calibrated").limit(50).collect():
        assert abs(row.p_calibrated - 1 / (1 + math.exp(-(w * row.rawPrediction[1] + b)))) < 1e-12


def test_refits_stay_few():
    """A curve still rising at the end of the first fit is followed further; no fit stops just short of the limit."""
    def grown(best_of, search, max_iter=1000, first=62):
        total, length, shown = 0, 0, first
        while True:
            if shown > length:
                length = ml.next_length(shown, first, best_of(length), max_iter)
                assert shown <= length <= max_iter
                total += length
            if shown >= min(search, max_iter):
                return total
            shown = min(max_iter, 2 * shown)

    rising, early = (lambda n: n), (lambda n: n // 4)
    assert grown(rising, 62) == 62 and grown(early, 124) == 62 + 124
    assert grown(rising, 248) == 62 + 248  # 434 by doubling
    assert grown(rising, 1000) == 62 + 248 + 496 + 1000  # 2,922 by doubling
    assert grown(early, 62, max_iter=62) == 62 and grown(rising, 70, max_iter=70) == 62 + 70


# ---------------------------------------------------------------------------
# V5, V7
# ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def sparse(spark):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((400, 12)) @ (np.diag(2.0 ** -np.arange(12)) @ rng.standard_normal((12, 80)))
    a[rng.random(a.shape) < 0.6] = 0
    a[7] = 0
    from pyspark.ml.linalg import Vectors
    rows = [(i, Vectors.sparse(80, {int(j): float(r[j]) for j in np.flatnonzero(r)})) for i, r in enumerate(a)]
    rows[5] = (5, Vectors.dense(a[5]))
    return a, spark.createDataFrame(rows, ["id", "v"]).repartition(5).cache()


def test_svd_agrees_with_the_exact_one(sparse):
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils
    a, df = sparse
    model = ml.fit_svd(df, 80, "v", k=8)
    exact = RowMatrix(MLUtils.convertVectorColumnsFromML(df.select("v"), "v").rdd.map(lambda r: r[0])).computeSVD(8)
    assert np.allclose(model.s[:4], exact.s.toArray()[:4], rtol=1e-3)
    assert np.allclose(model.s, exact.s.toArray(), rtol=1e-2)  # a flat spectrum: most entries were struck out
    assert np.allclose(ml.fit_svd(df, 80, "v", k=8, power=12).s, exact.s.toArray(), rtol=1e-3)
    assert np.allclose(model.v.T @ model.v, np.eye(8), atol=1e-9)
    again = ml.fit_svd(df, 80, "v", k=8)
    assert np.allclose(model.v, again.v, atol=1e-9) and np.allclose(model.s, again.s)
    assert ml.fit_svd(df, 80, "v", k=400).k == 80


def test_projection_is_row_wise(sparse):
    a, df = sparse
    model = ml.fit_svd(df, 80, "v", k=4)
    out = ml.svd_stage(model, "v", "z").transform(df)
    assert "Exchange" not in out.select("id", "z")._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    for r in out.select("id", vector_to_array("z").alias("z")).collect():
        assert np.allclose(r.z, a[r.id] @ model.v, atol=1e-9)


def test_numeric_inputs_are_scaled(run):
    x = vector_to_array("features")
    n = len(SAFE_NUMERIC_COLS)
    train = run["data"].where(F.col("split") == "train")
    row = train.agg(*[f(x[i]).alias(f"{name}{i}") for i in range(n) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    assert all(abs(row[f"m{i}"]) < 1e-9 for i in range(n))
    assert all(abs(row[f"s{i}"] - 1) < 1e-9 or row[f"s{i}"] == 0 for i in range(n)) and row["s0"] > 0


# ---------------------------------------------------------------------------
# the registered run
# ---------------------------------------------------------------------------

def test_test_fold_scored(spark, run):
    rows = Q.QUERIES["gbt_train_eval"](spark, SF).collect()
    assert rows, "test fold is empty"
    assert all(0.0 <= r["probability"] <= 1.0 and r["prediction"] == int(r["probability"] > 0.5) for r in rows)


def test_folds_are_apart(run):
    data = run["data"]
    assert data.where("(split = 'test') != (fold = 'test')").count() == 0
    assert data.groupBy("patientId").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert {r.fold for r in data.select("fold").distinct().collect()} == {"grow", "stop", "calibrate", "test"}


def test_rounds_and_patience_are_reported(spark, run):
    m = {r.metric: r.value for r in Q.QUERIES["gbt_metrics"](spark, SF).collect()}
    curve = {r.round: r.validation_auc for r in Q.QUERIES["gbt_rounds"](spark, SF).collect()}
    assert m["patience"] == 50 and m["rounds_fitted"] == len(curve) >= 51
    assert m["validation_auc"] == curve[m["best_round"]] and run["model"].getNumTrees == m["best_round"]


def test_importances_written_and_read_back(spark, run):
    imp = Q.QUERIES["feature_importance"](spark, SF).collect()
    want = ml.feature_importance(run["model"], run["names"], top=20).collect()
    assert 0 < len(imp) <= 20 and [tuple(r) for r in imp] == [tuple(r) for r in want]
    assert len(Q.QUERIES["svd_project"](spark, SF).first()["svd"]) == run["svd"].k


def test_influences_over_the_whole_vector(spark, run):
    """The five largest by size, then SVD components as text_signal, then each name once, against brute force."""
    from noteflare.operators import model as M
    x, names = vector_to_array("features"), run["names"]
    wide = run["data"].select("noteId", "split", "flare_label_next", x.alias("x")).select(
        "noteId", "split", "flare_label_next", *[F.col("x")[i].alias(n) for i, n in enumerate(names)])
    scorer = M.fit_linear_scorer(wide.where("split = 'train'"), "flare_label_next", names)
    got = {}
    for r in Q.QUERIES["model_influences"](spark, SF).orderBy("noteId", "position").collect():
        got.setdefault(r.noteId, []).append((r.feature, r.impact))
    seen_text = 0
    for r in scorer.transform(wide).select("noteId", scorer.contributions().alias("c")).collect():
        ranked = sorted(((abs(s.impact), i, s) for i, s in enumerate(r.c)), key=lambda t: (-t[0], -t[1]))[:5]
        want = []
        for _, _, s in ranked:
            name = "text_signal" if s.feature.startswith("svd_") else s.feature
            if name not in [n for n, _ in want]:
                want.append((name, round(s.impact, 4)))
        seen_text += any(n == "text_signal" for n, _ in want)
        assert [n for n, _ in got[r.noteId]] == [n for n, _ in want]
        assert all(abs(a - b) < 1.1e-4 for (_, a), (_, b) in zip(got[r.noteId], want))
    assert seen_text > 0


def test_kept_tables_can_be_forgotten(spark):
    first = Q.tables(spark, SF)
    assert Q.tables(spark, SF) is first
    kept = dict(Q._TABLES), dict(Q._MATERIALIZED), dict(Q._SCORERS), dict(Q._FITS)
    Q.clear_session_tables()
    assert Q.tables(spark, SF) is not first
    for now, before in zip((Q._TABLES, Q._MATERIALIZED, Q._SCORERS, Q._FITS), kept):
        now.update(before)
