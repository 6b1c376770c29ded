"""Spark ML path (V5, V7, M1, M2, M4, M5).

* V5 truncated SVD: a seeded randomised range finder.  Each power step is one pass in which tasks fold their rows into
  ``A'A G`` (vocabulary x l numbers a task, whatever its rows); a last ``tallSkinnyQR`` of ``A G`` gives the
  singular values.  The projection ``X V`` is a row-wise ML stage: no exchange.
* V7: numeric inputs scaled with the training mean and deviation, then the SVD components, assembled into one vector.
* M1: boosted trees with patience.  Spark's own early stop ends at the first worse round; here the ensemble is
  fitted without it, every prefix of it is scored on a validation slice of the *training* patients in one pass, and the
  model is cut at the best round (the test fold stays unseen).
* M4: Platt scaling, fitted on a third slice that neither grew nor stopped the trees.
* M5: feature importances, and split counts and gains from the saved trees' node table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.common import _py2java
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    NGram,
    Normalizer,
    PCAModel,
    SQLTransformer,
    StopWordsRemover,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteflare.constants import ENGLISH_STOP_WORDS, SAFE_NUMERIC_COLS, SPLIT_SEED, SVD_COMPONENTS
from noteflare.operators.vectors import TOKEN_PATTERN, Scaler
from noteflare.session import ensure_checkpoint_dir, ship_package

# ---------------------------------------------------------------------------
# V5: truncated SVD
# ---------------------------------------------------------------------------

POWER_STEPS = 4
OVERSAMPLE = 10
_BLOCK = 16  # numbers a shuffled row while partial products are added up


@dataclass(frozen=True)
class SvdModel:
    v: np.ndarray  # n_features x k right singular vectors: bounded by the vocabulary
    s: np.ndarray  # k singular values, largest first

    @property
    def k(self) -> int:
        return self.v.shape[1]


def _entries(vectors: DataFrame, vec_col: str) -> DataFrame:
    """(at, x): the entries of each ML vector, sparse or dense, as plain arrays."""
    u = F.unwrap_udt(vec_col)
    every = F.sequence(F.lit(0), F.size(u["values"]) - 1)
    at = F.when(u["type"] == 0, u["indices"]).when(F.size(u["values"]) > 0, every).otherwise(F.array().cast("array<int>"))
    return vectors.select(at.alias("at"), u["values"].alias("x"))


def _fold(at: np.ndarray, x: np.ndarray, lengths: np.ndarray, basis: np.ndarray, into: np.ndarray) -> None:
    """Add ``rows' (rows basis)`` to ``into``, for sparse rows given by their entries."""
    full = lengths > 0
    starts = (np.cumsum(lengths) - lengths)[full]
    if not len(starts):
        return
    projected = np.add.reduceat(x[:, None] * basis[at], starts, axis=0)
    back = x[:, None] * np.repeat(projected, lengths[full], axis=0)
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
    into[at[order][first]] += np.add.reduceat(back[order], first, axis=0)


def gram_product(entries: DataFrame, basis: np.ndarray) -> np.ndarray:
    """``A'A basis`` for the rows of ``entries``: one pass, partial products of tasks added up by row and block."""
    n_features, width = basis.shape
    blocks = -(-width // _BLOCK)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(basis.shape)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):  # bounds the dense products
                part = batch.slice(lo, 512)
                at, x = part.column("at").flatten(), part.column("x").flatten()
                lengths = np.asarray(part.column("at").value_lengths().fill_null(0))
                _fold(np.asarray(at), np.asarray(x), lengths, basis, total)
        used = np.flatnonzero(np.abs(total).any(1))
        padded = np.zeros((len(used), blocks * _BLOCK))
        padded[:, :width] = total[used]
        cells = pa.array(padded.reshape(-1), type=pa.float64())
        offsets = pa.array(np.arange(0, len(cells) + 1, _BLOCK, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(used, blocks).astype(np.int32)), pa.array(np.tile(np.arange(blocks, dtype=np.int32), len(used))),
            pa.ListArray.from_arrays(offsets, cells)], names=["row", "block", "z"])

    ship_package(entries.sparkSession)
    parts = entries.mapInArrow(partial, "row int, block int, z array<double>")
    sums = parts.groupBy("row", "block").agg(*[F.sum(F.get("z", F.lit(i))).alias(f"z{i}") for i in range(_BLOCK)])
    out = np.zeros((n_features, blocks * _BLOCK))
    for r in sums.collect():  # vocabulary x l numbers, whatever the documents
        out[r["row"], r["block"] * _BLOCK:(r["block"] + 1) * _BLOCK] = r[2:]
    return out[:, :width]


def fit_svd(train_vectors: DataFrame, n_features: int, vec_col: str = "text_vec", k: int = SVD_COMPONENTS,
            power: int = POWER_STEPS, oversample: int = OVERSAMPLE, seed: int = SPLIT_SEED) -> SvdModel:
    """Fit V5 on the training TF-IDF vectors (``vec_col``, Spark ML vectors) in ``power + 1`` passes.

    ``k`` is capped at the number of features; components beyond the rank have singular value 0.  Pass a materialised frame.
    """
    from pyspark.mllib.common import callMLlibFunc
    from pyspark.mllib.linalg import DenseMatrix as RowBasis
    from pyspark.mllib.linalg.distributed import IndexedRowMatrix
    from pyspark.mllib.util import MLUtils

    k = max(1, min(k, n_features))
    width = min(n_features, k + oversample)
    entries = _entries(train_vectors, vec_col)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_features, width)))[0]
    for _ in range(power):
        basis = np.linalg.qr(gram_product(entries, basis))[0]
    rows = MLUtils.convertVectorColumnsFromML(
        train_vectors.select(F.lit(0).cast("long").alias("index"), F.col(vec_col).alias("vector")), "vector")
    matrix = IndexedRowMatrix(callMLlibFunc("createIndexedRowMatrix", rows, 0, int(n_features))).toRowMatrix()
    tall = matrix.multiply(RowBasis(n_features, width, basis.reshape(-1, order="F")))
    s, w = np.linalg.svd(tall.tallSkinnyQR(computeQ=False).R.toArray())[1:]
    v = (basis @ w.T)[:, :k]
    # Fix the sign of each component (largest |entry| positive) so results are stable.
    largest = v[np.abs(v).argmax(0), np.arange(v.shape[1])]
    return SvdModel(v * np.where(largest < 0, -1.0, 1.0), s[:k])


def svd_stage(model: SvdModel, vec_col: str = "text_vec", out_col: str = "svd_vec") -> PCAModel:
    """The projection ``X V`` as a row-wise ML stage (a projection on given axes, without centring)."""
    sc = SparkSession.getActiveSession().sparkContext
    axes = DenseMatrix(model.v.shape[0], model.k, model.v.reshape(-1, order="F"))
    java = sc._jvm.org.apache.spark.ml.feature.PCAModel(
        "svd_" + uuid.uuid4().hex[:12], _py2java(sc, axes), _py2java(sc, Vectors.dense(model.s)))
    java.set(java.getParam("k"), model.k)
    return PCAModel(java).setInputCol(vec_col).setOutputCol(out_col)


# ---------------------------------------------------------------------------
# V2, V4, V5, V6, V7 as one row-wise pipeline
# ---------------------------------------------------------------------------

def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def text_stages(vocabulary: Sequence[tuple[str, float]], text_col: str = "tfidf_text", out_col: str = "text_vec") -> list[Transformer]:
    """Text to TF-IDF vectors by a fitted vocabulary of (term, idf), alphabetical: all JVM stages, row by row."""
    return [
        SQLTransformer(statement=f"SELECT *, regexp_extract_all(lower(coalesce(`{text_col}`, '')), '{_quoted(TOKEN_PATTERN)}', 0) "
                                 "AS _words_all FROM __THIS__"),
        StopWordsRemover(inputCol="_words_all", outputCol="_words", stopWords=list(ENGLISH_STOP_WORDS), caseSensitive=True),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        SQLTransformer(statement="SELECT * EXCEPT (_words_all, _words, _pairs), concat(_words, _pairs) AS _terms FROM __THIS__"),
        CountVectorizerModel.from_vocabulary([t for t, _ in vocabulary], inputCol="_terms", outputCol="_tf"),
        ElementwiseProduct(scalingVec=Vectors.dense([float(i) for _, i in vocabulary]), inputCol="_tf", outputCol="_tfidf"),
        Normalizer(p=2.0, inputCol="_tfidf", outputCol=out_col),
        SQLTransformer(statement="SELECT * EXCEPT (_terms, _tf, _tfidf) FROM __THIS__"),
    ]


def vector_stages(svd: SvdModel, scaler: Scaler, numeric: Sequence[str] = SAFE_NUMERIC_COLS, vec_col: str = "text_vec",
                  out_col: str = "features") -> list[Transformer]:
    """V6 + V7: scaled numeric inputs (missing -> 0 before scaling), then the SVD components, in one vector."""
    scaled = ", ".join(f"(coalesce(cast(`{c}` AS double), 0D) - {scaler.mean[c]!r}D) / {scaler.scale[c]!r}D AS `_z_{c}`" for c in numeric)
    drop = ", ".join(f"`_z_{c}`" for c in numeric)
    return [
        svd_stage(svd, vec_col, "svd_vec"),
        SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"),
        VectorAssembler(inputCols=[f"_z_{c}" for c in numeric] + ["svd_vec"], outputCol=out_col, handleInvalid="error"),
        SQLTransformer(statement=f"SELECT * EXCEPT ({drop}) FROM __THIS__"),
    ]


def feature_names(numeric: Sequence[str] = SAFE_NUMERIC_COLS, k: int = 0) -> list[str]:
    return list(numeric) + [f"svd_{i}" for i in range(k)]


# ---------------------------------------------------------------------------
# M1: boosted trees with patience
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class GbtParams:
    max_iter: int = 1000
    patience: int = 50
    step_size: float = 0.05
    max_depth: int = 5
    subsampling_rate: float = 0.8
    feature_subset: str = "0.8"
    validation_fraction: float = 0.2
    calibration_fraction: float = 0.1
    seed: int = SPLIT_SEED


@dataclass(frozen=True)
class BoostedFit:
    model: GBTClassificationModel  # cut at the best round
    rounds_fitted: int  # length of the curve
    best_round: int  # 1-based
    validation_auc: list[float]  # of the first 1, 2, ... trees


def fold_column(p: GbtParams = GbtParams(), key: str = "patientId") -> F.Column:
    """'grow', 'stop' or 'calibrate': three slices of the training patients, by a seeded hash."""
    h = F.md5(F.concat(F.lit(f"valid:{p.seed}:"), F.col(key).cast("string")))
    upto = lambda share: F.lit(format(min(int(round(share * 16 ** 8)), 16 ** 8 - 1), "08x"))
    return (F.when(h < upto(p.validation_fraction), "stop")
            .when(h < upto(p.validation_fraction + p.calibration_fraction), "calibrate").otherwise("grow"))


def tree_nodes(model: GBTClassificationModel) -> DataFrame:
    """(tree, node, feature, threshold, gain, left, right, prediction, rows, weight) from the saved model.

    Leaves have a null feature, threshold and gain.  Splits on categories have a null threshold.
    """
    spark = SparkSession.getActiveSession()
    path = f"{ensure_checkpoint_dir(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    n = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    inner = F.col("leftChild") >= 0
    weights = spark.createDataFrame(list(enumerate(model.treeWeights)), "tree int, weight double")
    nodes = n.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"), F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner & (F.col("split.numCategories") == -1), F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(inner, F.col("gain")).alias("gain"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        "prediction", F.col("rawCount").alias("rows"))
    return nodes.join(F.broadcast(weights), "tree")  # a row a tree


class _FlatTrees:
    """All trees as arrays, so that rows walk every tree at once."""

    def __init__(self, nodes: list, depth: int):
        trees = max((r["tree"] for r in nodes), default=-1) + 1
        shape = (trees, max((r["node"] for r in nodes), default=0) + 1)
        self.depth, self.feature = depth, np.zeros(shape, dtype=np.int64)
        self.threshold, self.leaf = np.full(shape, np.inf), np.zeros(shape)
        own = np.broadcast_to(np.arange(shape[1]), shape)
        self.left, self.right = own.copy(), own.copy()  # leaves lead to themselves
        for r in nodes:
            at = r["tree"], r["node"]
            self.leaf[at] = r["prediction"] * r["weight"]
            if r["feature"] is not None:
                if r["threshold"] is None:
                    raise ValueError("trees over categories are not walked here")
                self.feature[at], self.threshold[at], self.left[at], self.right[at] = (
                    r["feature"], r["threshold"], r["left"], r["right"])
        used = [[r for r in nodes if r["tree"] == t and r["feature"] is None] for t in range(trees)]
        leaves = [[r["prediction"] * r["weight"] for r in rows] for rows in used]
        self.low, self.high = np.cumsum([min(x) for x in leaves]), np.cumsum([max(x) for x in leaves])

    def margins(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the margin after the first 1, 2, ... trees."""
        t = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        for _ in range(self.depth):
            here = np.take_along_axis(x, self.feature[t, node], axis=1)
            node = np.where(here <= self.threshold[t, node], self.left[t, node], self.right[t, node])
        return np.cumsum(self.leaf[t, node], axis=1)


def prefix_auc(rows: DataFrame, model: GBTClassificationModel, label: str, features_col: str = "features",
               bins: int = 1024) -> list[float]:
    """Validation AUC of the first 1, 2, ... trees, in one pass over ``rows``.

    A row's margins are prefix sums over its leaves.  Tasks count labels by round and margin bin (``bins`` between
    the least and largest margin the round's trees can give), so what they send does not grow with their rows.  Margins of one bin count as
    tied; no round is told apart by less than that.  NaN if a class is missing.
    """
    trees = _FlatTrees(tree_nodes(model).collect(), model.getMaxDepth())  # the model's own parameters

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_trees = len(trees.low)
        counts = np.zeros((n_trees * bins, 2), dtype=np.int64)
        scale = bins / np.maximum(trees.high - trees.low, 1e-300)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                flat = np.asarray(part.column("x").flatten())
                y = np.asarray(part.column("y"))
                if not len(y):
                    continue
                at = np.clip(((trees.margins(flat.reshape(len(y), -1)) - trees.low) * scale).astype(np.int64), 0, bins - 1)
                cells = (at + np.arange(n_trees) * bins).ravel()
                for c in (0, 1):
                    counts[:, c] += np.bincount(cells[np.repeat(y == c, n_trees)], minlength=len(counts))
        used = np.flatnonzero(counts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array((used // bins).astype(np.int32)), pa.array((used % bins).astype(np.int32)),
                                          pa.array(counts[used, 0]), pa.array(counts[used, 1])], names=["round", "bin", "neg", "pos"])

    ship_package(rows.sparkSession)
    binned = (rows.select(vector_to_array(features_col).alias("x"), F.col(label).cast("int").alias("y"))
              .mapInArrow(count, "round int, bin int, neg long, pos long")
              .groupBy("round", "bin").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")))
    below = F.sum("neg").over(Window.partitionBy("round").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    ranked = binned.withColumn("below", F.coalesce(below, F.lit(0)))  # at most ``bins`` rows a round
    area = ranked.groupBy("round").agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("wins"),
                                       F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    found = {r["round"]: r["wins"] / (r["pos"] * r["neg"]) if r["pos"] and r["neg"] else float("nan") for r in area.collect()}
    return [found.get(i, float("nan")) for i in range(len(trees.low))]


def best_round(auc: Sequence[float], patience: int) -> tuple[int, bool]:
    """(1-based best round, whether ``patience`` rounds without a better one have followed it)."""
    best = 0
    for i, a in enumerate(auc):
        if a > auc[best] or auc[best] != auc[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def cut_model(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The model of the first ``rounds`` trees."""
    sc = SparkSession.getActiveSession().sparkContext
    trees = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = sc._gateway.new_array(sc._jvm.double, rounds)
    for i, (tree, w) in enumerate(zip(model._java_obj.trees(), model.treeWeights[:rounds])):
        trees[i], weights[i] = tree, w
    java = sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        model.uid, trees, weights, model.numFeatures, 2)
    cut = GBTClassificationModel(java.copy(model._java_obj.extractParamMap()))
    cut._transfer_params_from_java()
    return cut


def fit_gbt(grow: DataFrame, stop: DataFrame, label: str, weight_col: str, p: GbtParams = GbtParams()) -> BoostedFit:
    """M1: boosted trees grown on ``grow``, cut at the round with the best AUC on ``stop``.

    The ensemble is fitted without early stopping, first ``patience`` rounds and a few more, then
    longer until ``patience`` rounds without a better one have followed the best (or ``max_iter``).  The seed fixes
    every tree, so a longer fit begins with the shorter one's trees, all of which are grown again
    (:func:`next_length` keeps such fits few).  The search goes on by doublings: the
    curve ends at the first of them that holds the patience, however many rounds the last fit has.
    """
    first = min(p.max_iter, p.patience + max(8, p.patience // 4))
    shown, best, auc = first, 0, []
    while True:
        if shown > len(auc):
            rounds = next_length(shown, first, best, p.max_iter)
            model = GBTClassifier(
                labelCol=label, featuresCol="features", weightCol=weight_col, maxIter=rounds, stepSize=p.step_size,
                maxDepth=p.max_depth, subsamplingRate=p.subsampling_rate, featureSubsetStrategy=p.feature_subset,
                seed=p.seed).fit(grow)
            auc = prefix_auc(stop, model, label)
        best, over = best_round(auc[:shown], p.patience)
        if over or shown >= p.max_iter:
            return BoostedFit(cut_model(model, best), shown, best, auc[:shown])
        shown = min(p.max_iter, 2 * shown)


def next_length(needed: int, first: int, best: int, max_iter: int) -> int:
    """Rounds of the next fit, at least ``needed``: twice that after a first fit whose best round is among its last quarter, and
    ``max_iter`` once more than half of it is due."""
    length = 2 * needed if needed == 2 * first and 4 * best > 3 * first else needed
    return max_iter if 2 * length > max_iter and needed > first else min(length, max_iter)


def positive_probability(df: DataFrame, prob_vec: str = "probability", out_col: str = "p") -> DataFrame:
    """M2: probability of class 1 from the model's probability vector."""
    return df.withColumn(out_col, vector_to_array(prob_vec)[1])


# ---------------------------------------------------------------------------
# M4, M5
# ---------------------------------------------------------------------------

def fit_platt(held_scored: DataFrame, label: str) -> PipelineModel:
    """M4: sigmoid calibration, fitted on the margins of rows the trees never saw (the logit is twice the margin)."""
    margin = VectorSlicer(inputCol="rawPrediction", outputCol="_margin", indices=[1])
    lr = LogisticRegression(featuresCol="_margin", labelCol=label, predictionCol="_cal_pred",
                            probabilityCol="_cal_prob", rawPredictionCol="_cal_raw", regParam=0.0)
    return Pipeline(stages=[margin, lr]).fit(held_scored)


def calibrate(scored: DataFrame, platt: PipelineModel, out_col: str = "p_calibrated") -> DataFrame:
    """``scored`` (with the model's ``rawPrediction``) and the calibrated probability."""
    return calibrated_probability(platt.transform(scored), out_col)


def calibrated_probability(df: DataFrame, out_col: str = "p_calibrated") -> DataFrame:
    return df.withColumn(out_col, vector_to_array("_cal_prob")[1]).drop("_margin", "_cal_pred", "_cal_prob", "_cal_raw")


def feature_importance(model: GBTClassificationModel, names: Sequence[str], top: int | None = 20) -> DataFrame:
    """M5: the ``top`` features by importance (a report; the full list is ``top=None``)."""
    spark = SparkSession.getActiveSession()
    imp = model.featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, imp)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    ordered = df.orderBy(F.col("importance").desc(), F.col("feature").asc())
    return ordered.limit(top) if top else ordered


def split_counts(model: GBTClassificationModel, names: Sequence[str]) -> DataFrame:
    """M5: (feature, n_splits, total_gain, n_trees) of the features that split a node of the saved trees."""
    spark = SparkSession.getActiveSession()
    named = F.broadcast(spark.createDataFrame(list(enumerate(names)), "index int, name string"))  # a row a feature
    inner = tree_nodes(model).where(F.col("feature").isNotNull())
    return (inner.join(named, F.col("feature") == F.col("index")).groupBy(F.col("name").alias("feature"))
            .agg(F.count(F.lit(1)).alias("n_splits"), F.sum("gain").alias("total_gain"),
                 F.countDistinct("tree").alias("n_trees")))
