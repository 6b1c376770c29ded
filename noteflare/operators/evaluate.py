"""Evaluation (E1-E5): confusion, classification report, exact ROC-AUC and curve.

ROC needs, for every distinct score, the number of negatives (and
positives) scoring below it: a cumulative sum in score order.  A single
global window would put every distinct score in one task, so the order is
cut into ranges of distinct scores:

1. rows are reduced to ``(group, score) -> pos, neg`` (map-side combined),
   so a hot score is one row;
2. those rows are range-partitioned by (group, score) and written once with
   their range's number.  Ranges hold about as many distinct scores each, whatever
   the rows a score has, and their number follows the session's shuffle
   partitions;
3. per-range totals get their running offsets from a small window;
4. a window over a range's distinct scores adds the local running sum.

The result is exact, and the scored rows are read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteflare.operators.joins import bounded
from noteflare.session import materialize


def _counts(df: DataFrame, label: str, pred: str) -> DataFrame:
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    return df.agg(
        F.sum(((y == 1) & (p == 1)).cast("long")).alias("tp"),
        F.sum(((y == 0) & (p == 1)).cast("long")).alias("fp"),
        F.sum(((y == 1) & (p == 0)).cast("long")).alias("fn"),
        F.sum(((y == 0) & (p == 0)).cast("long")).alias("tn"),
    ).na.fill(0)


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """The full 2x2 grid (zero cells included) from one aggregate."""
    c = _counts(df, label, pred)
    cell = lambda a, p, n: F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"),
                                    F.col(n).alias("n"))
    return c.select(F.inline(F.array(cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp"))))


def _div(a: Column, b: Column) -> Column:
    """a / b with 0 when b is 0 (the report's zero-division rule)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def _f1(p: Column, r: Column) -> Column:
    return F.when((p + r) == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r))


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and weighted avg.

    Rows ``0``, ``1``, ``accuracy``, ``macro avg``, ``weighted avg``; the accuracy
    row carries accuracy in ``f1`` and NULL precision/recall.
    """
    c = _counts(df, label, pred)
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    s1, s0 = tp + fn, tn + fp
    n = s1 + s0
    p1, r1 = _div(tp, tp + fp), _div(tp, s1)
    p0, r0 = _div(tn, tn + fn), _div(tn, s0)
    f1, f0 = _f1(p1, r1), _f1(p0, r0)
    acc = _div(tp + tn, n)

    def row(name: str, p: Column | None, r: Column | None, f: Column, s: Column) -> Column:
        none = F.lit(None).cast("double")
        return F.struct(F.lit(name).alias("class"), (p if p is not None else none).alias("precision"),
                        (r if r is not None else none).alias("recall"), f.alias("f1"),
                        s.cast("long").alias("support"))

    wavg = lambda a, b: _div(a * s0 + b * s1, n)
    return c.select(F.inline(F.array(
        row("0", p0, r0, f0, s0),
        row("1", p1, r1, f1, s1),
        row("accuracy", None, None, acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", wavg(p0, p1), wavg(r0, r1), wavg(f0, f1), n),
    )))


def score_ranges(df: DataFrame, score: str, label: str, by: Sequence[str] = (),
                 n_buckets: int | None = None) -> DataFrame:
    """``*by, score, pos, neg, bucket``: distinct scores with their range's number, written once.

    Numbers rise with (group, score).  ``n_buckets`` defaults to the session's
    shuffle partitions.
    """
    by = list(by)
    y = F.col(label).cast("long")
    per_score = df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg"))
    ranged = (per_score.repartitionByRange(n_buckets, *by, "score") if n_buckets
              else per_score.repartitionByRange(*by, "score"))
    return materialize(ranged.withColumn("bucket", F.spark_partition_id()), "roc-scores")


def score_ranks(df: DataFrame, score: str, label: str, by: Sequence[str] = (),
                n_buckets: int | None = None, keep_bucket: bool = False) -> DataFrame:
    """Per (group, distinct score): pos, neg, the positives/negatives below it, and the group's totals.

    Output columns: ``*by, score, pos, neg, pos_below, neg_below, pos_all, neg_all``.
    """
    by = list(by)
    keyed = score_ranges(df, score, label, by, n_buckets)
    totals = keyed.groupBy(*by, "bucket").agg(F.sum("pos").alias("b_pos"), F.sum("neg").alias("b_neg"))
    group = Window.partitionBy(*by)
    before = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(f"_o_{c}") for c in by], F.col("bucket").alias("_o_bucket"),
                            F.coalesce(F.sum("b_pos").over(before), F.lit(0)).alias("pos_off"),
                            F.coalesce(F.sum("b_neg").over(before), F.lit(0)).alias("neg_off"),
                            F.sum("b_pos").over(group).alias("pos_all"), F.sum("b_neg").over(group).alias("neg_all"))
    # Without groups there is one offset row per range; with groups their number grows, so Spark picks the join.
    side = offsets if by else bounded(offsets)
    on = F.col("bucket") == F.col("_o_bucket")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    inside = Window.partitionBy(*by, "bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    return keyed.join(side, on).select(
        *by, "score", "pos", "neg",
        (F.col("pos_off") + F.coalesce(F.sum("pos").over(inside), F.lit(0))).alias("pos_below"),
        (F.col("neg_off") + F.coalesce(F.sum("neg").over(inside), F.lit(0))).alias("neg_below"),
        "pos_all", "neg_all", *(["bucket"] if keep_bucket else []),
    )


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = (),
            n_buckets: int | None = None) -> DataFrame:
    """Exact ROC-AUC (ties count one half) per group: ``*by, n_pos, n_neg, auc``.

    AUC is NULL when a group has only one class.
    """
    by = list(by)
    r = score_ranks(df, score, label, by, n_buckets)
    agg = r.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") * F.lit(0.5))).alias("_num"))
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                 F.col("_num") / (F.col("n_pos") * F.col("n_neg")))
    return agg.select(*by, "n_pos", "n_neg", auc.alias("auc"))


def roc_points(df: DataFrame, score: str, label: str, n_buckets: int | None = None) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr) for every distinct score as threshold
    (a note is positive when its score >= threshold), and the curve's start at
    (0, 0), whose threshold lies above every score (NULL).

    A rate is NULL where its class has no rows; without rows there is no curve."""
    return _points(score_ranks(df, score, label, (), n_buckets))


def _points(r: DataFrame) -> DataFrame:
    p_all, n_all = F.col("pos_all"), F.col("neg_all")
    point = lambda t, tp, fp: F.struct(
        t.alias("threshold"), tp.cast("long").alias("tp"), fp.cast("long").alias("fp"),
        F.try_divide(tp, p_all).alias("tpr"), F.try_divide(fp, n_all).alias("fpr"))
    own = point(F.col("score"), p_all - F.col("pos_below"), n_all - F.col("neg_below"))
    start = point(F.lit(None).cast("double"), F.lit(0), F.lit(0))
    lowest = (F.col("pos_below") == 0) & (F.col("neg_below") == 0)
    return r.select(F.inline(F.when(lowest, F.array(own, start)).otherwise(F.array(own))))


def roc_curve(df: DataFrame, score: str, label: str, n_buckets: int | None = None) -> DataFrame:
    """E4 without collinear points: the same curve and area as ``roc_points``, usually in far fewer rows.

    A point goes if the step to it and the step after it have the same direction.  Steps are compared as
    whole numbers, so no rounding keeps or drops a point.  The step after a range's lowest score is the
    first of the next range below: one border row a range is exchanged.
    """
    r = score_ranks(df, score, label, (), n_buckets, keep_bucket=True)
    edge = r.groupBy("bucket").agg(F.max_by(F.struct("pos", "neg"), "score").alias("top"))
    below = Window.orderBy("bucket")  # one row a range
    border = bounded(edge.select("bucket", F.lag("top").over(below).alias("top_below")))
    inside = F.lag(F.struct("pos", "neg")).over(Window.partitionBy("bucket").orderBy("score"))
    r = r.withColumn("next", inside).join(border, "bucket").withColumn("next", F.coalesce("next", "top_below"))
    straight = F.col("pos") * F.col("next.neg") == F.col("neg") * F.col("next.pos")
    return _points(r.where(~F.coalesce(straight, F.lit(False))))


def subgroup_auc(df: DataFrame, score: str, label: str, group: str, min_rows: int = 30) -> DataFrame:
    """E5: AUC per subgroup with at least ``min_rows`` rows (NULL group excluded), sorted desc."""
    sized = df.where(F.col(group).isNotNull())
    counts = sized.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= min_rows)
    auc = roc_auc(sized, score, label, [group])
    return (auc.join(counts, group)
            .select(group, "n_rows", "n_pos", "n_neg", "auc")
            .orderBy(F.col("auc").desc_nulls_last(), F.col(group).asc()))
