"""Next-visit labelling, patient split, class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteflare.constants import LEAK_COLS, SPLIT_SEED, TEST_FRACTION
from noteflare.operators.joins import bounded, note_sized

TARGET = "flare_label_next"


def next_visit_labels(df: DataFrame, label: str = "flare_label", target: str = TARGET,
                      key: str | list[str] = "noteId") -> DataFrame:
    """Narrow ``(key, target)`` rows of the notes that have a next visit (see
    :func:`next_visit_label`)."""
    return _labels(df, label, target, key)


def next_visit_label(df: DataFrame, label: str = "flare_label", target: str = TARGET,
                     keep_unlabelled: bool = False, key: str | list[str] = "noteId") -> DataFrame:
    """W1 + P11: label each note with the label of the patient's next note.

    Notes without a next note (last visit) and notes without a patient are
    dropped, or kept with a NULL label when ``keep_unlabelled`` (one table
    then serves both as the feature table and, filtered, as the labelled
    set).  Order: visit date (undated last), then the row key.  ``key`` (a
    column or list of columns) must identify a row.

    The label is computed on four narrow columns and joined back on the
    note key, so the wide rows (note text, features) are not moved by the
    windows; when the wide frame is already hash-partitioned by the key only
    the narrow side is shuffled.  Pass a materialised ``df`` (the label
    branch and the join both read it).

    Skew-safe and exact, in two levels, so a patient with a huge share of
    all notes is never gathered into one task:

    1. a window over ``(patient, visit day)`` gives the next note inside the
       same day;
    2. for the last note of a day, the next note is the first note of the
       patient's next day with notes: a window over one narrow row per
       (patient, day) - at most the number of distinct visit days of a
       patient, however many notes they have.
    """
    keys = [key] if isinstance(key, str) else list(key)
    labels = _labels(df, label, target, keys)
    if keep_unlabelled:
        # Last visits and notes without a patient keep a NULL label.
        return df.join(labels, keys, "left")
    return df.join(labels, keys, "inner")


def _labels(df: DataFrame, label: str, target: str, key: str | list[str]) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    order_keys = [k for k in keys if k != "patientId"]
    narrow = list(dict.fromkeys([*keys, "patientId", "noteDate", label]))
    base = (df.select(*narrow).where(F.col("patientId").isNotNull())
            .withColumn("_day", F.to_date("noteDate")))
    in_day = Window.partitionBy("patientId", "_day").orderBy(F.col("noteDate").asc_nulls_last(),
                                                              *[F.col(k).asc() for k in order_keys])
    lvl1 = base.withColumn("_next_in_day", F.lead(F.col(label), 1).over(in_day)).withColumn(
        "_is_last", F.lead(F.lit(1), 1).over(in_day).isNull())
    days = base.groupBy("patientId", "_day").agg(
        F.min_by(F.col(label), F.struct(F.col("noteDate"), *[F.col(k) for k in order_keys])).alias("_first"))
    by_day = Window.partitionBy("patientId").orderBy(F.col("_day").asc_nulls_last())
    nxt_day = note_sized(days.select("patientId", "_day", F.lead("_first", 1).over(by_day).alias("_next_day_first")))
    # NULL days never equal in a join key, so undated notes are matched null-safely.
    on = (lvl1["patientId"] == nxt_day["patientId"]) & lvl1["_day"].eqNullSafe(nxt_day["_day"])
    joined = lvl1.join(nxt_day, on, "left")
    nxt = F.when(F.col("_is_last"), F.col("_next_day_first")).otherwise(F.col("_next_in_day"))
    return (joined.select(*[lvl1[k].alias(k) for k in keys], nxt.cast("int").alias(target))
            .where(F.col(target).isNotNull()))


def drop_leaks(df: DataFrame, leak_cols=LEAK_COLS) -> DataFrame:
    """Drop label-defining columns (absent names ignored)."""
    return df.drop(*[c for c in leak_cols if c in df.columns])


def split_threshold(fraction: float) -> str:
    """Hex prefix of md5 below which a patient goes to the test side."""
    return format(int(round(fraction * 16 ** 8)), "08x")


def split_column(seed: int = SPLIT_SEED, fraction: float = TEST_FRACTION, key: str = "patientId") -> F.Column:
    """V1: 'test' for about ``fraction`` of patients, 'train' for the rest.

    A hash of (seed, patient) decides, so every note of a patient lands on
    the same side with no shuffle, sort or driver-side id list.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return F.when(h < F.lit(split_threshold(fraction)), F.lit("test")).otherwise(F.lit("train"))


def group_split(df: DataFrame, seed: int = SPLIT_SEED, fraction: float = TEST_FRACTION) -> DataFrame:
    return df.withColumn("split", split_column(seed, fraction))


def split_summary(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Distinct patients, notes and positive rate per split."""
    return df.groupBy("split").agg(
        F.countDistinct("patientId").alias("n_patients"),
        F.count(F.lit(1)).alias("n_notes"),
        F.avg(F.col(target).cast("double")).alias("pos_rate"),
    )


def class_weights(df: DataFrame, target: str = TARGET) -> DataFrame:
    """V8: balanced weights n / (2 * n_class) per class (one tiny aggregate)."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n_class"))
    # The grouped table has one row per class, so this global window is tiny.
    n_total = F.sum("n_class").over(Window.partitionBy())
    return counts.select(
        target, "n_class",
        (n_total / (F.lit(2.0) * F.col("n_class"))).alias("weight"),
    )


def with_class_weight(df: DataFrame, target: str = TARGET, weight_col: str = "weight") -> DataFrame:
    """Attach the class weight (the 2-row weight table is broadcast)."""
    w = class_weights(df, target).select(target, F.col("weight").alias(weight_col))
    return df.join(bounded(w), target, "left")
