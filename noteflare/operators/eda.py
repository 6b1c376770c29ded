"""Exploratory aggregates (A3-A14, P17, P19).  One pass per report, map-side combined."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteflare.constants import TERM_RATE_LEXICONS, WORD_FREQ_EXTRA_STOP, ENGLISH_STOP_WORDS
from noteflare.functions.text import month_start

WORD_PATTERN = r"[\p{L}\p{N}_][\p{L}\p{N}_']+"


def _unpivot(df: DataFrame, names: Sequence[str], name_col: str, value_col: str) -> DataFrame:
    """One wide row -> (name, value) rows, no shuffle."""
    return df.unpivot([], list(names), name_col, value_col)


def notes_per_patient(notes: DataFrame) -> DataFrame:
    """A3: notes per patient."""
    return notes.groupBy("patientId").agg(F.count("noteId").alias("n_notes"))


def notes_per_patient_hist(notes: DataFrame, bins: int = 30) -> DataFrame:
    """A4: equal-width histogram of notes per patient between min and max.

    Bin edges follow the usual convention: the last bin is closed on the
    right; a constant distribution gets the range (v - 0.5, v + 0.5).
    The per-patient counts are aggregated once more by bin, so only ``bins``
    rows ever meet in the tiny global min/max window.
    """
    per = notes_per_patient(notes)
    stats = Window.partitionBy()
    by_count = per.groupBy("n_notes").agg(F.count(F.lit(1)).alias("patients"))
    lo = F.min("n_notes").over(stats)
    hi = F.max("n_notes").over(stats)
    lo_edge = F.when(hi == lo, lo - 0.5).otherwise(lo)
    hi_edge = F.when(hi == lo, hi + 0.5).otherwise(hi)
    width = (hi_edge - lo_edge) / bins
    b = F.least(F.floor((F.col("n_notes") - lo_edge) / width), F.lit(bins - 1)).cast("int")
    binned = by_count.select("n_notes", "patients", b.alias("bin"), lo_edge.alias("lo"), width.alias("w"))
    return binned.groupBy("bin").agg(
        F.first(F.col("lo") + F.col("bin") * F.col("w")).alias("bin_start"),
        F.first(F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("bin_end"),
        F.sum("patients").alias("patients"),
    )


def notes_per_month(notes: DataFrame, date_col: str = "noteDate") -> DataFrame:
    """A5: notes per calendar month (undated notes dropped)."""
    return (notes.where(F.col(date_col).isNotNull())
            .groupBy(month_start(date_col).alias("note_month"))
            .agg(F.count(F.lit(1)).alias("n_notes")))


def nonempty_rates(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Percent of rows whose text is non-empty, per column, in one pass."""
    cols = list(cols)
    wide = df.agg(*[(F.avg(F.when(F.coalesce(F.col(c), F.lit("")) != "", 1.0).otherwise(0.0)) * 100)
                    .alias(c) for c in cols])
    return _unpivot(wide, cols, "column_name", "pct_non_empty")


def term_rates(df: DataFrame, col: str = "assesment",
               lexicons: Mapping[str, Sequence[str]] = TERM_RATE_LEXICONS) -> DataFrame:
    """Share of rows whose lower-cased text matches any term (regex alternation)."""
    low = F.lower(F.coalesce(F.col(col), F.lit("")))
    wide = df.agg(*[F.avg(low.rlike("|".join(terms)).cast("double")).alias(name)
                    for name, terms in lexicons.items()])
    return _unpivot(wide, list(lexicons), "lexicon", "rate")


def word_freq(df: DataFrame, col: str, top: int = 200, stop: Iterable[str] | None = None) -> DataFrame:
    """Most frequent words of a text column (whole texts).

    Lower-cased words (2+ chars, trailing "'s" dropped) minus stop words
    (a hash-set lookup in the JVM), exploded, partially counted per
    partition, shuffled by word, then the top ``top`` (the report shows
    ``top`` words).
    """
    from pyspark.ml.feature import StopWordsRemover

    stop = sorted(set(stop if stop is not None else (*ENGLISH_STOP_WORDS, *WORD_FREQ_EXTRA_STOP)))
    toks = F.regexp_extract_all(F.lower(F.coalesce(F.col(col), F.lit(""))), F.lit(WORD_PATTERN), 0)
    toks = F.transform(toks, lambda w: F.when(w.endswith("'s"), w.substr(F.lit(1), F.length(w) - 2))
                       .otherwise(w))
    kept = StopWordsRemover(inputCol="_w", outputCol="_k", stopWords=stop, caseSensitive=True).transform(
        df.select(toks.alias("_w")))
    # explode_outer + null filter (a plain explode would make Catalyst
    # re-evaluate the tokeniser in an inferred filter).
    exploded = kept.select(F.explode_outer("_k").alias("word")).where(
        F.col("word").isNotNull() & (F.length("word") > 0))
    counts = exploded.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col("word").asc()).limit(top)


def top_diagnoses(feats: DataFrame, top: int = 10) -> DataFrame:
    """Most common *code lists* (label ``', '.join(codes)``)."""
    label = F.array_join("diagnosis_codes", ", ")
    return (feats.groupBy(label.alias("diagnosis")).agg(F.count(F.lit(1)).alias("n_notes"))
            .orderBy(F.col("n_notes").desc(), F.col("diagnosis").asc()).limit(top))


def top_codes(feats: DataFrame, top: int = 10) -> DataFrame:
    """A9 (per-code variant): most common single codes."""
    return (feats.select(F.explode("diagnosis_codes").alias("code"))
            .groupBy("code").agg(F.count(F.lit(1)).alias("n_notes"))
            .orderBy(F.col("n_notes").desc(), F.col("code").asc()).limit(top))


def flag_rates(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """A10: mean of 0/1 flags, one pass."""
    cols = list(cols)
    wide = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols])
    return _unpivot(wide, cols, "flag", "rate")


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise Pearson correlation of ``cols`` in one aggregate."""
    pairs = [(a, b) for a in cols for b in cols]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}")
                    for a, b in pairs])
    long = _unpivot(wide, [f"{a}|{b}" for a, b in pairs], "pair", "corr")
    parts = F.split("pair", r"\|")
    return long.select(parts[0].alias("feature_a"), parts[1].alias("feature_b"), "corr")


def target_corr(df: DataFrame, cols: Sequence[str], target: str, top: int = 20) -> DataFrame:
    """Correlation of each column with ``target``, strongest 20 (report)."""
    wide = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in cols])
    long = _unpivot(wide, list(cols), "feature", "corr")
    return long.orderBy(F.col("corr").desc_nulls_last(), F.col("feature").asc()).limit(top)


def cohort_metrics(feats: DataFrame, col: str = "assesment",
                   lexicons: Mapping[str, Sequence[str]] = TERM_RATE_LEXICONS) -> DataFrame:
    """Patients, mean notes per patient and the term rates, one row."""
    low = F.lower(F.coalesce(F.col(col), F.lit("")))
    return feats.agg(
        F.countDistinct("patientId").alias("n_patients"),
        (F.count("noteId") / F.countDistinct("patientId")).alias("avg_notes_per_patient"),
        *[F.avg(low.rlike("|".join(t)).cast("double")).alias(f"{n}_rate") for n, t in lexicons.items()],
    )


def column_summary(df: DataFrame) -> DataFrame:
    """Type and non-null count per column (one aggregate + unpivot)."""
    wide = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    long = _unpivot(wide, df.columns, "column_name", "non_null")
    types = df.sparkSession.createDataFrame(
        [(f.name, f.dataType.typeName()) for f in df.schema.fields], "column_name string, data_type string")
    return long.join(F.broadcast(types), "column_name")


def row_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows and distinct keys."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_distinct"))
