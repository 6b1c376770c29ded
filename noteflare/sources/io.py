"""Sources and sinks (S2-S8): CSV/JSON/Parquet readers and writers, scratch paths.

Paths are Hadoop paths, so the same code reads and writes a local folder in
tests and shared storage on a cluster.  Scratch output goes under the
session's checkpoint folder (``spark.checkpoint.dir``), never a
machine-local temporary folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from noteflare.session import ensure_checkpoint_dir


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/noteflare-scratch/{name}-{uuid.uuid4().hex[:12]}"


# ---------------------------------------------------------------------------
# Note request schema (scoring input) and its three JSON batch shapes
# ---------------------------------------------------------------------------
REQUEST_TEXT_FIELDS = (
    "patientSummary", "complaints", "assesment", "examination", "reviewofsystem",
    "currentmedication", "pastHistory", "diagnoses", "procedure", "allergy",
)
NOTE_REQUEST_DDL = ("patientId string, noteId string, noteDate string, "
                    + ", ".join(f"`{f}` string" for f in REQUEST_TEXT_FIELDS))
# One JSON line is a note object, ``{"notes": [note, ...]}`` or a bare list of
# notes (Spark reads each element of a top-level array as its own row).
BATCH_DDL = NOTE_REQUEST_DDL + f", notes array<struct<{NOTE_REQUEST_DDL.replace(' string', ': string')}>>"


def flatten_batch(df: DataFrame) -> DataFrame:
    """One row per note whatever the line shape (no shuffle)."""
    from pyspark.sql import functions as F

    fields = ["patientId", "noteId", "noteDate", *REQUEST_TEXT_FIELDS]
    single = F.array(F.struct(*[F.col(f"`{f}`").alias(f) for f in fields]))
    one = F.when(F.col("notes").isNull(), single).otherwise(F.col("notes"))
    return df.select(F.explode(one).alias("n")).select(*[F.col(f"n.`{f}`").alias(f) for f in fields])


def conform_notes(df: DataFrame, text_fields=REQUEST_TEXT_FIELDS) -> DataFrame:
    """P10: absent or NULL text fields become "" (the request defaults)."""
    from pyspark.sql import functions as F

    present = set(df.columns)
    return df.withColumns({f: F.coalesce(F.col(f"`{f}`"), F.lit("")) if f in present else F.lit("")
                           for f in text_fields})


def read_note_batch_json(spark: SparkSession, path: str) -> DataFrame:
    """S4 reader: JSON lines in any of the three shapes -> conformed note rows."""
    return conform_notes(flatten_batch(spark.read.schema(BATCH_DDL).json(path)))


def read_note_csv(spark: SparkSession, path: str) -> DataFrame:
    """S2/S3 reader: header CSV, quoted fields may span lines; large files are read in several tasks.

    Columns are matched by header *name* (a user schema would bind them by
    position), read as text, and conformed to the request layout: absent
    id/date fields are NULL, absent text fields "" (P10).
    """
    from pyspark.sql import functions as F

    from noteflare.sources.csv_records import read_csv

    raw = read_csv(spark, path)
    present = set(raw.columns)
    fields = ["patientId", "noteId", "noteDate", *REQUEST_TEXT_FIELDS]
    cols = [F.col(f"`{f}`").cast("string").alias(f) if f in present else F.lit(None).cast("string").alias(f)
            for f in fields]
    return conform_notes(raw.select(*cols))


def write_csv(df: DataFrame, path: str) -> None:
    """S2/S8 writer (header, RFC-4180 quoting)."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """S6 writer."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """S5 writer: one JSON document per row (nested columns kept nested)."""
    df.write.mode("overwrite").json(path)


METRICS_DDL = "name string, value double, logged_at timestamp, run_id string"


def log_metrics(spark: SparkSession, path: str, run_id: str, metrics: DataFrame) -> DataFrame:
    """Put ``(run_id, name, value, logged_at)`` rows into a Parquet metrics table, one folder a run.

    Logging a run again replaces its rows and leaves the other runs alone (dynamic partition overwrite), so a
    rerun or a retried job never doubles them.  ``metrics`` holds ``(name, value)`` rows computed by Spark;
    nothing passes through the driver.
    """
    from pyspark.sql import functions as F

    rows = metrics.select(F.col("name").cast("string"), F.col("value").cast("double"),
                          F.current_timestamp().alias("logged_at"), F.lit(run_id).alias("run_id"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
    return spark.read.schema(METRICS_DDL).parquet(path)


def write_note_batches(notes: DataFrame, path: str, shape_col: str = "_shape") -> None:
    """Write notes as JSON lines in the shape named by ``shape_col``
    ('object', 'wrapped' or 'list'), e.g. to feed a scoring job or stream."""
    from pyspark.sql import functions as F

    fields = ["patientId", "noteId", "noteDate", *REQUEST_TEXT_FIELDS]
    note = F.struct(*[F.col(f"`{f}`").cast("string").alias(f) for f in fields])
    line = (F.when(F.col(shape_col) == "wrapped", F.to_json(F.struct(F.array(note).alias("notes"))))
            .when(F.col(shape_col) == "list", F.to_json(F.array(note)))
            .otherwise(F.to_json(note)))
    notes.select(line.alias("value")).write.mode("overwrite").text(path)


def read_table_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
                    lower_bound: int | None = None, upper_bound: int | None = None,
                    num_partitions: int | None = None, properties: dict | None = None) -> DataFrame:
    """A relational source table as a DataFrame.

    With ``partition_column`` and bounds the read is split into
    ``num_partitions`` range queries run in parallel by the executors
    (instead of one fetch-all into one process); filters and column
    selections applied afterwards are pushed into the SQL Spark sends.
    Credentials come from ``properties`` (e.g. read from the cluster's
    secret store by the caller), never from code.
    """
    props = dict(properties or {})
    if partition_column is not None:
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower_bound,
                               upperBound=upper_bound, numPartitions=num_partitions, properties=props)
    return spark.read.jdbc(url, table, properties=props)


def range_predicates(keys: DataFrame, column: str, num_partitions: int, accuracy: int = 10_000) -> list[str]:
    """At most ``num_partitions`` + 1 SQL predicates that split a table by ``column`` into parts of like size.

    Bounds are approximate quantiles of the column itself (one aggregate, ``num_partitions`` numbers come
    back), so skewed keys get narrow ranges and no caller has to know a minimum or maximum.  The predicates are
    disjoint and cover every row: the outer ranges are open, and null keys have a predicate of their own.  A value
    that holds more than a part's share is one range.  Text keys are cut at quantiles of a sample of their values.
    """
    from pyspark.sql import functions as F

    shares = [i / num_partitions for i in range(1, num_partitions)]
    kind = keys.schema[column].dataType.typeName()
    c = F.col(f"`{column}`")
    if kind == "string":
        values = keys.where(c.isNotNull()).select(c.alias("v")).orderBy(F.xxhash64("v")).limit(accuracy)
        sample = sorted(r["v"] for r in values.collect())  # at most ``accuracy`` values
        found = [sample[int(s * len(sample))] for s in shares] if sample else []
    else:
        found = (keys.agg(F.percentile_approx(c, shares, accuracy).alias("q")).first()["q"] or []) if shares else []

    def literal(v) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"'{v}'" if hasattr(v, "isoformat") else str(v)

    bounds = [literal(v) for v in dict.fromkeys(found)]
    out = [f"{column} IS NULL"]
    if not bounds:
        return [*out, f"{column} IS NOT NULL"]
    out.append(f"{column} < {bounds[0]}")
    out += [f"{column} >= {lo} AND {column} < {hi}" for lo, hi in zip(bounds, bounds[1:])]
    return [*out, f"{column} >= {bounds[-1]}"]


def read_table_split(spark: SparkSession, url: str, table: str, column: str, num_partitions: int,
                     properties: dict | None = None) -> DataFrame:
    """A relational table read in parallel by quantile ranges of ``column``, without bounds from the caller.

    The quantiles take one read of the key column alone.
    """
    props = dict(properties or {})
    keys = spark.read.jdbc(url, f"(SELECT {column} FROM {table}) k", properties=props)
    return spark.read.jdbc(url, table, predicates=range_predicates(keys, column, num_partitions), properties=props)


def load_source_tables(spark: SparkSession, url: str, properties: dict | None = None,
                       num_partitions: int = 64) -> dict[str, DataFrame]:
    """The seven clinical source tables over JDBC, the large ones split by quantiles of the note id."""
    big = {"progressNotes": "noteId", "newProgressNotes": "noteId", "pnAssessment": "noteId"}
    out = {}
    for name in ("progressNotes", "newProgressNotes", "pnAssessment", "diagnosis", "diagnosisCodes",
                 "providers", "placeOfService"):
        if name in big:
            out[name] = read_table_split(spark, url, name, big[name], num_partitions, properties)
        else:
            out[name] = read_table_jdbc(spark, url, name, properties=properties)
    return out
