"""Quoted CSV whose records span lines, read in splits.

Spark's own reader gives a whole file to one task as soon as a quoted field may hold a line break.  Here the
files are read as lines, split like any text file.  A line begins inside a quoted field exactly if an odd number of quotes stand
before it in its file (a doubled quote counts twice).  Quotes are counted per split, summed over the splits of
a file (a few narrow rows), and carried through each split's lines by a window, which says where records begin.
Records inside a split are put together there; only pieces that cross a split's border meet others.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = ["file", "block"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value, quotes): lines in order of ``at`` within a split."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, nth, record): every record of the CSV files under ``path``, line breaks inside quotes kept.

    ``block`` is the split a record begins in, ``nth`` its 1-based number there.  A quote left open runs to the end of
    its file.  One record must fit a task's memory; blank lines between records are records of their own.
    """
    lines = _lines(spark, path)
    per_block = lines.groupBy(*BLOCK).agg(F.sum("quotes").alias("quotes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = per_block.select(*BLOCK, F.coalesce(F.sum("quotes").over(earlier), F.lit(0)).alias("before"),
                              F.col("quotes").alias("inside"))
    inner = Window.partitionBy(*BLOCK).orderBy("at")
    so_far = F.coalesce(F.sum("quotes").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = ((F.col("before") + so_far) % 2 == 0).cast("int")
    marked = (lines.join(before, BLOCK).withColumn("begins", begins)
              .withColumn("nth", F.sum("begins").over(inner)))  # 0: still the record of an earlier split
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "\n")
    pieces = marked.groupBy(*BLOCK, "nth").agg(text.alias("record"), F.first("before").alias("before"),
                                               F.first("inside").alias("inside"))
    # The last record of a split whose quotes do not close goes on in the next one.
    last = F.max("nth").over(Window.partitionBy(*BLOCK))
    pieces = pieces.withColumn("open", (F.col("nth") == last) & ((F.col("before") + F.col("inside")) % 2 == 1))
    whole = pieces.where("nth > 0 and not open").select(*BLOCK, "nth", "record")
    # At most two pieces a split cross its borders: they are chained in file order.
    chained = pieces.where("nth = 0 or open").withColumn("chain", F.sum((F.col("nth") > 0).cast("int")).over(
        Window.partitionBy("file").orderBy("block", "nth")))
    crossing = chained.groupBy("file", "chain").agg(
        F.array_sort(F.collect_list(F.struct("block", "nth", "record"))).alias("p")).select(
        "file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["nth"].alias("nth"),
        F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
    return whole.unionByName(crossing).withColumn("record", F.regexp_replace("record", r"\r\z", ""))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of header CSV files (RFC 4180 quoting) as string columns named by the header; blank lines are no rows.

    All files must have the same header.
    """
    found = records(spark, path)
    first = (F.col("block") == 0) & (F.col("nth") == 1)
    headers = [r[0] for r in found.where(first).select("record").distinct().limit(2).collect()]  # one line
    if not headers:
        return spark.createDataFrame([], "value string").drop("value")
    if len(headers) > 1:
        raise ValueError(f"CSV files under {path} differ in their headers")
    names = next(csv.reader([headers[0].removeprefix("\ufeff")]))
    ddl = ", ".join(f"`c{i}` string" for i in range(len(names)))
    # ``multiLine`` only keeps the line breaks inside quotes as they are: each value here is one record.
    parsed = F.from_csv("record", ddl, {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}).alias("r")
    return found.where(~first & (F.col("record") != "")).select(parsed).select("r.*").toDF(*names)
