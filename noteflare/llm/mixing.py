"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Every source has a weight schedule over training time 0..1.  Its integral is the
source's share of the mix; a source is never repeated more than ``MAX_REPEATS``
times, and what a full source can't take is shared again by weight among the
others.  A source's documents lie in a fixed pseudo-random order on a line of
words, repeated until its target is met.  Inverting the cumulative word demand
of its schedule turns a place on that line into a training position, and
documents are range-sorted by position.

A source may hold any share of all rows: its line is cut into ranges of about
``ROWS_PER_RANGE`` documents, range totals are summed first, and only rows of
one range meet in a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteflare.llm.common import n_words, scratch_table
from noteflare.operators.joins import dimension

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
ROWS_PER_RANGE = 1_000
# Weight schedules by place of the source in code-point order, repeating: the factor on the
# source's weight in each of three equal phases of training.  Each row averages 1.
PHASES = ((0.5, 1.0, 1.5), (1.0, 1.0, 1.0), (1.5, 1.0, 0.5))


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, n_rows, source_size, slot, target) from (source, size) rows.

    ``target`` is the smaller of ``max_repeats * source_size`` and ``level *
    weight``; the one level that makes targets sum to all sizes is what
    repeated resharing ends at.  The two windows here see one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    slots = by_source.withColumn("slot", (F.row_number().over(in_order) - 1).cast("int"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("slot") % len(weights) + 1)
    caps = slots.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "slot")
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    whole = F.sum("source_size").over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    caps = caps.withColumn("nth", F.row_number().over(by_fill)).withColumn("level", (whole - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                           / F.sum("weight").over(after)).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("open"), F.struct("nth", "level"))).over(
        Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["level"]
    return caps.withColumn("common", level).select(
        "source", "n_rows", "source_size", "slot",
        F.when(F.col("open") & F.col("common").isNotNull(), F.col("common") * F.col("weight"))
        .otherwise(F.col("cap")).alias("target"))


def position(share: F.Column, slot: F.Column, phases=PHASES) -> F.Column:
    """Training position at which a source has spent ``share`` (0..1) of its words.

    The inverse of the integral of the slot's piecewise-constant schedule.
    """
    out = None
    for row, factors in reversed(list(enumerate(phases))):
        n, spent = len(factors), sum(factors) / len(factors)
        inverse, edge = None, None
        for k in reversed(range(n)):
            done = sum(factors[:k]) / n
            piece = F.lit(k / n) + (share * spent - F.lit(done)) / F.lit(factors[k])
            inverse = piece if inverse is None else F.when(share * spent >= F.lit(edge), inverse).otherwise(piece)
            edge = done
        out = inverse if out is None else F.when(slot % len(phases) == row, inverse).otherwise(out)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, max_repeats: int = MAX_REPEATS, phases=PHASES,
        rows_per_range: int = ROWS_PER_RANGE, keep=None) -> DataFrame:
    """The documents with size, their source's size and target, the words taken and where.

    ``keep`` names the input columns that stay, by default all of them; without any, the id alone is returned.
    Input columns named like a new one (in any case) are replaced.

    ``taken`` counts repeats: whole passes over the source, then documents in the
    fixed order until the target is met, the last one cut to length, so a
    source's taken words equal its target rounded down.  ``position`` (0..1) is
    that of the first copy and null when nothing is taken; ``positions`` has
    those of all copies.  Null and empty texts have size 0 and take nothing.  A null source is
    a source of its own, the last in order.  Rows repeating an id are documents of
    their own.  An empty table gives an empty result.
    """
    new = ("size", "source_size", "target", "taken", "position", "positions")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    # md5 of id and text is the fixed pseudo-random order; its first 32 bits cut ranges.  Rows that share an id,
    # or have none, spread by their texts.
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    row = [F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")] if kept else []
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       n_words(F.col(text_col)).alias("size"), key.alias("key"), *row)
    if not kept:  # narrow rows are written once; whole documents are rather read twice
        base = scratch_table(base, "mix")
    plan = scratch_table(targets(base, weights, max_repeats), "mix-targets")
    plan = dimension(plan.withColumn("ranges", F.ceil(F.col("n_rows") / rows_per_range))
                     .withColumnRenamed("source", "of"))
    unit = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    rows = base.join(plan, base.source.eqNullSafe(F.col("of"))).withColumn("range", F.floor(unit * F.col("ranges")))
    sums = rows.groupBy("slot", "range").agg(F.sum("size").alias("in_range"))
    begins = dimension(sums.select("slot", "range", F.coalesce(F.sum("in_range").over(
        Window.partitionBy("slot").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin")))
    inside = (Window.partitionBy("slot", "range").orderBy("key", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(begins, ["slot", "range"])
    goal = F.floor("target").cast("long")
    start = F.col("begin") + F.col("inner")
    copies = []
    for k in range(max_repeats):
        left = goal - F.col("source_size") * k - start
        copies.append(F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long"))
    where = [F.when(n > 0, position((F.col("source_size") * k + start) / F.greatest(goal, F.lit(1)), F.col("slot"), phases))
             for k, n in enumerate(copies)]
    taken = copies[0]
    for n in copies[1:]:
        taken = taken + n
    first = F.col("row") if kept else F.struct(F.col("id").alias(id_col)).alias("row")
    return placed.select(first, "size", "source_size", "target", taken.alias("taken"), where[0].alias("position"),
                         F.array_compact(F.array(*where)).alias("positions")).select("row.*", *new)


def in_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``mix`` range-sorted by position, those that take nothing last, ties by id."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), id_col)


def curriculum(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The taken copies in training order: (id, copy, position), range-sorted by position."""
    copies = mixed.where("taken > 0").select(id_col, F.posexplode("positions").alias("copy", "position"))
    return copies.orderBy("position", id_col, "copy")


def oracle_sql(docs: str = "documents") -> str:
    """DuckDB SQL of ``mix`` with the default parameters."""
    spent = []
    for row, (a, b, c) in enumerate(PHASES):
        spent.append(f"""when slot % 3 = {row} then case
            when f * {(a + b + c) / 3} >= {(a + b) / 3} then {2 / 3} + (f * {(a + b + c) / 3} - {(a + b) / 3}) / {c}
            when f * {(a + b + c) / 3} >= {a / 3} then {1 / 3} + (f * {(a + b + c) / 3} - {a / 3}) / {b}
            else f * {(a + b + c) / 3} / {a} end""")
    return f"""
with base as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as k,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size
  from {docs}),
src as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as slot
  from base group by source),
caps as (
  select *, (slot % 3 + 1)::double as w, (3 * source_size)::double as cap from src),
fill as (
  select *, row_number() over (order by cap / w, slot) as nth,
    ((select sum(source_size) from src)::double - coalesce(sum(cap) over (order by cap / w, slot
        rows between unbounded preceding and 1 preceding), 0.0))
      / sum(w) over (order by cap / w, slot rows between current row and unbounded following) as level
  from caps),
goals as (
  select source, source_size, slot, case when level * w <= cap
      then (select arg_min(level, nth) from fill where level * w <= cap) * w else cap end as target
  from fill),
line as (
  select base.doc_id, base.size, goals.source_size, goals.target, goals.slot, floor(goals.target)::bigint as goal,
    coalesce(sum(base.size) over (partition by goals.slot order by k, base.size
      rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from base join goals on base.source is not distinct from goals.source),
cut as (
  select *, greatest(0, least(size, goal - start)) + greatest(0, least(size, goal - source_size - start))
    + greatest(0, least(size, goal - 2 * source_size - start)) as taken, start::double / goal as f
  from line)
select doc_id, size::bigint as size, source_size, target, taken::bigint as taken,
  case when greatest(0, least(size, goal - start)) > 0 then case {' '.join(spent)} end end as position
from cut"""
