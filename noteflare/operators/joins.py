"""Join helpers: broadcast a dimension only behind a size check, and a table that grows with the notes never."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteflare.constants import BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS


_CHECKED: dict[tuple[str, int, int, int], bool] = {}


def row_width(df: DataFrame) -> int:
    """Estimated bytes per row from the schema (Spark's default field sizes,
    as the planner uses for its own size estimates)."""
    return max(8, int(df._jdf.schema().defaultSize()))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` (no job; file sizes scaled by projection)."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(size if isinstance(size, int) else size.toString())


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                   max_bytes: int = BROADCAST_MAX_BYTES, estimate_slack: int = 16) -> bool:
    """True when ``df`` provably holds at most ``max_rows`` rows and, at the
    schema's estimated row width, at most ``max_bytes``.

    Two steps: a frame whose planner estimate is far above the byte bound
    (``estimate_slack`` times; compressed files can understate memory) is
    rejected without running anything, since counting a huge fact table
    would itself scan it.  Otherwise ``limit(n + 1).count()`` proves the
    bound exactly.  The answer is remembered per session, semantic plan and
    size of the files behind it, so rebuilding the same dimension (every query
    re-derives its tables) costs no new job, and one that has grown is counted again.
    """
    n = min(max_rows, max_bytes // row_width(df))
    size = estimated_bytes(df)
    key = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), n, size)
    if key not in _CHECKED:
        if size > estimate_slack * max_bytes:
            _CHECKED[key] = False
        else:
            _CHECKED[key] = df.limit(n + 1).count() <= n
    return _CHECKED[key]


def dimension(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Hint a broadcast for a dimension whose row count is checked.

    Beyond the bound the frame is returned unhinted: Spark then plans a
    shuffle (sort-merge) join, and AQE may still convert it at run time
    from the measured shuffle size.
    """
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def bounded(df: DataFrame) -> DataFrame:
    """Broadcast a frame whose size is bounded by construction.

    For fitted parameters such as a vocabulary capped at ``max_features``
    terms or a 2-row class-weight table.  The caller owns the bound.
    """
    return F.broadcast(df)


FEW_ROWS = 50_000  # of a table with a row a note: beyond, it is never broadcast


def note_sized(df: DataFrame) -> DataFrame:
    """Keep a table with a row a note out of broadcasts: its joins shuffle both sides.

    The planner estimates a kept Parquet table by its file size.  Flags and repeated values are
    stored in a few bits, so a table far under the broadcast threshold on disk unpacks to hundreds of MB in the driver.
    """
    return df.hint("merge")


def few_or_note_sized(df: DataFrame) -> DataFrame:
    """Broadcast a kept table of at most ``FEW_ROWS`` counted rows; a larger one as :func:`note_sized`."""
    return F.broadcast(df) if fits_broadcast(df, FEW_ROWS) else note_sized(df)
