"""Multi-party perspective rotation of dialogues (DataFrame functions only).

For every participant of a conversation the whole dialogue is rendered with that
speaker as the assistant and all others as named users.  The rendering is kept
as one row a message with its place in the rendered text, so a conversation of
any length is never gathered; messages joined in order of ``start`` are the text.  The
mask of a message says which characters are trained on: the speaker's own words.

Offsets are prefix sums in three levels: over blocks of turns, over the parts of a
block, and inside a part, where the messages of one turn are dealt to parts by a hash.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteflare.llm.common import two_hashes

SYSTEM_ROLES = ("system",)
UNNAMED = "unknown"
END = "<|end|>\n"
BLOCK_TURNS = 1024


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", system_roles=SYSTEM_ROLES) -> DataFrame:
    """(conv, participant, turn, speaker, rendered, start, mask_start, mask_end, trained).

    ``rendered`` is ``<|assistant|>`` or ``<|user name|>`` (``<|system|>`` for system
    roles, which are nobody's perspective), a line break, the text and the end
    mark.  ``start`` is its 0-based character offset in the participant's
    rendering; ``mask_start`` and ``mask_end`` bound the trained characters of an
    own message and are null elsewhere.

    Messages are ordered by turn (null turns first), then by a hash of speaker and text.  Equal rows are
    one message.  Null roles speak as "unknown"; null texts are empty; rows with a null conversation form
    one conversation.  A conversation with system rows only has no perspective
    and gives no row.  Other columns are ignored; an empty table gives an empty result.
    """
    base = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                        F.coalesce(role_col, F.lit(UNNAMED)).alias("speaker"),
                        F.coalesce(text_col, F.lit("")).alias("text"))
    base = base.withColumn("row", two_hashes("conv", F.isnull("conv"), "turn", F.isnull("turn"), "speaker", "text"))
    # Windows and joins move lengths only; a text is shuffled once, by its row, and meets its places at the end.
    texts = base.groupBy("row").agg(F.first("text").alias("text"))
    tie = F.md5(F.concat_ws("\n", "speaker", "text").cast("binary"))
    said = base.select("conv", "turn", "speaker", "row", tie.alias("tie"),
                       F.length("text").alias("n_text")).dropDuplicates(["row"])
    people = (said.where(~F.col("speaker").isin(*system_roles)).select(F.col("conv").alias("of"), "speaker").distinct()
              .select("of", F.col("speaker").alias("participant")))
    own = F.col("speaker") == F.col("participant")
    head = (F.when(own, F.lit("<|assistant|>\n")).when(F.col("speaker").isin(*system_roles), F.lit("<|system|>\n"))
            .otherwise(F.concat(F.lit("<|user "), "speaker", F.lit("|>\n"))))
    rows = (said.join(people, F.col("conv").eqNullSafe(F.col("of"))).drop("of")
            .withColumns({"head": head, "own": own})
            .withColumns({"part": F.substring("tie", 1, 2), "block": F.floor(F.col("turn") / BLOCK_TURNS),
                          "size": (F.length("head") + F.col("n_text") + len(END)).cast("long")}))
    of = ["conv", "participant"]
    inner = Window.partitionBy(*of, "block", "turn", "part").orderBy("tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("in_part", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    # Prefix sums of the levels above: parts inside a block of turns, blocks inside a rendering.
    for above, order, name in (([*of, "block"], ["turn", "part"], "in_block"), (of, ["block"], "in_text")):
        keys = [*above, *order]
        totals = rows.groupBy(*keys).agg(F.sum("size").alias("total"))
        before = Window.partitionBy(*above).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        begins = totals.select(*[F.col(c).alias("p_" + c) for c in keys],
                               F.coalesce(F.sum("total").over(before), F.lit(0)).alias(name))
        same = [F.col(c).eqNullSafe(F.col("p_" + c)) for c in keys]
        placed = placed.join(begins, functools.reduce(operator.and_, same)).drop(*["p_" + c for c in keys])
    start = F.col("in_text") + F.col("in_block") + F.col("in_part")
    words_at = start + F.length("head")
    return placed.join(texts, "row").select(
        F.col("conv").alias(conv_col), "participant", F.col("turn").alias(turn_col), "speaker",
        F.concat("head", "text", F.lit(END)).alias("rendered"),
        start.alias("start"), F.when(F.col("own"), words_at).alias("mask_start"),
        F.when(F.col("own"), words_at + F.col("n_text")).alias("mask_end"), F.col("own").alias("trained"))


ORACLE_SQL = """
with said as (
  select distinct conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as text from conversations),
people as (select distinct conv_id as of, speaker as participant from said where speaker <> 'system'),
rows as (
  select *, case when speaker = participant then '<|assistant|>\n' when speaker = 'system' then '<|system|>\n'
    else '<|user ' || speaker || '|>\n' end as head, md5(speaker || '\n' || text) as tie
  from said join people on conv_id is not distinct from of),
placed as (
  select *, head || text || '<|end|>\n' as rendered,
    coalesce(sum(length(head || text || '<|end|>\n')) over (partition by conv_id, participant order by turn nulls first, tie
      rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from rows)
select conv_id, participant, turn, speaker, rendered, start,
  case when speaker = participant then start + length(head) end as mask_start,
  case when speaker = participant then start + length(head) + length(text) end as mask_end,
  speaker = participant as trained
from placed"""
