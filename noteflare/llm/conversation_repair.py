"""Conversation structure repair: cheapest edits by secondary-sorted streaming.

Rows are repartitioned by conversation and sorted by turn inside partitions; ``mapInArrow`` streams them
and carries the state of a dynamic program across Arrow batches.  The rows come last turn first: the state is
the cost of repairing everything from a row to the end, from each of the four places the role pattern
``(s?(ua)+)?`` can be in, and each row leaves one byte of back pointers: the first edit, least in ASCII order,
of a cheapest repair from each place.  Following the bytes from the first row gives the audit and the repaired rows.

An ordinary conversation is finished as soon as its first turn has come.  A giant one keeps only the
costs: its rows go out to a table in the shared folder with their pointer bytes beside them, and a second stream,
first turn first, follows the pointers.  Memory is bounded by the spill limits, not by the longest
conversation, and a lost executor costs its partitions alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from noteflare.llm.common import SPACE, arrow_stage, scratch_table

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3  # costs of the edits
TRUNCATED = 3  # more for every truncated row that stays
SPILL_ROWS = 65_536
SPILL_CHARS = 8_000_000
FLUSH_ROWS, FLUSH_CHARS = 4_096, 4_000_000

FINE, BLANK, DUPLICATE, CUT_OFF = range(4)  # a row's first fault
START, SYSTEM, USER, ASSISTANT = range(4)  # places in the pattern: what the last role was
EDITS = "DIKR"  # in ASCII order: ties go to the earlier
_NEXT = (USER, USER, ASSISTANT, USER)  # the place after an inserted or reroled row
_ROLE = ("", "", "user", "assistant")
_KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})  # the place after a kept row
_END = (0, 2 * INSERT, INSERT, 0)  # what closing the pattern costs

_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
FINISHED, SPILLED, SUMMARY = range(3)


# ---------------------------------------------------------------------------
# the dynamic program
# ---------------------------------------------------------------------------

def step(after: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, ...], int]:
    """(cost from each place before a row, its pointer byte), given the costs after it."""
    stays = fault not in (BLANK, DUPLICATE)
    more = TRUNCATED if fault == CUT_OFF else 0
    options = []
    for place in range(4):
        own = {"D": DELETE + after[place]}
        if stays:
            own["R"] = REROLE + more + after[_NEXT[place]]
            if initial in _KEPT[place]:
                own["K"] = KEEP + more + after[_KEPT[place][initial]]
        options.append(own)
    costs = [min(own.values()) for own in options]
    for _ in range(2):  # two inserts lead back to the same role
        costs = [min(c, INSERT + costs[_NEXT[place]]) for place, c in enumerate(costs)]
    pointers = 0
    for place, own in enumerate(options):
        own["I"] = INSERT + costs[_NEXT[place]]
        first = next(i for i, e in enumerate(EDITS) if own.get(e) == costs[place])
        pointers |= first << (2 * place)
    return tuple(costs), pointers


class _Steps(dict):
    """``step`` by what it depends on: few differences between costs ever occur."""

    def __call__(self, after: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, ...], int]:
        low, kind = min(after), (BLANK if fault == DUPLICATE else fault)
        key = (tuple(c - low for c in after), initial if initial in ("s", "u", "a") else "", kind)
        if key not in self:
            self[key] = step(*key)
        costs, pointers = self[key]
        return tuple(c + low for c in costs), pointers


class Walk:
    """Follows pointer bytes from the first row on."""

    def __init__(self):
        self.place, self.audit, self.digest, self.empty = START, bytearray(), hashlib.sha256(), True

    def _out(self, edit: str, role: str | None, text: str) -> tuple[str, str | None, str]:
        self.audit += edit.encode()
        if edit != "D":
            self.digest.update((("" if self.empty else "\n") + f"{role}:{text}").encode())
            self.empty = False
        return edit, role, text

    def _insert(self) -> tuple[str, str | None, str]:
        self.place = _NEXT[self.place]
        return self._out("I", _ROLE[self.place], "")

    def row(self, role: str, text: str, pointers: int) -> Iterator[tuple[str, str | None, str]]:
        """(edit, role, text) of the inserts before a row, then of the row itself."""
        while (edit := EDITS[pointers >> 2 * self.place & 3]) == "I":
            yield self._insert()
        if edit == "K":
            self.place = _KEPT[self.place][role[:1]]
        elif edit == "R":
            self.place = _NEXT[self.place]
            role = _ROLE[self.place]
        yield self._out(edit, role, text)

    def end(self) -> Iterator[tuple[str, str | None, str]]:
        while self.place in (SYSTEM, USER):
            yield self._insert()


# ---------------------------------------------------------------------------
# streams over sorted rows (inside tasks)
# ---------------------------------------------------------------------------

class _Conversation:
    """Counts, costs and kept rows of the conversation that is passing, last turn first."""

    def __init__(self, conv):
        self.conv, self.n, self.costs = conv, 0, _END
        self.counts = [0, 0, 0, 0]
        self.illegal, self.later = 0, None
        self.high = self.low = None
        self.turns = 0
        self.rows, self.chars, self.spilling = [], 0, False

    def add(self, turn, role: str, text: str, fault: int, steps: _Steps) -> tuple:
        self.n += 1
        self.counts[fault] += 1
        if self.later is not None and role[:1] + self.later not in ("su", "ua", "au"):
            self.illegal += 1
        self.later = role[:1]
        if turn is not None and turn != self.low:
            self.high = turn if self.high is None else self.high
            self.low, self.turns = turn, self.turns + 1
        self.costs, pointers = steps(self.costs, self.later, fault)
        self.chars += len(role) + len(text)
        return self.n, turn, role, text, pointers

    def report(self) -> dict:
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, "blank": self.counts[BLANK], "duplicate": self.counts[DUPLICATE],
                "truncated": self.counts[CUT_OFF], "illegal": self.illegal, "cost": self.costs[START]}


class _Out:
    """Rows on their way out, in batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.chars = schema, [], 0

    def add(self, chars: int, **row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.chars += chars
        if len(self.rows) >= FLUSH_ROWS or self.chars >= FLUSH_CHARS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            cols = [pa.array([r.get(f.name) for r in self.rows], type=f.type) for f in self.schema]
            self.rows, self.chars = [], 0
            yield pa.RecordBatch.from_arrays(cols, schema=self.schema)


def _walked(conv, report: dict, rows, as_rows: bool, out: _Out) -> Iterator[pa.RecordBatch]:
    """Send out a conversation's repaired rows or its report; ``rows`` first turn first."""
    walk, place = Walk(), 0
    for turn, role, text, pointers in (*rows, (None, None, None, None)) if isinstance(rows, list) else rows:
        edits = walk.end() if pointers is None else walk.row(role, text, pointers)
        for edit, new_role, new_text in edits:
            place += 1
            if as_rows:
                yield from out.add(len(new_text), conv=conv, what=FINISHED, place=place, edit=edit, role=new_role,
                                   text=new_text, turn=None if edit == "I" else turn)
    if not as_rows:
        yield from out.add(len(walk.audit), conv=conv, what=FINISHED, **report, audit=walk.audit.decode(),
                           repaired_sha256=walk.digest.hexdigest())


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def _backward(schema: pa.Schema, as_rows: bool, spill_rows: int, spill_chars: int):
    """First stream: rows of a conversation come last turn first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, steps, now = _Out(schema), _Steps(), None

        def spill(rows):
            for n, turn, role, text, pointers in rows:
                yield from out.add(len(text), conv=now.conv, what=SPILLED, nth=n, turn=turn, role=role, text=text,
                                   pointers=pointers)

        def close():
            if now.spilling:
                yield from out.add(0, conv=now.conv, what=SUMMARY, nth=now.n + 1, **now.report())
            else:
                yield from _walked(now.conv, now.report(), [r[1:] for r in reversed(now.rows)], as_rows, out)

        for conv, turn, role, text, present, fault in _columns(batches, ["conv", "turn", "role", "text", "present", "fault"]):
            if now is None or conv != now.conv:
                if now is not None:
                    yield from close()
                now = _Conversation(conv)
            if not present:
                continue
            row = now.add(turn, role, text, fault, steps)
            if now.spilling:
                yield from spill([row])
            else:
                now.rows.append(row)
                if len(now.rows) > spill_rows or now.chars > spill_chars:
                    now.spilling = True
                    yield from spill(now.rows)
                    now.rows = []
        if now is not None:
            yield from close()
        yield from out.flush()

    return run


def _forward(schema: pa.Schema, as_rows: bool):
    """Second stream: a spilled conversation's summary, then its rows, first turn first."""
    fields = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows = _Out(schema), _columns(batches, ["conv", "what", "turn", "role", "text", "pointers", *fields])
        head = next(rows, None)
        while head is not None:
            conv, report, follow = head[0], dict(zip(fields, head[6:], strict=True)), [None]

            def own(conv=conv, follow=follow):
                for c, what, turn, role, text, pointers, *_ in rows:
                    if what == SUMMARY:
                        follow[0] = (c, what, turn, role, text, pointers, *_)
                        break
                    yield turn, role, text, pointers
                yield None, None, None, None

            yield from _walked(conv, report, own(), as_rows, out)
            head = follow[0]
        yield from out.flush()

    return run


# ---------------------------------------------------------------------------
# Spark stages
# ---------------------------------------------------------------------------

def faulty_rows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", present_col: str | None = None) -> DataFrame:
    """(conv, turn, role, text, present, fault), partitioned by conversation and sorted last turn first."""
    text = F.coalesce(F.col(text_col), F.lit(" "))
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), text.alias("text"),
        (F.coalesce(F.col(present_col), F.lit(True)) if present_col else F.lit(True)).alias("present"))
    rows = rows.repartition(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv")
    # Both the window and the sort run on that partitioning; the window sorts a conversation by content and keeps a row at a time.
    same = Window.partitionBy("conv", "present", F.xxhash64("role", "text"), F.xxhash64(F.lit(1), "text", "role")).orderBy("turn")
    rows = rows.withColumn("again", F.row_number().over(same) > 1)
    words = F.btrim("text", F.lit(SPACE))
    fault = (F.when(words == "", BLANK).when(F.col("again"), DUPLICATE)
             .when(~F.substring(words, -1, 1).isin(".", "!", "?"), CUT_OFF).otherwise(FINE))
    order = [F.col("turn").desc_nulls_last(), F.desc("role"), F.desc("text"), F.desc("again")]
    return rows.withColumn("fault", fault).sortWithinPartitions("conv", *order).select(
        "conv", "turn", "role", "text", "present", "fault")


def _streamed(turns: DataFrame, as_rows: bool, spill_rows: int, spill_chars: int, **columns) -> DataFrame:
    rows = faulty_rows(turns, **columns)
    schema = T.StructType([T.StructField("conv", rows.schema["conv"].dataType), *T.StructType.fromDDL(
        f"what int, nth long, turn long, role string, text string, pointers int, place long, edit string, {_REPORT}").fields])
    arrow = to_arrow_schema(schema)
    first = scratch_table(arrow_stage(rows, _backward(arrow, as_rows, spill_rows, spill_chars), schema), "conversations")
    giant = first.where(F.col("what") != FINISHED)
    giant = giant.repartition(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv")
    second = arrow_stage(giant.sortWithinPartitions("conv", F.desc("nth")), _forward(arrow, as_rows), schema)
    return first.where(F.col("what") == FINISHED).unionByName(second)


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", present_col: str | None = None, spill_rows: int = SPILL_ROWS,
           spill_chars: int = SPILL_CHARS) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row a conversation.

    Rows are taken by turn, null turns first, then by role and text.  Null roles and texts are one space; rows with a
    null conversation form one conversation.  Repeated rows count each, as duplicates from the second on.  Rows
    whose ``present_col`` is false only name their conversation.  Turns are integers.  A conversation without
    rows has zeros, an empty audit and the hash of the empty string.  Other columns are ignored; an empty table gives
    an empty result.
    """
    out = _streamed(turns, False, spill_rows, spill_chars, conv_col=conv_col, turn_col=turn_col, role_col=role_col,
                    text_col=text_col, present_col=present_col)
    return out.select(F.col("conv").alias(conv_col), *[f.name for f in T.StructType.fromDDL(_REPORT).fields])


def repaired_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text", present_col: str | None = None, spill_rows: int = SPILL_ROWS,
                   spill_chars: int = SPILL_CHARS) -> DataFrame:
    """(conv, place, edit, turn, role, text): every edit of ``repair`` in order.

    Rows with edit D are those that go; the others, in order of ``place``, are the repaired conversation.
    Inserted rows have no turn and an empty text.
    """
    out = _streamed(turns, True, spill_rows, spill_chars, conv_col=conv_col, turn_col=turn_col, role_col=role_col,
                    text_col=text_col, present_col=present_col)
    return out.select(F.col("conv").alias(conv_col), "place", "edit", F.col("turn").alias(turn_col),
                      F.col("role").alias(role_col), F.col("text").alias(text_col))


def damage(turns: DataFrame) -> DataFrame:
    """``conversations`` with planted faults, chosen by crc32 of ``conv_id:turn`` modulo 20; nulls are one space.

    0 drops the row (it stays as one that is not ``present``), 1 empties its text, 2 takes ``.!?`` out of it,
    3 repeats it, 4 makes its role user.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"),
                       F.explode(copies).alias("copy")).drop("copy")


# The same by a recursion over rows from the last to the first that carries, for each place of the
# pattern, the least (cost, audit) and the text it gives.  CRC-32 has no function there: its polynomial is fixed.
ORACLE_SQL = r"""
with recursive raw as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, dense_rank() over (order by conv_id) as cid,
    list_reduce([4294967295::bigint] || list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''),
      lambda ch: unicode(ch)::bigint),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))) as inverted
  from conversations),
coded as (select *, xor(inverted, 4294967295) % 20 as kind from raw),
hurt as (select cid, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text
  from coded, range(2) t(copy) where kind <> 0 and (copy = 0 or kind = 3)),
ordered as (select *, row_number() over (partition by cid order by turn nulls first, role, text) as i from hurt),
placed as (select *, row_number() over (partition by cid, role, text order by i) > 1 as again,
    trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as words from ordered),
rows_ as (select cid, i, turn, role, text, role[1] as r1, case when words = '' then 1 when again then 2
    when words[-1] not in ('.', '!', '?') then 3 else 0 end as fault,
    lead(role[1]) over (partition by cid order by i) as after,
    i < count(*) over (partition by cid) as inner_ from placed),
conv as (select cid, any_value(conv_id) as conv_id from coded group by cid),
counts as (select cid, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
    count(*) filter (inner_ and r1 || after not in ('su', 'ua', 'au')) as illegal from rows_ group by cid),
dp as (
  select cid, n + 1 as i, {'c': 0::bigint, 's': '', 'o': ''} as p, {'c': 6::bigint, 's': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'} as s,
    {'c': 3::bigint, 's': 'I', 'o': chr(10) || 'assistant:'} as u, {'c': 0::bigint, 's': '', 'o': ''} as a from counts
  union all
  select cid, i,
    least(p, {'c': 3 + least(u, {'c': 3 + a.c, 's': 'I' || a.s, 'o': chr(10) || 'assistant:' || a.o}).c,
              's': 'I' || least(u, {'c': 3 + a.c, 's': 'I' || a.s, 'o': chr(10) || 'assistant:' || a.o}).s,
              'o': chr(10) || 'user:' || least(u, {'c': 3 + a.c, 's': 'I' || a.s, 'o': chr(10) || 'assistant:' || a.o}).o}),
    least(s, {'c': 3 + least(u, {'c': 3 + a.c, 's': 'I' || a.s, 'o': chr(10) || 'assistant:' || a.o}).c,
              's': 'I' || least(u, {'c': 3 + a.c, 's': 'I' || a.s, 'o': chr(10) || 'assistant:' || a.o}).s,
              'o': chr(10) || 'user:' || least(u, {'c': 3 + a.c, 's': 'I' || a.s, 'o': chr(10) || 'assistant:' || a.o}).o}),
    least(u, {'c': 3 + a.c, 's': 'I' || a.s, 'o': chr(10) || 'assistant:' || a.o}),
    least(a, {'c': 3 + u.c, 's': 'I' || u.s, 'o': chr(10) || 'user:' || u.o})
  from (
    select d.cid, r.i,
      least({'c': 4 + p.c, 's': 'D' || p.s, 'o': p.o},
        case when fault not in (1, 2) and r1 = 's' then {'c': m + s.c, 's': 'K' || s.s, 'o': x || s.o}
             when fault not in (1, 2) and r1 = 'u' then {'c': m + u.c, 's': 'K' || u.s, 'o': x || u.o} end,
        case when fault not in (1, 2) then {'c': 3 + m + u.c, 's': 'R' || u.s, 'o': chr(10) || 'user:' || r.text || u.o} end) as p,
      least({'c': 4 + s.c, 's': 'D' || s.s, 'o': s.o},
        case when fault not in (1, 2) and r1 = 'u' then {'c': m + u.c, 's': 'K' || u.s, 'o': x || u.o} end,
        case when fault not in (1, 2) then {'c': 3 + m + u.c, 's': 'R' || u.s, 'o': chr(10) || 'user:' || r.text || u.o} end) as s,
      least({'c': 4 + u.c, 's': 'D' || u.s, 'o': u.o},
        case when fault not in (1, 2) and r1 = 'a' then {'c': m + a.c, 's': 'K' || a.s, 'o': x || a.o} end,
        case when fault not in (1, 2) then {'c': 3 + m + a.c, 's': 'R' || a.s, 'o': chr(10) || 'assistant:' || r.text || a.o} end) as u,
      least({'c': 4 + a.c, 's': 'D' || a.s, 'o': a.o},
        case when fault not in (1, 2) and r1 = 'u' then {'c': m + u.c, 's': 'K' || u.s, 'o': x || u.o} end,
        case when fault not in (1, 2) then {'c': 3 + m + u.c, 's': 'R' || u.s, 'o': chr(10) || 'user:' || r.text || u.o} end) as a
    from dp d join (select *, case when fault = 3 then 3 else 0 end as m, chr(10) || role || ':' || text as x from rows_) r
      on r.cid = d.cid and r.i = d.i - 1)
)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(dp.p.c, 0) as cost, coalesce(dp.p.s, '') as audit,
  sha256(coalesce(substr(dp.p.o, 2), '')) as repaired_sha256
from conv left join counts using (cid) left join dp on dp.cid = conv.cid and dp.i = 1
"""
