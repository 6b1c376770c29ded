"""Conversation repair against an exhaustive search; spilled conversations against kept ones."""

import hashlib
import heapq
import random
import re

import pytest

from noteflare.llm import conversation_repair as C

SPACE = " \t\n\x0b\x0c\r"
ROWS = "conv_id long, turn long, role string, text string, Cost string, present boolean, fault string"
REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _cheapest(rows):
    """(cost, audit, repaired) by Dijkstra over (row, roles so far), with every edit spelled out."""
    best, todo = {}, [(0, "", 0, "", ())]
    while todo:
        cost, audit, i, roles, out = heapq.heappop(todo)
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, audit, "\n".join(out)
        short = ("s" if roles[:1] == "s" else "") + ("ua" if "ua" in roles else "") + (roles[-1:] if roles else "")
        if (i, short) in best and best[i, short] <= (cost, audit):
            continue
        best[i, short] = (cost, audit)
        steps = [(3, "I", i, r[0], r + ":") for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            steps.append((4, "D", i + 1, "", None))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                steps.append((more, "K", i + 1, role[:1] or "?", f"{role}:{text}"))
                steps += [(3 + more, "R", i + 1, r[0], f"{r}:{text}") for r in ("user", "assistant")]
        for price, edit, j, initial, line in steps:
            if re.fullmatch(r"(s|s?(ua)*u?)", roles + initial):
                heapq.heappush(todo, (cost + price, audit + edit, j, roles + initial, out + ((line,) if line is not None else ())))
    raise AssertionError


def _brute(table):
    convs = {}
    for conv, turn, role, text, _, present, _ in table:
        rows = convs.setdefault(conv, [])
        if present is not False:
            rows.append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        seen, faults, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for *_, role, text in rows:
            kind = ("blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen
                    else "truncated" if text.strip(SPACE)[-1] not in ".!?" else None)
            seen.add((role, text))
            counts.update({kind: counts[kind] + 1} if kind else {})
            faults.append((role, text, kind))
        turns = [t for known, t, *_ in rows if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, text = _cheapest(faults)
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def _table(seed=1, n=150):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", None, "And é so on. ", "Ünd", "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "unnamed", None, ""]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rnd.randint(0, 7)):
            row = (conv, rnd.choice([turn, turn, turn * 2, None]), rnd.choice(roles[:3] if rnd.random() < .8 else roles),
                   rnd.choice(texts) if rnd.random() < .5 else f"Text {rnd.random()}.", "x", rnd.random() > .05, "f")
            rows += [row] * rnd.choice([1, 1, 1, 2])
    return rows + [(n + 1, 4, "user", "gone.", "x", False, "f")]


def _report(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.fixture(scope="module")
def table(spark):
    rows = _table()
    return rows, spark.createDataFrame(rows, ROWS).repartition(5).cache()


def test_equals_exhaustive_search(table):
    rows, df = table
    out = C.repair(df, present_col="present")
    assert out.columns == ["conv_id", *REPORT]
    assert _report(out) == _brute(rows)


def test_spilled_conversations_give_the_same(table):
    rows, df = table
    assert _report(C.repair(df, present_col="present", spill_rows=2)) == _brute(rows)
    assert _report(C.repair(df, present_col="present", spill_chars=10)) == _brute(rows)


@pytest.mark.parametrize("spill_rows", [3, 10_000])
def test_repaired_rows_follow_the_audit(table, spill_rows):
    rows, df = table
    want = _brute(rows)
    convs = {}
    for r in C.repaired_turns(df, present_col="present", spill_rows=spill_rows).collect():
        convs.setdefault(r.conv_id, []).append(r)
    for conv, report in want.items():
        edits = sorted(convs.get(conv, []), key=lambda r: r.place)
        assert "".join(r.edit for r in edits) == report[6]
        text = "\n".join(f"{r.role}:{r.text}" for r in edits if r.edit != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == report[7]


def test_one_giant_conversation_is_streamed(spark):
    n = 30_000
    rows = spark.range(n).selectExpr("7L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role",
                                     "if(id % 10 = 3, 'same words', concat('text ', id, '.')) text")
    one = C.repair(rows, spill_rows=1000).collect()
    assert len(one) == 1 and len(one[0].audit) >= n and one[0].duplicate == n // 10 - 1
    assert one[0].asDict() == C.repair(rows, spill_rows=10 ** 9, spill_chars=10 ** 9).collect()[0].asDict()


def test_damage_kinds_and_empty_table(spark):
    import zlib
    rows = [(c, t, "assistant", "One. Two!") for c in [*range(40), None] for t in [*range(5), None]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {}
    for r in C.damage(df).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.present))
    say = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        want = ("user" if kind == 4 else role, {1: "", 2: "One Two"}.get(kind, text), kind != 0)
        assert got[conv, turn] == [want] * (2 if kind == 3 else 1)
    assert C.repair(df.limit(0)).collect() == [] and C.repaired_turns(df.limit(0)).collect() == []
