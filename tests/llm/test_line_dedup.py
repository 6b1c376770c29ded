"""Line dedup against brute force: awkward rows, several batch counts, plan of the runs."""

import random
from collections import defaultdict

import pytest

from noteflare.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, N_Lines string, gone string"


def _key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def _brute(rows, min_docs=5, min_length=40):
    held = defaultdict(list)
    for doc_id, text, *_ in rows:
        for key in {_key(x) for x in (text or "").split("\n")}:
            if len(key) >= min_length:
                held[key].append(doc_id)
    keeper = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= min_docs}
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if _key(x) not in keeper or keeper[_key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def _rows():
    rnd = random.Random(3)
    common = ["Common Ünder line number %02d of those that many documents share" % i for i in range(6)]
    rows = [(0, None, "a", "b"), (1, "", "a", "b"), (2, "\n\n", "a", "b"), (None, common[0], "a", "b"),
            (None, common[1] + "\nx", "a", "b"), (3, "short\nshort", "a", "b")]
    for i in range(4, 60):
        lines = [rnd.choice([c, "  " + c.upper() + "\t", c.lower() + "\r"]) if ord(c[0]) < 128 else c
                 for c in rnd.sample(common, rnd.randint(0, 4))]
        lines += [f"own line {i} {j} " + "z" * rnd.choice([5, 50]) for j in range(rnd.randint(0, 5))]
        lines += lines[:1] * rnd.randint(0, 2)
        rnd.shuffle(lines)
        rows.append((i, "\n".join(lines), "a", "b"))
    rows += [rows[10]] * 7 + [(59, rows[20][1], "a", "b")]  # repeated rows and a repeated largest id
    rows += [(70 + i, "é" * 40 + "\n" + "y" * 39, "a", "b") for i in range(5)]
    rows += [(None, "only documents without an id hold this rather long line", "a", "b")] * 6
    return rows + [(200, "\n".join(f"line {j} " + common[j % 6] for j in range(20_000)), "a", "b")]


def _result(spark, rows, **kw):
    out = line_dedup.dedup(spark.createDataFrame(rows, DOCS).repartition(5), **kw)
    assert set(out.columns) == {"doc_id", "text", "gone", "n_lines", "n_dropped", "kept_text"}
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out.collect()), key=str)


@pytest.mark.parametrize("n_batches,fanout", [(4, 2), (1, 2), (7, 3)])
def test_equals_brute_force_whatever_the_batches(spark, n_batches, fanout):
    rows = _rows()
    assert _result(spark, rows, n_batches=n_batches, fanout=fanout) == _brute(rows)


def test_empty_table_and_no_long_line(spark):
    assert _result(spark, []) == []
    rows = [(i, "short", "a", "b") for i in range(9)]
    assert _result(spark, rows) == _brute(rows)


def test_runs_merge_without_an_exchange(spark):
    runs = line_dedup.LineRuns(spark, fanout=3)
    frame = lambda a, b: spark.range(a, b).selectExpr("id h1", "id * 7 h2", "1L n_docs", "id keeper")
    try:
        runs.add(frame(0, 500))
        runs.add(frame(300, 800))
        assert [len(x) for x in runs.levels] == [2]
        plan = runs.index()._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        runs.add(frame(700, 900))
        assert [len(x) for x in runs.levels] == [0, 1]  # compacted into the next level
        got = {r.h1: (r.n_docs, r.keeper) for r in runs.index().collect()}
        want = {i: sum(i in range(a, b) for a, b in ((0, 500), (300, 800), (700, 900))) for i in range(900)}
        assert got == {i: (n, i) for i, n in want.items()}
    finally:
        runs.close()
    assert not spark.catalog.listTables()
