"""Vector codes against plain Lloyd rounds; cover trees by their invariants."""

import hashlib
import math
import random

import numpy as np
import pytest

from noteflare.llm import vector_codes as V


def _brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i, v, lab) for i, v, lab, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(i, [max(-2 ** 26, min(2 ** 26, math.floor(1024 * x))) for x in v], lab) for i, v, lab in kept]
    out = []
    for dim in {len(v) for _, v, _ in ints}:
        mine = sorted((r for r in ints if len(r[1]) == dim), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        at = [0]
        for p in range(parts):
            at.append(at[-1] + dim // parts + (p < dim % parts))
        cut = [[v[a:b] for a, b in zip(at, at[1:])] for _, v, _ in mine]
        books = [[c[p] for c in cut[:entries]] for p in range(parts)]
        near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))
        for _ in range(rounds):
            for p in range(parts):
                groups = {}
                for c in cut:
                    groups.setdefault(near(p, c[p])[1], []).append(c[p])
                books[p] = [[sum(col) // len(groups[e]) for col in zip(*groups[e])] if e in groups else c
                            for e, c in enumerate(books[p])]
        sha = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
        for (i, _, lab), c in zip(mine, cut):
            found = [near(p, c[p]) for p in range(parts)]
            out.append((i, lab, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), sha))
    total = {}
    for _, lab, _, err, _ in out:
        total[lab] = total.get(lab, 0) + err
    return sorted(((i, code, err, total[lab], sha) for i, lab, code, err, sha in out), key=str)


ROWS = "vec_id long, embedding array<float>, label int, Code string, dim string"


def _rows(seed=2, n=400, dim=12):
    rnd = random.Random(seed)
    hot = [rnd.gauss(0, .1) for _ in range(dim)]
    centres = [[rnd.gauss(0, .5) for _ in range(dim)] for _ in range(9)]
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f32([x + rnd.gauss(0, .02) for x in rnd.choice(centres)]), rnd.choice([0, 1, None]), "c", "d") for i in range(n)]
    rows += [(n + i, f32(hot), 5, "c", "d") for i in range(n // 3)]  # one vector many times
    rows += [rows[3], (None, f32(hot), 1, "c", "d"), (n * 2, None, 1, "c", "d"), (n * 2 + 1, [None] * dim, 1, "c", "d"),
             (n * 2 + 2, [float("nan")] * dim, 1, "c", "d"), (n * 2 + 3, [float("inf")] + [0.0] * (dim - 1), 1, "c", "d"),
             (n * 2 + 4, [0.0] * dim, 1, "c", "d"), (n * 2 + 5, [1e30] * dim, 1, "c", "d")]
    return rows


def _result(spark, rows, **kw):
    out = V.compress(spark.createDataFrame(rows, ROWS).repartition(5), **kw)
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in out.collect()), key=str)


@pytest.mark.parametrize("entries", [8, 256])
def test_equals_plain_lloyd(spark, entries):
    rows = _rows()
    assert _result(spark, rows, entries=entries) == _brute(rows, entries=entries)


def test_other_lengths_few_rows_and_empty_table(spark):
    rows = [(1, [.5, .25, 1.0, 2.0, 3.0], 1, "c", "d"), (2, [.5, .25, 1.0, 2.0, -3.0], 1, "c", "d"),
            (3, [1.0, 2.0], None, "c", "d"), (4, [], None, "c", "d"), (5, [1.0, 2.5], 1, "c", "d")]
    assert _result(spark, rows) == _brute(rows)
    assert _result(spark, []) == []


def test_tree_covers_separates_and_prunes():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.integers(-20, 20, (700, 6)) + rng.integers(-3, 3, 6) * 4000 for _ in range(8)])
    points = np.concatenate([points, np.repeat(points[:1], 500, 0)])
    tree = V.cover_tree(points)
    assert sorted(tree["order"]) == list(range(len(points)))
    ordered = tree["points"].astype(float)
    assert (ordered == points[tree["order"]]).all()
    for i, (lo, hi, a, b, r) in enumerate(zip(*(tree[k] for k in ("first", "last", "child", "child_end", "radius")))):
        assert np.isclose(np.sqrt(((ordered[lo:hi] - ordered[lo]) ** 2).sum(1).max()), r)
        if b > a:
            assert tree["first"][a] == lo and tree["last"][b - 1] == hi
            assert (tree["first"][a + 1:b] == tree["last"][a:b - 1]).all() and (tree["radius"][a:b] <= r / 2 + 1e-9).all()
            net = ordered[tree["first"][a:b]]
            gaps = np.sqrt(((net[:, None] - net[None]) ** 2).sum(2)) + np.eye(len(net)) * 1e18
            assert gaps.min() > r / 2 - 1e-9
        else:
            assert r == 0 or hi - lo <= V.LEAF
    book = points[rng.integers(0, len(points), 40)].astype(np.int64)
    nearest, sums, counts, compared = V.assign(tree, book)
    exact = ((tree["points"][:, None, :].astype(np.int64) - book[None]) ** 2).sum(2).argmin(1)
    assert (nearest == exact).all() and counts.sum() == len(points)
    assert all((sums[e] == tree["points"][exact == e].sum(0)).all() for e in range(40))
    spread = points[[0, *range(700, 5600, 700)]].astype(np.int64)  # far entries: whole clusters go at once
    assert V.assign(tree, spread)[3] < len(points) * len(spread) / 20
