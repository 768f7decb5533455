"""Nearest neighbours against brute force."""

import numpy as np

from tidelink.llm import nearest as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k):
    ok = [(i, np.asarray(v, dtype=np.float64)) for i, v in {(i, tuple(v)) for i, v, _ in rows if i is not None and v
          and all(x is not None and np.isfinite(x) for x in v) and any(v)}]
    out = {}
    for q, qv in ok:
        if q % every == 0:
            near = sorted((-(v * qv).sum(), i) for i, v in ok if i != q)[:k]
            out[q] = [i for _, i in near]
    return out


def ranked(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    return {q: [x[i] for i in sorted(x)] for q, x in out.items()}


def f32(v):
    return [float(np.float32(x)) for x in v]


def test_recall_over_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF_ROWS", 150)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 24))
    rows = [(i, f32(centres[i % 6] + 0.7 * rng.standard_normal(24)), 0) for i in range(900)]
    got, want = ranked(N.nearest(spark.createDataFrame(rows, SCHEMA).repartition(4))), brute(rows, 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def test_ties_copies_and_bad_vectors(spark):
    rows = [(i, [1.0, 0.0], 1) for i in range(100)] + [(i, [0.0, 2.0], 1) for i in range(100, 130)]
    rows += [(200, None, 0), (220, [], 0), (240, [0.0, 0.0], 0), (260, [float("nan"), 1.0], 0), (280, [None, 1.0], 0),
             (300, [float("inf"), 1.0], 0), (None, [1.0, 1.0], 0), (0, [1.0, 0.0], 1)]
    got = ranked(N.nearest(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert got == brute(rows, 20, 20)
    assert got[0] == list(range(1, 21)) and got[40] == list(range(20)) and got[120][:3] == [100, 101, 102]


def test_few_candidates_and_empty(spark):
    rows = [(0, [1.0, 2.0], 1), (20, [2.0, 1.0], 1), (3, [-1.0, 0.0], 1)]
    assert ranked(N.nearest(spark.createDataFrame(rows, SCHEMA))) == {0: [20, 3], 20: [0, 3]}
    assert N.nearest(spark.createDataFrame([], SCHEMA)).collect() == []
    assert N.nearest(spark.createDataFrame([(7, [1.0], 1)], SCHEMA)).collect() == []


def test_chi_square_quantile():
    assert abs(N.chi_square_quantile(0.95, 8) - 15.507) < 1e-3
