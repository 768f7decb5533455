"""Whitening against plain Python numbers."""

from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest

from tidelink.llm import whitening as W
from tidelink.llm.common import read_docs

SF = "/root/testdata/sf0.001"


def brute(rows, dim, keep=32):
    good = [(i, [floor(64 * Fraction(float(c))) + 1000000 for c in v]) for i, v in rows
            if v is not None and len(v) == dim and all(c is not None and isfinite(c) for c in v)]
    n = len(good)
    sums = [sum(x[d] for _, x in good) for d in range(dim)]
    cov = np.empty((dim, dim))
    for a in range(dim):
        for b in range(dim):
            cov[a, b] = sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for _, x in good) / n ** 3
    e, p = np.linalg.eigh(cov)
    e, p = e[::-1], p[:, ::-1]
    out = {}
    for i, x in good:
        off = np.array([(n * c - s) / n for c, s in zip(x, sums)])
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        for k in range(min(keep, dim)):
            out.setdefault(i, []).append((k + 1, n, deviation, off @ p[:, k] / np.sqrt(e[k]) if e[k] > 1e-9 else None, e[k] / e.sum()))
    return out


def check(got, want, dim):
    seen = {}
    for r in got:
        seen.setdefault(r["vec_id"], []).append(r)
    assert set(seen) == set(want)
    signs = {}
    for i, rows in seen.items():
        rows.sort(key=lambda r: r["component"])
        assert len(rows) == len(want[i]) == min(32, dim)
        for r, (k, n, deviation, white, share) in zip(rows, want[i]):
            assert (r["component"], r["n"], r["deviation"]) == (k, n, deviation)
            assert r["explained"] == pytest.approx(share, rel=1e-6, abs=1e-9)
            assert r["identity_error"] < 1e-6
            if white is None:
                assert r["whitened"] is None
            elif abs(white) > 1e-6:
                signs.setdefault(k, set()).add(np.sign(white) == np.sign(r["whitened"]))
                assert abs(r["whitened"]) == pytest.approx(abs(white), rel=1e-6)
    assert all(len(s) == 1 for s in signs.values())


def test_small_vectors_with_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.normal(0.3, 2, 5) * (1, 2, 3, 4, 5)]) for i in range(90)]
    rows += [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [1.0, float("nan"), 2.0, 3.0, 4.0]),
             (103, [1.0, float("inf"), 2.0, 3.0, 4.0]), (104, [1.0, 2.0]), (105, [])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, n int")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    check(W.whiten(frame.repartition(4)).collect(), brute(rows, 5), 5)
    twice = frame.filter("vec_id < 9").unionByName(frame.filter("vec_id < 9"))
    assert {r["n"] for r in W.whiten(twice).collect()} == {18}


def test_given_table(spark):
    emb = read_docs(spark, SF, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in emb.collect()]
    dim = max(len(v) for _, v in rows if v is not None)
    check(W.whiten(emb).collect(), brute(rows, dim), dim)


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(i * 10 ** 9 + 7), float(-i * i * 10 ** 8), 0.25 * i]) for i in range(12)]
    y = np.array([[int(64 * c) for c in v] for _, v in rows], dtype=np.int64)
    want = [sum(int(a) ** 2 for a in y[:, 0]), sum((int(a) + int(b)) ** 2 for a, b in y[:, :2])]
    assert W.pair_squares(y)[:2].tolist() == want
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, 3)
    for r in W.whiten(frame).collect():
        k = r["component"] - 1
        assert r["deviation"] == (want[r["vec_id"]][k][2] if want[r["vec_id"]][k][2] < 1 << 63 else None)


def test_no_variance_and_no_rows(spark):
    kind = "vec_id string, embedding array<double>"
    got = W.whiten(spark.createDataFrame([("a", [1.0, 2.0]), (None, [1.0, 3.0])], kind)).collect()
    assert sorted((r["component"], r["whitened"] is None) for r in got) == [(1, False), (1, False), (2, True), (2, True)]
    one = W.whiten(spark.createDataFrame([("a", [1.0, 2.0])], kind)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None)] * 2
    assert W.whiten(spark.createDataFrame([], kind)).collect() == []
    assert W.whiten(spark.createDataFrame([("a", None), ("b", [])], kind)).collect() == []
