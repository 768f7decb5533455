"""n_links of the Jaccard join against all pairs."""

import random

import pytest

from tests.llm.test_jaccard_join import fixture, words_of
from tidelink.llm import jaccard_join as J


def brute_links(rows, n, num, den):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append(frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    kinds = [s for s in set(sets) if s]
    count = {s: sum(den * len(s & t) >= num * len(s | t) for t in kinds) - 1 for s in kinds}
    return sorted((doc, count.get(s, 0)) for (doc, _), s in zip(rows, sets))


def close_group():
    rng = random.Random(7)
    base = [f"b{i}" for i in range(200)]
    rows = [(0, " ".join(base)), (1, " ".join(base))]
    for i in range(2, 240):  # edits at a few common places too, so that differences overlap
        copy = list(base)
        for _ in range(rng.randrange(1, 5)):
            copy[rng.choice((20, 60, 100, rng.randrange(200)))] = f"x{rng.randrange(3)}"
        rows.append((i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100)])
def test_links_equal_all_pairs(spark, monkeypatch, n, num, den):
    monkeypatch.setattr(J, "BLOCK", 40, raising=False)
    rows = [(doc + 1_000, text) for doc, text in fixture()] + close_group()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = J.jaccard_components(docs, n=n, num=num, den=den).select("doc_id", "n_links")
    assert sorted(map(tuple, got.collect())) == brute_links(rows, n, num, den)
