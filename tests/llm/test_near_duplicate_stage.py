"""The pipeline's near-duplicate stage against a brute force on five-word shingles and 0.8."""

import random

import corpus_pipeline as P
from tests.llm.test_jaccard_join import fixture, words_of


def brute_kept(rows, n=5, num=80, den=100):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append(frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return set(least.values())


def test_stage_links_five_words_from_080(spark):
    rng = random.Random(11)
    rows = fixture()
    for doc in range(10_000, 10_040, 2):  # one word of 50 to 57 changed: 0.8 on five words, not 0.9 on three
        base = [f"v{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(50, 58))]
        copy = list(base)
        copy[len(base) // 2] = "changed"
        rows += [(doc, " ".join(base)), (doc + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = [r["doc_id"] for r in P.near_duplicate_stage(spark, docs, "").collect()]
    assert len(kept) == len(set(kept)) and set(kept) == brute_kept(rows)
    assert not any(doc % 2 for doc in kept if doc >= 10_000)
    assert set(kept) != brute_kept(rows, 3, 90)
