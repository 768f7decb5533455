"""PartEnum join against all-pairs brute force on a small fixture."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelink.llm import jaccard_join as J
from tidelink.llm.jaccard_join import PartEnum, WordHashes, jaccard_components, keep_one_per_component, shingle_set


def words_of(text):
    return (text or "").encode().lower().split()


def brute(rows):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append(frozenset(tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(root(i), []).append(doc)
    return sorted((doc, len(sets[i]), min(least[root(i)])) for i, (doc, _) in enumerate(rows))


def fixture():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    rows, doc = [], 0
    for size in (1, 2, 3, 5, 11, 12, 25, 40, 80, 150, 400):
        for _ in range(3):
            base = [rng.choice(vocab) for _ in range(size)]
            rows.append((doc, " ".join(base)))
            doc += 1
            for _ in range(9):
                copy = list(base)
                for _ in range(rng.choice((0, 1, 1, 2, 4))):
                    at = rng.randrange(len(copy))
                    if rng.random() < 0.3:
                        copy.insert(at, "NEW%d" % rng.randrange(99))
                    else:
                        copy[at] = rng.choice(vocab)
                rows.append((doc, " ".join(copy).upper() if rng.random() < 0.2 else "\t".join(copy)))
                doc += 1
    rows += [(doc, None), (doc + 1, ""), (doc + 2, " \n"), (doc + 3, "w1 w2"), (doc + 4, "W1\x0bw2")]
    rng.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark):
    rows = fixture()
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted((r[0], r[1], r[2]) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == brute(rows)


def test_chains_of_edits_and_hot_copies(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(base)) for i in range(200)]
    for i in range(200, 420):  # every copy changes a few places of the same text
        copy = list(base)
        for _ in range(rng.randrange(1, 9)):
            copy[rng.randrange(120)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(copy)))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert sorted((r[0], r[1], r[2]) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == brute(rows)


@pytest.mark.parametrize("num", [90, 80])
def test_linked_sets_share_the_signatures_that_neither_leaves_out(num):
    rng = random.Random(1)
    scheme, known, mask, linked, spared = PartEnum(num, 100), WordHashes(), (1 << J._DROP_BITS) - 1, 0, 0
    for size in [9, 10, 11, 13, 19, 20, 21, 50, 90, 91, 200, 700]:
        for _ in range(30):
            words = [b"%d" % rng.randrange(10 ** 9) for _ in range(size + 2)]
            a = shingle_set(b" ".join(words), known)
            k = max(1, size // rng.choice((19, 25, 40)) if num == 90 else size // rng.choice((9, 11, 20)))
            b = shingle_set(b" ".join(words[k:] if rng.random() < 0.5 else words + [b"z%d" % i for i in range(k)]), known)
            inter = len(set(a.tolist()) & set(b.tolist()))
            if 100 * inter >= num * (len(a) + len(b) - inter) and inter < max(len(a), len(b)):
                (sa, ta), (sb, tb) = scheme.sign(a), scheme.sign(b)
                common = set(sa.tolist()) & set(sb.tolist())
                assert common
                drops = [t >> J._DROP_BITS & mask if s & 1 == t >> 2 * J._DROP_BITS & 1 else t & mask
                         for s in common for t in (ta, tb)]
                assert len(common) > max(drops)  # in the band that they share
                linked, spared = linked + 1, spared + (max(drops) > 0)
    assert linked > 50 and spared > 20


def test_subsets_are_enumerated_for_every_size():
    scheme, rng = PartEnum(80, 100), random.Random(2)
    for size in (5, 31, 32, 200, 5000):
        items = np.array(sorted(rng.getrandbits(63) for _ in range(size)), dtype=np.uint64)
        band = int(np.searchsorted(scheme.lows, size, side="right")) - 1
        own = scheme._sign(items, band)[0]
        assert scheme.parts(band) < len(own) <= 3 * scheme.parts(band)


def test_passage_that_many_texts_hold(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(150)) + f" {passage} " + " ".join(
        f"w{rng.randrange(10 ** 6)}" for _ in range(150))) for i in range(150)]
    rows += [(200 + i, rows[i][1] + " more words") for i in range(0, 150, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard_components(docs, n=5, num=80, den=100)
    want = {i: i for i in range(150)} | {200 + i: i for i in range(0, 150, 3)}
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want
    pairs = J._hub_pairs(J._signatures(docs.select("doc_id", F.col("text").cast("binary").alias("text")), PartEnum(80, 100), 5))
    assert pairs.count() < 100  # 50 links; the passage alone would name nearly every text


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(empty).collect() == []
    docs = spark.createDataFrame([(1, "a b c d", 7), (2, "a b c d", 8), (3, None, 9), (None, "a b c d", 1)],
                                 "doc_id long, text string, key int")
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_components(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (None, 1)}
    kept = keep_one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3]


@pytest.mark.parametrize("total", [2, 18, 19, 20, 38, 400])
def test_distance_bound(total):
    scheme = PartEnum()
    h = scheme.distance(total)
    assert 100 * (total - h) >= 90 * (total + h) and 100 * (total - h - 1) < 90 * (total + h + 1)
