"""Large groups of near copies: each set stands once, and no join pairs the members of a group."""

import random

from pyspark.sql import functions as F

from tests.llm.test_jaccard_join import brute
from tests.llm.test_near_duplicate_stage import brute_kept
from tidelink.llm import jaccard_join as J


def near_copies(size, copies, edits, seed=21):
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(size)]
    rows = [(i, " ".join(base)) for i in range(30)]
    for i in range(30, 30 + copies):  # some link to the text, some to a copy only, some to none
        copy = list(base)
        for _ in range(rng.randrange(1, edits)):
            copy[rng.randrange(size)] = f"x{rng.randrange(4)}"
        rows.append((i, " ".join(copy)))
    return rows


def test_a_class_stands_once_however_many_rows_share_a_bit(spark, monkeypatch):
    monkeypatch.setattr(J, "BITMAP_BITS", 64)  # every row comes along
    rows = near_copies(60, 20, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    sized = J._size_docs(texts, 3)
    needed = (sized.groupBy("key", "route").agg(F.min("doc_id").alias("doc_id"))
              .withColumns({"as_member": F.col("doc_id") > 0, "as_hub": F.col("doc_id") == 0}))
    found = [(bytes(r["key"]), r["as_member"], r["as_hub"]) for r in J._sets_of(texts, needed, 3).collect()]
    assert sorted(found) == sorted((bytes(r["key"]), r["as_member"], r["as_hub"]) for r in needed.collect())


def test_members_that_do_not_link_to_the_hub_are_not_paired_by_a_join(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 40)
    seen, pairs = [], J._remaining_pairs

    def counted(compared, scheme):
        found = pairs(compared, scheme)
        seen.append(found.count())
        return found

    monkeypatch.setattr(J, "_remaining_pairs", counted)
    rows = near_copies(200, 240, 8)[30:]  # the hub is an edited copy: the others share what it lacks
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = J.jaccard_components(docs).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert len(seen) == 1 and seen[0] < len(rows)


def test_blocks_connect_what_links_without_counts(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 10)
    rows = near_copies(120, 90, 16)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = [r["doc_id"] for r in J.keep_one_per_component(docs, n=5, num=80, den=100).collect()]
    assert len(kept) == len(set(kept)) and set(kept) == brute_kept(rows)


def test_forest_connects_as_all_links_do():
    import numpy as np

    rng = np.random.default_rng(5)
    for rows, columns, share in ((7, 5, 0.1), (40, 30, 0.03), (30, 30, 0.9), (3, 1, 0)):
        links = rng.random((rows, columns)) < share

        def groups(pairs):
            root = list(range(rows + columns))
            for i, j in pairs:
                a, b = root[i], root[rows + j]
                root = [min(a, b) if r in (a, b) else r for r in root]
            return root

        forest = J._forest(links)
        assert len(forest) < rows + columns and all(links[i, j] for i, j in forest)
        assert groups(forest) == groups(np.argwhere(links).tolist())
