"""Pigeonhole edit matching against a plain dynamic-programming search."""

import random

from tidelink.llm import decontamination as D


def plain_distance(pattern, text):
    """Smallest edit distance of the pattern to any substring."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def brute(docs, items, rate):
    out = set()
    for doc, text in docs:
        norm = D.normalise(text)
        for item, it in items:
            p = D.normalise(it)
            if len(p) < D.SHORT_ITEM:
                if p and f" {p} " in f" {norm} ":
                    out.add((doc, item, 0))
            elif norm:
                d, k = plain_distance(p, norm), int(len(p) * rate)
                if d <= k:
                    out.add((doc, item, d))
    return out


def make():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(rng.randrange(8, 30))) for i in range(12)] + [(90, "ab"), (91, None), (92, "")]
    docs = []
    for doc in range(60):
        text = prose(40)
        if doc % 2:
            part = list(items[doc % 12][1])
            for _ in range(rng.randrange(0, 7)):
                at = rng.randrange(len(part))
                rng.choice([lambda: part.insert(at, "x"), lambda: part.pop(at), lambda: part.__setitem__(at, "q")])()
            copy = "".join(part)
            text = f"{text[:50]} {copy.upper() if doc % 3 else copy.replace(' ', ', ')}! {text[50:]}"
        docs.append((doc, text))
    return docs + [(100, None), (101, ""), (102, "  ")], items


def test_find_leaks_equals_brute_force(spark):
    docs, items = make()
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_leaks(frame.repartition(3), bench)
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got.collect()} == brute(docs, items, D.ERROR_RATE)
    kept = D.drop_leaks(frame, bench)
    leaked = {d for d, _, _ in brute(docs, items, D.ERROR_RATE)}
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - leaked


def test_short_items_match_whole_words_and_ids_are_of_any_type(spark):
    docs = spark.createDataFrame([("a", "Well: what is the CAPITAL of France?"), ("b", "what is the capital of Frances"),
                                  ("c", "unrabbit rabbits"), ("d", "a rabbit."), ("e", "dog rabbit dog")],
                                 "doc_id string, text string")
    items = [(1, "What is the capital of France?"), (2, "Rabbit"), (3, "?!")]
    for kind in ("int", "string", "short", "decimal(9,0)"):
        bench = spark.createDataFrame(items, "item_id int, text string").selectExpr(f"cast(item_id as {kind}) item_id", "text")
        got = D.find_leaks(docs, bench)
        assert got.schema["item_id"].dataType == bench.schema["item_id"].dataType
        rows = {(r["doc_id"], int(r["item_id"]), r["distance"], r["start"]) for r in got.collect()}
        assert rows == {("a", 1, 0, 5), ("d", 2, 0, 2), ("e", 2, 0, 4)}
        assert {r["doc_id"] for r in D.drop_leaks(docs, bench).collect()} == {"b", "c"}


def test_slices_cover_all_items(spark, monkeypatch):
    docs, items = make()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, D.find_leaks(frame, bench).collect()))
    monkeypatch.setattr(D, "MAX_BENCH_BYTES", 300)
    assert sorted(map(tuple, D.find_leaks(frame, bench).collect())) == whole
    assert sorted(r["doc_id"] for r in D.drop_leaks(frame, bench).collect()) == sorted(
        {d for d, _ in docs} - {r[0] for r in whole})


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "x" * 40)], "doc_id long, text string")
    assert D.find_leaks(docs, bench).collect() == []
    assert D.find_leaks(some, bench).collect() == []
    assert D.drop_leaks(some, bench).count() == 1
