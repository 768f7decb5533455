"""Token pieces against the tokenizer, packing against its bounds."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from tidelink.llm import packing as P


def test_word_ids_equal_whole_text_ids():
    whole, known = Tokenizer.from_file(P.TOKENIZER), P.WordIds(P.TOKENIZER)
    texts = ["Hello, WORLD!! It's a|b 3rd-party foo###", "É ÅngströmÅ naïve, ﬁne ß İx", "a\x1cb\xa0c　d 日本語 text",
             "x<|endoftext|>y <|ENDOFTEXT|>. ok", "don't we'll 12345 ½ éclair.", "", " \n\t", "&&&***$$$ tail.,.", "🙂🙂 ok🙂."]
    for text in texts:
        got = np.frombuffer(b"".join(known[w] for w in known.words_of(text.encode())), "<u4").tolist()
        assert got == whole.encode(text, add_special_tokens=False).ids, text


def test_bound_and_best_fit():
    rng = np.random.default_rng(2)
    for lengths in (rng.integers(1, 2048, 500), rng.integers(600, 900, 301), np.full(7, 1025), np.array([], int)):
        bins, offsets, used = P.best_fit_decreasing(lengths)
        assert P.lower_bound(lengths) <= used
        for b in range(used):
            mine = np.flatnonzero(bins == b)
            order = mine[np.argsort(offsets[mine])]
            assert offsets[order].tolist() == np.concatenate([[0], np.cumsum(lengths[order])[:-1]]).tolist()
            assert lengths[order].sum() <= 2048
    assert P.lower_bound(np.full(7, 1025)) == 7
    assert P.lower_bound(np.full(6, 683)) == 3
    assert P.best_fit_decreasing(np.full(6, 683))[2] == 3


def check_packing(rows, pieces, capacity):
    tokenizer = Tokenizer.from_file(P.TOKENIZER)
    want = []
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for j in range(0, len(ids), capacity):
            part = np.asarray(ids[j:j + capacity], "<u4")
            want.append((doc, j // capacity, j, len(part), zlib.crc32(part.tobytes())))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces]
    assert sorted(got, key=lambda t: (t[0] is None, t[0] or 0, *t[1:])) == sorted(
        want, key=lambda t: (t[0] is None, t[0] or 0, *t[1:]))
    placed = {}
    for r in pieces:
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in placed.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(placed)


def test_pack_documents(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma,", "Delta."]) for _ in range(rng.randrange(0, 60))))
            for i in range(300)]
    rows += [(7, "again alpha"), (7, "again alpha"), (None, "no id"), (900, None), (901, ""), (902, "word " * 500)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, length string")
    got = P.pack_documents(docs.repartition(4), capacity=64).collect()
    used = check_packing(rows, got, 64)
    assert used <= P.lower_bound(np.array([r["length"] for r in got]), 64) + 1


def test_rounds_exchange_between_partitions(spark):
    rng = random.Random(9)
    sizes = [rng.choice([30, 33, 34, 50, 16, 17, 18]) for _ in range(600)]
    pieces = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, length long")
    got = P.pack_pieces(pieces, capacity=100, target=40).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(600))
    fill = {}
    for r in got:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in fill.values():
        assert [o for o, _ in sorted(spans)] == [sum(x for _, x in sorted(spans)[:i]) for i in range(len(spans))]
        assert sum(x for _, x in spans) <= 100


def test_sequences_of_ids(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "word " * 90)], "doc_id long, text string")
    placed = P.pack_documents(docs, capacity=64)
    full = P.packed_ids(docs, placed, capacity=64).collect()
    assert sum(len(r["ids"]) for r in full) == 4 * sum(r["length"] for r in placed.collect())
    assert all(len(r["ids"]) <= 256 for r in full)


def test_empty_table(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
