"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidelink.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth int, path string"


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own[conv].append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, of in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(of) - 1) * (len(node[-1][1]) if node else 0)
            leaves[node[:d]] += not children[node]
    return sorted(((of[0], len(node), members[node[:-1]][0] if node else None, len(of), children[node], leaves[node], saved[node],
                    hashlib.sha256(",".join(str(c) for c in of if len(convs[c]) == len(node)).encode()).hexdigest())
                   for node, of in members.items()), key=str)


def found(spark, rows, shards):
    data = [(*r, 0, "clash") for r in rows]
    random.Random(3).shuffle(data)
    got = T.prefix_trie(spark.createDataFrame(data, SCHEMA).repartition(3), shards=shards)
    assert [f.simpleString() for f in got.schema][:2] == ["conv_id:bigint", "depth:bigint"]
    return sorted(map(tuple, got.collect()), key=str)


def fixture():
    rng = random.Random(5)
    rows = []
    for c in list(range(0, 420)) + [10 ** 12, 10 ** 12 + 7, -3, -250]:
        for t in range(rng.choice((1, 2, 3, 3, 9))):
            rows.append((c, t, rng.choice(("user", "bot")), rng.choice(("a", "é🙂", "long text", ""))))
    rows += [(700 + i, t, "user", "same") for i in range(150) for t in range(7)]      # one common conversation
    rows += [(900, t, "user", f"deep {t}") for t in range(60)]
    rows += [(901, None, None, None), (901, 5, None, "x"), (None, 1, "user", "no conversation"), (902, 0, "", "")]
    return rows


@pytest.mark.parametrize("shards,cells", [(1, 1 << 20), (7, 1 << 20), (5, 60), (3, 1)])
def test_trie_equals_dictionary(spark, monkeypatch, shards, cells):
    rows = fixture()
    nodes = T._shard_nodes

    def cut(batches):  # the limit travels with the function
        T.CELLS = cells
        return nodes(batches)

    monkeypatch.setattr(T, "_shard_nodes", cut)
    assert found(spark, rows, shards) == brute(rows)


def test_edges(spark):
    assert found(spark, [], 4) == [] and found(spark, [(None, 1, "a", "b")], 4) == []
    assert found(spark, [(5, None, None, None)], 2) == brute([(5, None, None, None)])
    twice = [(100, 1, "u", "t"), (100, 1, "u", "t"), (101, 1, "u", "t")]
    assert found(spark, twice, 2) == brute(twice)


def test_hot_sequence_spreads(spark):
    rows = [(i * 100, t, "user", "t") for i in range(3000) for t in range(2)]
    paths = T.turn_paths(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    sizes = [len(p) for p in paths.repartitionByRange(10, "path", "conv_id").rdd.glom().collect()]
    assert max(sizes) <= 2 * len(rows) / 2 / 10
    assert found(spark, rows, 10) == brute(rows)
