"""SimHash near duplicates against all pairs."""

import random
import re

import xxhash

from tidelink.llm import simhash as S
from tidelink.llm.common import read_docs

SF = "/root/testdata/sf0.001"


def plain(text, n=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=2):
    fps = [plain(text) for _, text in rows]
    kinds = sorted(set(fps))
    root = {f: f for f in kinds}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for (doc, _), f in zip(rows, fps):
        ids = [x for x in (doc, least.get(find(f))) if x is not None]
        least[find(f)] = min(ids) if ids else None
    return sorted(((doc, f"{f:016x}", least[find(f)]) for (doc, _), f in zip(rows, fps)), key=str)


def fixture():
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 60)))) for i in range(120)]
    base = [f"b{i}" for i in range(3000)]
    for i in range(200, 260):
        copy = list(base)
        for _ in range(rng.randrange(0, 8)):
            copy[rng.randrange(3000)] = "x"
        rows.append((i, " ".join(copy)))
    rows += [(300, None), (301, ""), (302, " \t\r\n\x0b\x0c"), (303, "ONE two"), (304, "one  TWO"), (305, "É x \x1c y"),
             (306, "a b c"), (None, "a B c"), (None, "alone here it stands"), (307, "same"), (307, "same")]
    return rows


def got(spark, rows, parts=4):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, variant string")
    return sorted(map(tuple, S.near_duplicates(frame.repartition(parts)).collect()), key=str)


def test_equals_all_pairs(spark):
    rows = fixture()
    want = brute(rows)
    assert got(spark, rows) == want
    groups = {}
    for _, f, c in want:
        groups.setdefault(c, set()).add(f)
    assert max(map(len, groups.values())) > 3  # near copies, not only equal ones
    assert got(spark, []) == []


def test_given_documents(spark):
    docs = read_docs(spark, SF)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, S.near_duplicates(docs).collect()), key=str) == brute(rows)


def test_links_join_balls(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    fps = {centre} | {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)} | {0, 1, 3, 7, (1 << 64) - 1}
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for radius in (0, 2):
        links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in S.near_links(frame, radius).collect()]
        assert all((a ^ b).bit_count() <= radius for a, b in links)
        group = {f: f for f in fps}

        def find(f):
            while group[f] != f:
                f = group[f]
            return f

        for a, b in links:
            group[find(a)] = find(b)
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= radius:
                    assert find(a) == find(b)


def test_long_text_in_parts(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000)).encode()
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "PART", 7)
    assert S.fingerprint(text) == whole == plain(text.decode())
