"""Features, ratios, solver and calibration of the quality and toxicity models against plain versions."""

import math
import random
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tidelink.llm import quality, toxicity
from tidelink.llm.common import in_fold, read_docs

SF = "/root/testdata/sf0.01"


def sample_texts(seed, n=40):
    rng = random.Random(seed)
    words = ["You", "idiot", "stup1d", "the", "tide", "you", "M0R0N", "é", "harbour", "st*pid!", "IS", "a", "12", "日本", "l@mp."]
    return ["", " ", "\n\n", "x", "aa aa aa"] + [" ".join(rng.choice(words) + rng.choice(["", ",", "!", "\n"])
                                                 for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def plain_indicators(text):
    out = set()
    for n in range(1, 5):
        for i in range(len(text) - n + 1):
            code = int.from_bytes(text[i:i + n], "big")
            out.add((((code ^ (n * 0x1F35)) * 2654435761) % 2**32) >> (32 - quality.BITS))
    if not text:
        return []
    for k, items in enumerate((text.split(), text.split(b"\n"))):
        same = sum(a == b for a, b in zip(items, items[1:])) / max(1, len(items) - 1)
        for j, share in enumerate((same, len(set(items)) / max(1, len(items)))):
            level = sum(share >= edge for edge in quality.LEVELS)
            out.add((1 << quality.BITS) + (2 * k + j) * quality.N_LEVELS + level)
    return sorted(out)


def test_indicators_and_ratios_equal_plain_counts():
    texts = [t.encode() for t in sample_texts(1)]
    rows = [quality.indicators(t) for t in texts]
    assert [r.tolist() for r in rows] == [plain_indicators(t) for t in texts]
    y = np.array([1.0 if i % 3 else -1.0 for i in range(len(rows))])
    counts = {side: Counter(f for r, label in zip(rows, y) if label == side for f in r.tolist()) for side in (1.0, -1.0)}
    total = {side: sum(c.values()) + quality.SMOOTH * quality.N_FEATURES for side, c in counts.items()}
    ratio = quality.log_count_ratios(rows, y)
    for f in [0, 17, *sorted(set(np.concatenate(rows).tolist()))[:300]]:
        want = (math.log((counts[1.0][f] + quality.SMOOTH) / total[1.0])
                - math.log((counts[-1.0][f] + quality.SMOOTH) / total[-1.0]))
        assert ratio[f] == pytest.approx(want, abs=1e-9)


def test_dual_descent_equals_projected_gradient():
    texts = [t.encode() for t in sample_texts(2, 50)]
    rng = np.random.default_rng(3)
    rows = [quality.indicators(t) for t in texts]
    y = np.where(rng.random(len(rows)) < 0.4, 1.0, -1.0)
    values = quality._scale(rows, quality.log_count_ratios(rows, y))
    cost = np.where(y > 0, 1.2, 0.7)
    dense = np.zeros((len(rows), quality.N_FEATURES), dtype=np.float64)
    for i, (x, v) in enumerate(zip(rows, values)):
        dense[i, x] = v
    gram = (dense @ dense.T + 1.0) * np.outer(y, y)
    alpha, step = np.zeros(len(rows)), 1.0 / np.linalg.eigvalsh(gram).max()
    for _ in range(20_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1.0), 0.0, cost)
    want_w, want_b = (alpha * y) @ dense, float(alpha @ y)
    w, b = quality.dual_descent(rows, values, y, cost, epochs=5_000)

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + cost @ np.maximum(0.0, 1.0 - y * (dense @ w + b))

    assert loss(w, b) == pytest.approx(loss(want_w, want_b), rel=2e-3)
    assert np.abs(dense @ w + b - dense @ want_w - want_b).max() < 0.05


def plain_features(text, lexicon):
    """One feature after the other, by loops over words and characters."""
    if not text:
        return [0.0] * len(toxicity.FEATURES)
    words = toxicity.WORD.findall(text)
    lower = [w.lower() for w in words]
    n = max(1, len(words))
    weights = [max([0.0, *(lexicon[k] for k in toxicity.word_keys(w) if k in lexicon)]) for w in lower]
    hits = [i for i, w in enumerate(weights) if w > 0]
    strong = [i for i in hits if weights[i] >= toxicity.STRONG]
    second = [i for i, w in enumerate(lower) if w in toxicity.SECOND_PERSON]
    near = [i for i in hits if any(abs(i - j) <= toxicity.WINDOW for j in second)]

    def is_hidden(token):
        signs = [i for i, c in enumerate(token) if c in "0123456789@$!*._-"]
        return (len(token) >= 3 and any(c.isalpha() for c in token) and bool(signs)
                and any(c.isalnum() for c in token[signs[0] + 1:]))

    hidden = [t for t in text.split() if is_hidden(t)]
    plain = [t.lower().translate(toxicity.LOOK_ALIKE) for t in hidden]
    return [len(hits) / n, len(strong) / n, sum(weights) / n, max(weights, default=0.0), len({lower[i] for i in hits}),
            math.log(1 + len(hits)), math.log(1 + len(strong)), len(near) / n, len(second) / n,
            sum(c in string.ascii_uppercase for c in text) / len(text), sum(w.isupper() for w in words) / n,
            sum(c in string.punctuation for c in text) / len(text), text.count("!") / n,
            sum(c in string.digits for c in text) / len(text), len(hidden) / n,
            sum(any(k in lexicon for k in toxicity.word_keys(w)) for w in plain) / n, math.log(n)]


def test_toxicity_features_equal_plain_version():
    lexicon = {**{w: toxicity.STRONG for w in toxicity.SEED}, "harbo~": 1.5, "tide": 2.0, "tides": 2.5}
    feature = toxicity.Featurizer(lexicon)
    for text in [None, *sample_texts(4, 120)]:
        assert feature(text) == pytest.approx(plain_features(text, lexicon), abs=1e-12)


def pool_adjacent(margin, label):
    """Isotonic fit at every margin; equal margins are one point."""
    points = [(m, label[margin == m].mean(), int((margin == m).sum())) for m in np.unique(margin)]
    pools = []
    for m, mean, weight in points:
        pools.append([[m], mean, weight])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            last = pools.pop()
            before = pools[-1]
            both = before[2] + last[2]
            before[1] = (before[1] * before[2] + last[1] * last[2]) / both
            before[0], before[2] = before[0] + last[0], both
    return {m: mean for ms, mean, _ in pools for m in ms}


def test_calibration_equals_pool_adjacent_violators(spark):
    docs, labels = read_docs(spark, SF), read_docs(spark, SF, "labels")
    model = toxicity.train(docs, labels)
    # Fewer rows than the sample's bound: all labelled rows outside the held-out fold take part.
    rows = (docs.select("doc_id", "text").join(labels.select("doc_id", F.col("toxic").cast("int").alias("label")), "doc_id")
            .filter(F.col("label").isin(0, 1) & ~in_fold("doc_id", 5, 0))
            .withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(5)))).cache()
    by_part = Counter((min(r["part"] // 2, 2), r["label"]) for r in rows.select("part", "label").collect())
    split = len(by_part) == 6 and min(by_part.values()) >= 10
    fitted = rows.filter("part = 4") if split else rows
    featured = toxicity.featurize(fitted.select("text", "doc_id", "label"), model.lexicon)
    ranked = model.trees.transform(featured.withColumn("_x", array_to_vector("features"))).select(
        "doc_id", "label", vector_to_array("rawPrediction")[1].alias("margin")).toPandas()
    want = pool_adjacent(ranked["margin"].to_numpy(), ranked["label"].to_numpy(dtype=float))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(fitted, model).collect()}
    assert len(got) >= 20 and set(ranked["label"]) == {0, 1}
    for doc, margin in zip(ranked["doc_id"], ranked["margin"]):
        assert got[doc] == pytest.approx(want[margin], abs=1e-9)
