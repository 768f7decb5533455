"""Toxicity: gradient-boosted trees over dense features, isotonic calibration.

Each whole text becomes a short vector: how densely it holds words of a
weighted lexicon (a small fixed seed list, plus words and word beginnings
learned from labelled rows by their log odds), how close lexicon words stand
to second-person words, the shares of capitals and punctuation, and how often
a word only matches the lexicon after undoing look-alike spellings.  Spark
ML's boosted trees are fitted on these vectors; an isotonic regression fitted
on rows that the trees did not see turns their margins into scores.

Fitting uses at most about ``SAMPLE_ROWS`` labelled rows of each class.
Scoring is one pass over all whole texts; lexicon (at most ``LEXICON_SIZE``
entries) and model have fixed sizes, so nothing is shuffled.

Defined results: null and empty texts have the all-zero vector and its score;
a null ``doc_id`` is in no fold; repeated rows are scored each; with fewer
than two labelled classes the score is the smoothed share of label 1 (0.5
without labelled rows); extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelink.llm.common import bounded_sample, in_fold, in_parts, map_rows, materialise, one_row

SAMPLE_ROWS = 3_000
LEXICON_SIZE = 600
MIN_LOG_ODDS = 1.0
STEMS = (5, 6)
WINDOW = 5               # words between a lexicon word and a second-person word
TREES, DEPTH, STEP = 20, 3, 0.3

#: Plain insults that count as lexicon words before anything is learned.
SEED = ("idiot", "stupid", "moron", "loser", "trash", "scum", "pathetic", "worthless", "disgusting", "clown")
#: Second-person words of English, French, German and Spanish.
SECOND_PERSON = frozenset(("you", "your", "yours", "yourself", "tu", "toi", "vous", "ton", "ta", "tes", "votre",
                           "du", "dich", "dir", "dein", "deine", "ihr", "euch", "te", "ti", "tú", "usted",
                           "ustedes", "vosotros", "su"))
#: Look-alike characters and the letters they stand for.
LOOK_ALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
                            "!": "i", "*": None, ".": None, "-": None, "_": None})
WORD = re.compile(r"\w+")
SYMBOL, LETTER, ALNUM = re.compile(r"[0-9@$!*._\-]"), re.compile(r"[^\W\d_]"), re.compile(r"[^\W_]")
FEATURES = ("hit_rate", "strong_rate", "weight_rate", "max_weight", "distinct_hits", "log_hits", "log_strong",
            "near_second_person", "second_person_rate", "capital_share", "caps_word_share", "punct_share",
            "exclaim_rate", "digit_share", "obfuscated_rate", "obfuscated_hits", "log_words")
STRONG = 3.0


def word_keys(word: str) -> tuple[str, ...]:
    """Lexicon keys a word can match: itself, then its beginnings."""
    return (word, *(f"{word[:n]}~" for n in STEMS if len(word) > n))


def lexicon_weight(word: str, lexicon: dict[str, float]) -> float:
    return max((lexicon.get(k, 0.0) for k in word_keys(word)), default=0.0)


def obfuscated(text: str) -> list[str]:
    """Tokens of at least 3 characters that hold a letter, and a digit or sign before another letter or digit."""
    out = []
    for token in text.split():
        if len(token) >= 3 and not token.isalpha():
            at = SYMBOL.search(token)
            if at and LETTER.search(token) and ALNUM.search(token, at.end()):
                out.append(token)
    return out


class Featurizer:
    """Text to feature vector; remembers word weights up to a fixed count."""

    REMEMBER = 200_000

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.weights: dict[str, float] = {}

    def weight(self, word: str) -> float:
        found = self.weights.get(word)
        if found is None:
            if len(self.weights) >= self.REMEMBER:
                self.weights.clear()
            found = self.weights[word] = lexicon_weight(word, self.lexicon)
        return found

    def __call__(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * len(FEATURES)
        words = WORD.findall(text)
        lower = [w.lower() for w in words]
        n, chars = max(1, len(words)), len(text)
        known = self.weights
        weights = [known[w] if w in known else self.weight(w) for w in lower]
        hits = [i for i, w in enumerate(weights) if w]
        strong = sum(weights[i] >= STRONG for i in hits)
        second = [i for i, w in enumerate(lower) if w in SECOND_PERSON]
        near = 0
        if hits and second:
            at = np.array(second)
            k = np.searchsorted(at, hits)
            gap = np.minimum(np.abs(at[np.minimum(k, len(at) - 1)] - hits), np.abs(at[np.maximum(k - 1, 0)] - hits))
            near = int((gap <= WINDOW).sum())
        raw = text.encode("utf-8", "replace")
        counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
        capitals, digits = int(counts[65:91].sum()), int(counts[48:58].sum())
        punct = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
        hidden = obfuscated(text)
        hidden_hits = sum(self.weight(w.lower().translate(LOOK_ALIKE)) > 0 for w in hidden)
        return [len(hits) / n, strong / n, sum(weights) / n, max(weights, default=0.0),
                float(len({lower[i] for i in hits})), math.log1p(len(hits)), math.log1p(strong),
                near / n, len(second) / n, capitals / chars, sum(map(str.isupper, words)) / n, punct / chars,
                int(counts[33]) / n, digits / chars, len(hidden) / n, hidden_hits / n, math.log(n)]


def learn_lexicon(sample: DataFrame, size: int = LEXICON_SIZE) -> dict[str, float]:
    """Words and beginnings that label 1 holds far more often, with their log odds.

    ``sample`` (text, label) is bounded; its document frequencies are counted
    by Spark and only the ``size`` best entries reach the driver.
    """

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, labels = [], []
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = set(chain.from_iterable(map(word_keys, set(w.lower() for w in WORD.findall(text or "")))))
            found += own
            labels += [label] * len(own)
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(labels, pa.int32())],
                                          names=["key", "label"])

    size_of = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = size_of.get(1, 0), size_of.get(0, 0)
    counted = (map_rows(sample.select("text", "label"), keys, "key string, label int").groupBy("key")
               .agg(F.sum("label").alias("in1"), F.count(F.lit(1)).alias("in_all")))
    p1 = (F.col("in1") + 0.5) / F.lit(n1 + 1.0)
    p0 = (F.col("in_all") - F.col("in1") + 0.5) / F.lit(n0 + 1.0)
    odds = F.log(p1 / (1 - p1)) - F.log(p0 / (1 - p0))
    spread = F.sqrt(1 / (F.col("in1") + 0.5) + 1 / (F.col("in_all") - F.col("in1") + 0.5))
    best = (counted.filter(F.col("in1") >= 3).select("key", odds.alias("odds"), (odds / spread).alias("z"))
            .filter((F.col("odds") >= MIN_LOG_ODDS) & (F.col("z") >= 2.5))
            .orderBy(F.desc("z"), "key").limit(size))
    learned = {r["key"]: float(r["odds"]) for r in best.collect()}
    return {**{w: STRONG for w in SEED}, **learned}


def featurize(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """Replace ``text`` (first column) by ``features``; other columns stay."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)
    rest = [f for f in rows.schema.fields if f.name != "text"]
    schema = "features array<double>" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rest)

    def run(batches):
        feature = Featurizer(shared.value)
        for batch in in_parts(batches):
            values = [feature(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), *batch.columns[1:]],
                                             names=["features", *(f.name for f in rest)])

    return rows.select("text", *(f"`{f.name}`" for f in rest)).mapInArrow(run, schema)


class Model:
    """Lexicon, boosted trees and calibration; or a constant score."""

    def __init__(self, lexicon, trees=None, curve=None, constant: float = 0.5):
        self.lexicon, self.trees, self.curve, self.constant = lexicon, trees, curve, constant

    def score_features(self, featured: DataFrame) -> DataFrame:
        """Add ``score``; drops ``features``."""
        if self.trees is None:
            return featured.withColumn("score", F.lit(float(self.constant))).drop("features")
        ranked = _margin(self.trees.transform(featured.withColumn("_x", array_to_vector("features"))))
        scored = self.curve.transform(ranked)
        keep = [c for c in featured.columns if c != "features"]
        score: Column = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
        return scored.select(*(f"`{c}`" for c in keep), score.alias("score"))


def _margin(scored: DataFrame) -> DataFrame:
    return scored.withColumn("_margin", vector_to_array("rawPrediction")[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", *, id_col: str = "doc_id",
          text_col: str = "text", sample_rows: int = SAMPLE_ROWS, folds: int = 5, held_out: int = 0) -> Model:
    """Fit on a bounded sample of the labelled rows outside the held-out fold.

    The sample is split by id hash: two fifths learn the lexicon and the
    trees' splits are fitted on two other fifths, so that the trees see
    honest lexicon features; the last fifth fits the calibration.
    """
    known = (labels.select(F.col(id_col).alias("doc"), F.col(label).cast("int").alias("label"))
             .filter(F.col("label").isin(0, 1) & F.col("doc").isNotNull() & ~in_fold("doc", folds, held_out))
             .groupBy("doc").agg(F.max("label").alias("label")))
    # About 2 * sample_rows rows, whatever the input: small enough to send to every task.
    chosen = F.broadcast(bounded_sample(known, "label", sample_rows, "doc"))
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    sample = materialise(one_row(texts.join(chosen, "doc"), "doc")
                         .withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc"), F.lit(5)).cast("int"))
                         .select("text", "label", "part", "doc"), "toxicity-sample")
    shares = {(r["part"] < 2, r["part"] < 4, r["label"]): r["n"] for r in sample
              .groupBy(F.when(F.col("part") < 2, 0).when(F.col("part") < 4, 2).otherwise(4).alias("part"), "label")
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    n1 = sum(n for (_, _, y), n in shares.items() if y == 1)
    total = sum(shares.values())
    if n1 in (0, total):
        return Model({w: STRONG for w in SEED}, constant=(n1 + 1) / (total + 2) if total else 0.5)
    split = len(shares) == 6 and min(shares.values()) >= 10
    lexicon = learn_lexicon(sample.filter("part < 2") if split else sample)
    # A few thousand vectors in one partition and one order: sums of floats, and so two runs' trees, are equal.
    featured = materialise(featurize(sample, lexicon).repartition(1).sortWithinPartitions("doc"),
                           "toxicity-features").coalesce(1).withColumn("_x", array_to_vector("features"))
    weight = F.when(F.col("label") == 1, F.lit(0.5 * total / n1)).otherwise(F.lit(0.5 * total / (total - n1)))
    featured = featured.withColumn("label", F.col("label").cast("double")).withColumn("_w", weight)
    grower = GBTClassifier(featuresCol="_x", labelCol="label", weightCol="_w", maxIter=TREES,
                           maxDepth=DEPTH, stepSize=STEP, seed=11, minInstancesPerNode=5)
    trees = grower.fit(featured.filter("part in (2, 3)") if split else featured)
    ranked = _margin(trees.transform(featured.filter("part = 4") if split else featured))
    curve = IsotonicRegression(featuresCol="_margin", labelCol="label", predictionCol="score").fit(
        ranked.select("_margin", "label"))
    return Model(lexicon, trees, curve)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.5) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs``, whole texts."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("doc_id"))
    scored = model.score_features(featurize(rows, model.lexicon))
    return scored.withColumn("predicted", (F.col("score") >= F.lit(threshold)).cast("int"))


def toxicity_filter(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, all columns kept.

    A model that saw fewer than two classes tells nothing apart and rejects no row.
    """
    if model.trees is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model.lexicon)
    held: list[Featurizer] = []

    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Featurizer(shared.value))
        return pa.array([held[0](t.as_py()) for t in texts], pa.list_(pa.float64()))

    featured = docs.select(F.struct("*").alias("_row"), features(F.col("text").cast("string")).alias("features"))
    kept = model.score_features(featured).filter(F.col("score") < F.lit(threshold))
    return kept.select("_row.*")
