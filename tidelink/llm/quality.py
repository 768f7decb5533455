"""Quality classifier: naive-Bayes support vectors over n-gram indicators.

A text is turned into the set of its byte 1- to 4-grams (hashed to
``2**BITS`` buckets) plus a few indicators for repeated word and line
bigrams.  Indicators are scaled by the log ratio of their smoothed class
frequencies and a linear hinge-loss model is fitted on the scaled, length-
normalised vectors by dual coordinate descent; margins become scores through
a logistic curve fitted on rows the descent did not see.

Fitting uses at most about ``SAMPLE_ROWS`` labelled rows of each class (the
sample bound), in one task; scoring is one pass over all whole texts with a
model of fixed size (``2**BITS`` floats), so it needs no shuffle.

Defined results: null and empty texts have no n-gram and get the score of the
model's bias; a null ``doc_id`` is in no fold and is never held out; repeated
rows are scored each; if the labelled rows hold fewer than two classes, the
score is their smoothed share of the positive class (0.5 without any); extra
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelink.llm.common import bounded_sample, in_fold, map_rows, one_row, text_bytes

BITS = 18
MAX_GRAM = 4
SAMPLE_ROWS = 3_000
EPOCHS = 12
PENALTY = 1.0          # C of the hinge loss
BLEND = 0.25           # share of the mean weight magnitude kept in every weight
SMOOTH = 1.0           # added to every class count of an indicator
#: Upper edges of the levels into which repetition shares are cut.
LEVELS = np.array([0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.01])
N_LEVELS = len(LEVELS) + 1
N_FEATURES = (1 << BITS) + 4 * N_LEVELS


def indicators(text: bytes) -> np.ndarray:
    """Sorted distinct feature numbers of one text."""
    if not text:
        return np.empty(0, dtype=np.int32)
    seen = np.zeros(N_FEATURES, dtype=bool)
    raw = np.frombuffer(text, dtype=np.uint8)
    code = np.zeros(len(raw), dtype=np.uint32)
    for n in range(1, MAX_GRAM + 1):
        if len(raw) < n:
            break
        code = (code[: len(raw) - n + 1] << np.uint32(8)) | raw[n - 1:]
        seen[((code ^ np.uint32(n * 0x1F35)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)] = True
    words, lines = text.split(), text.split(b"\n")
    base = 1 << BITS
    for k, items in enumerate((words, lines)):
        n = len(items)
        same_next = sum(map(bytes.__eq__, items, items[1:])) / max(1, n - 1)
        for j, share in enumerate((same_next, len(set(items)) / max(1, n))):
            seen[base + (2 * k + j) * N_LEVELS + int(np.searchsorted(LEVELS, share, side="right"))] = True
    return np.flatnonzero(seen).astype(np.int32)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    pos, neg = np.full(N_FEATURES, SMOOTH), np.full(N_FEATURES, SMOOTH)
    for x, label in zip(rows, y):
        (pos if label > 0 else neg)[x] += 1
    return np.log(pos / pos.sum()) - np.log(neg / neg.sum())


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray,
                 epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss by dual coordinate descent; returns weights, bias."""
    w, bias = np.zeros(N_FEATURES), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            grad = y[i] * (w[x] @ v + bias) - 1.0
            new = min(max(alpha[i] - grad / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                largest = max(largest, abs(step))
                alpha[i] = new
                w[x] += step * v
                bias += step
        if largest < 1e-3:
            break
    return w, bias


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(1 | margin), by Newton steps with softened targets."""
    n_pos, n_neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2))
    theta = np.array([1.0, 0.0])
    design = np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        grad = design.T @ (p - target) + 1e-3 * theta
        hess = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def _scale(rows: list[np.ndarray], ratio: np.ndarray) -> list[np.ndarray]:
    values = [ratio[x] for x in rows]
    return [v / max(1e-12, float(np.sqrt(v @ v))) for v in values]


def fit_rows(texts: list[bytes], labels: np.ndarray, tune: np.ndarray) -> dict:
    """Model from texts and 0/1 labels; rows marked in ``tune`` fit the score curve only."""
    n_pos, n = int(labels.sum()), len(labels)
    if n_pos in (0, n):
        return {"constant": (n_pos + 1) / (n + 2)}
    y = np.where(labels > 0, 1.0, -1.0)
    if len(set(y[tune])) < 2 or len(set(y[~tune])) < 2:  # too few rows to set some aside
        tune = np.zeros(n, dtype=bool)
    rows = [indicators(t) for t in texts]
    fit = np.flatnonzero(~tune)
    ratio = log_count_ratios([rows[i] for i in fit], y[fit])
    values = _scale(rows, ratio)
    share = (y[fit] > 0).mean()
    cost = PENALTY * np.where(y[fit] > 0, 0.5 / share, 0.5 / (1 - share))
    w, bias = dual_descent([rows[i] for i in fit], [values[i] for i in fit], y[fit], cost)
    w = BLEND * np.abs(w).mean() + (1 - BLEND) * w
    check = np.flatnonzero(tune) if tune.any() else fit
    margin = np.array([w[rows[i]] @ values[i] + bias for i in check])
    slope, offset = logistic_curve(margin, y[check])
    return {"weights": (w * ratio).astype(np.float32), "ratio": ratio.astype(np.float32),
            "bias": bias, "slope": slope, "offset": offset}


def score_text(model: dict, text: bytes) -> float:
    if "constant" in model:
        return model["constant"]
    x = indicators(text)
    r = model["ratio"][x].astype(np.float64)
    norm = max(1e-12, float(np.sqrt(r @ r)))
    margin = float(model["weights"][x].sum(dtype=np.float64)) / norm + model["bias"]
    return float(1 / (1 + np.exp(-np.clip(model["slope"] * margin + model["offset"], -30, 30))))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", *, id_col: str = "doc_id",
          text_col: str = "text", sample_rows: int = SAMPLE_ROWS, folds: int = 5, held_out: int = 0) -> dict:
    """Fit on a bounded sample of the labelled rows outside the held-out fold.

    The model (a dict of fixed size) is the only thing that reaches the driver.
    """
    known = (labels.select(F.col(id_col).alias("doc"), F.col(label).cast("int").alias("label"))
             .filter(F.col("label").isin(0, 1) & F.col("doc").isNotNull() & ~in_fold("doc", folds, held_out))
             .groupBy("doc").agg(F.max("label").alias("label")))
    # About 2 * sample_rows rows, whatever the input: small enough to send to every task.
    chosen = F.broadcast(bounded_sample(known, "label", sample_rows, "doc"))
    texts = docs.select(F.col(id_col).alias("doc"), text_bytes(text_col).alias("text"))
    rows = (one_row(texts.join(chosen, "doc"), "doc")
            .withColumn("tune", F.pmod(F.xxhash64(F.lit("tune"), "doc"), F.lit(5)) == 0)
            .select("doc", "text", "label", "tune"))

    def fit(frames):
        parts = list(frames)  # one task's share of a bounded sample
        pdf = pd.concat(parts) if parts else pd.DataFrame({"doc": [], "text": [], "label": [], "tune": []})
        pdf = pdf.sort_values(["doc", "text"], kind="stable")
        model = fit_rows([bytes(t) for t in pdf["text"]], pdf["label"].to_numpy(dtype=int),
                         pdf["tune"].to_numpy(dtype=bool))
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    found = rows.repartition(1).mapInPandas(fit, "model binary").first()
    return pickle.loads(found[0]) if found else {"constant": 0.5}


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs``, whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        scores = [score_text(shared.value, t) for t in rows.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(scores, pa.float64())],
                                          names=["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = map_rows(docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text")),
                      batch, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= F.lit(threshold)).cast("int"))


def quality_filter(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, all columns kept.

    A model that saw fewer than two classes tells nothing apart and rejects no row.
    """
    if "constant" in model:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def quality(texts: pa.Array) -> pa.Array:
        return pa.array([score_text(shared.value, t.as_py()) for t in texts], pa.float64())

    return docs.filter(quality(text_bytes("text")) >= F.lit(threshold))
