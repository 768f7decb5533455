"""Language ID by segmentation-marginalised unigram models.

Every language has a probability for each piece of one fixed public
vocabulary.  A word (run of letters, lower-cased, opened by the vocabulary's
word mark) can be cut into pieces in many ways; its probability is the sum
over all segmentations, by the forward algorithm.  A text's log likelihood is
the sum over its words - pieces never cross white space - and the prediction
is the most likely language; the score is its posterior under equal priors.

Piece probabilities are learned by expectation maximisation (forward-backward
counts) from about ``SAMPLE_DOCS`` labelled documents of each language (the
sample bound), one task per language.  The model has at most one row for each
(language, piece).  Prediction is one pass over all whole texts without a
shuffle; a worker remembers word likelihoods up to a fixed size.

Defined results: a null text, or one without letters, gives ``und`` and score
0; rows with null language or null id teach nothing; without any labelled
rows everything is ``und``; ties go to the alphabetically first language; a
null ``doc_id`` is not held out; repeated rows are predicted each; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from tidelink.llm.common import bounded_sample

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
SAMPLE_DOCS = 400
EM_ROUNDS = 4
SMOOTH = 0.02            # pseudo-count of every piece in every language
UNKNOWN = 1e-7           # probability of a character that no piece holds
LONGEST = 40             # words up to here share vectorised steps; longer ones are summed in logarithms or rescaled
LEAST = 1e-250           # a word whose sum falls below goes that way too, before numbers underflow
REMEMBER_CELLS = 4_000_000
UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")
MARK = "▁"


class Vocabulary:
    """The lower-case pieces of a SentencePiece model, numbered; the last number is the unknown character."""

    def __init__(self, path: str):
        model = SentencePieceProcessor(model_file=path)
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size())
                  if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        self.number = {p: i for i, p in enumerate(sorted({p for p in pieces if p == p.lower()}))}
        self.size = len(self.number)
        self.longest = max(map(len, self.number), default=1)

    def lattice(self, words: list[str]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """All piece matches: (end, length) -> word numbers and piece numbers."""
        found: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
        get, unknown, longest = self.number.get, self.size, self.longest
        for w, word in enumerate(words):
            text = MARK + word
            n = len(text)
            for start in range(n):
                for end in range(start + 1, min(n, start + longest) + 1):
                    piece = get(text[start:end])
                    if piece is None:
                        if end > start + 1:
                            continue
                        piece = unknown
                    cell = found.get((end, end - start))
                    if cell is None:
                        cell = found[(end, end - start)] = ([], [])
                    cell[0].append(w)
                    cell[1].append(piece)
        return {k: (np.array(a), np.array(b)) for k, (a, b) in sorted(found.items())}


def forward(words: list[str], vocabulary: Vocabulary, probs: np.ndarray) -> np.ndarray:
    """log probability of each word under each language: (words, languages).

    ``probs`` is (pieces + 1, languages).  Words of up to LONGEST characters
    share the steps; a word with a sum below LEAST is summed again, rescaled.
    """
    size = max(map(len, words), default=0) + 2
    alpha = np.zeros((size, len(words), probs.shape[1]))
    alpha[0] = 1.0
    for (end, length), (w, piece) in vocabulary.lattice(words).items():
        alpha[end, w] += alpha[end - length, w] * probs[piece]
    lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
    total = alpha[lengths, np.arange(len(words))]
    out = np.log(np.maximum(total, LEAST))
    for i in np.flatnonzero((total < LEAST).any(axis=1)):
        out[i] = forward_long(words[i], vocabulary, probs)
    return out


def forward_long(word: str, vocabulary: Vocabulary, probs: np.ndarray) -> np.ndarray:
    """The same for one word of any length, rescaled at every character."""
    text = MARK + word
    span = vocabulary.longest
    ring = np.zeros((span + 1, probs.shape[1]))
    ring[0] = 1.0
    log_scale = np.zeros(probs.shape[1])
    for end in range(1, len(text) + 1):
        total = np.zeros(probs.shape[1])
        for length in range(1, min(span, end) + 1):
            piece = vocabulary.number.get(text[end - length:end])
            if piece is None and length == 1:
                piece = vocabulary.size
            if piece is not None:
                total += ring[(end - length) % (span + 1)] * probs[piece]
        ring[end % (span + 1)] = total
        ring /= total
        log_scale += np.log(total)
    return log_scale


def long_edges(word: str, vocabulary: Vocabulary) -> list[list[tuple[int, int]]]:
    """For every end in a word: (start, piece number) of the pieces that end there."""
    text, get = MARK + word, vocabulary.number.get
    out: list[list[tuple[int, int]]] = [[]]
    for end in range(1, len(text) + 1):
        found = [(start, get(text[start:end])) for start in range(max(0, end - vocabulary.longest), end)]
        out.append([(s, vocabulary.size if p is None else p) for s, p in found if p is not None or s == end - 1])
    return out


def add_long(edges: list[list[tuple[int, int]]], log_probs: np.ndarray, weight: float, expected: np.ndarray) -> None:
    """Add one word's expected piece counts, with forward and backward sums in logarithms."""
    n = len(edges)
    a, b = np.full(n, -np.inf), np.full(n, -np.inf)
    a[0] = b[n - 1] = 0.0
    for end in range(1, n):
        for start, piece in edges[end]:
            a[end] = np.logaddexp(a[end], a[start] + log_probs[piece])
    for end in range(n - 1, 0, -1):
        for start, piece in edges[end]:
            b[start] = np.logaddexp(b[start], b[end] + log_probs[piece])
    for end in range(1, n):
        for start, piece in edges[end]:
            expected[piece] += weight * np.exp(a[start] + log_probs[piece] + b[end] - a[n - 1])


def em_counts(counts: dict[str, int], vocabulary: Vocabulary, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Expected piece counts of one language's words after ``rounds`` of EM."""
    words = sorted(w for w in counts if len(w) <= LONGEST)
    slow = {w: long_edges(w, vocabulary) for w in sorted(counts) if len(w) > LONGEST}
    weight = np.array([counts[w] for w in words], dtype=np.float64)
    lattice = vocabulary.lattice(words)
    lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
    size = int(lengths.max(initial=0)) + 1
    probs = np.full(vocabulary.size + 1, 1.0 / (vocabulary.size + 1))
    expected = np.zeros(vocabulary.size + 1)
    for _ in range(rounds if counts else 0):
        alpha, beta = np.zeros((size, len(words))), np.zeros((size, len(words)))
        alpha[0] = 1.0
        beta[lengths, np.arange(len(words))] = 1.0
        for (end, length), (w, piece) in lattice.items():
            alpha[end, w] += alpha[end - length, w] * probs[piece]
        for (end, length), (w, piece) in sorted(lattice.items(), key=lambda x: -x[0][0]):
            beta[end - length, w] += beta[end, w] * probs[piece]
        total = alpha[lengths, np.arange(len(words))]
        for i in np.flatnonzero(total < LEAST):
            slow.setdefault(words[i], long_edges(words[i], vocabulary))
            weight[i] = 0.0
        use_of = weight / np.maximum(total, LEAST)
        expected = np.zeros(vocabulary.size + 1)
        for (end, length), (w, piece) in lattice.items():
            use = use_of[w] * alpha[end - length, w] * probs[piece] * beta[end, w]
            expected += np.bincount(piece, use, minlength=vocabulary.size + 1)
        log_probs = np.log(probs)
        for word, edges in slow.items():
            add_long(edges, log_probs, counts[word], expected)
        probs = np.maximum((expected + SMOOTH) / (expected.sum() + SMOOTH * len(expected)), 1e-12)
    return expected


class Model:
    """Languages and piece probabilities (pieces + 1, languages)."""

    def __init__(self, languages: list[str], probs: np.ndarray, path: str):
        self.languages, self.probs, self.path = languages, probs, path
        self.key = (path, tuple(languages), float(probs.sum()), probs.shape)


class Scorer(dict):
    """Word to row number of remembered log likelihoods, kept by a worker."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.vocabulary = model, Vocabulary(model.path)
        self.limit = max(20_000, REMEMBER_CELLS // max(1, len(model.languages)))
        self.table = np.empty((0, len(model.languages)))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Summed log likelihoods (texts, languages); NaN for texts without a letter."""
        if len(self) > self.limit:
            self.clear()
            self.table = self.table[:0]
        rows = [list(map(self.__getitem__, WORD.findall(t.lower()))) if t else [] for t in texts]
        if self.new:
            self.table = np.concatenate([self.table, self._likelihoods(self.new)])
            self.new = []
        out = np.full((len(texts), self.table.shape[1]), np.nan)
        for i, ids in enumerate(rows):
            if ids:
                out[i] = self.table[ids].sum(axis=0)
        return out

    def _likelihoods(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), self.table.shape[1]))
        short = sorted((i for i, w in enumerate(words) if len(w) <= LONGEST), key=lambda i: len(words[i]))
        for at in range(0, len(short), 5_000):
            part = short[at:at + 5_000]
            out[part] = forward([words[i] for i in part], self.vocabulary, self.model.probs)
        for i, w in enumerate(words):
            if len(w) > LONGEST:
                out[i] = forward_long(w, self.vocabulary, self.model.probs)
        return out


#: The scorer of the last model, kept by a Python worker from task to task.
_KEPT: dict[tuple, Scorer] = {}


def scorer_of(model: Model) -> Scorer:
    if model.key not in _KEPT:
        _KEPT.clear()
        _KEPT[model.key] = Scorer(model)
    return _KEPT[model.key]


def train(docs: DataFrame, taught: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_docs: int = SAMPLE_DOCS, vocabulary: str = VOCABULARY) -> Model:
    """Learn from the rows where ``taught`` holds and language and id are not null."""
    rows = (docs.filter(taught & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
            .select(F.col(id_col).alias("doc"), F.col(lang_col).cast("string").alias("lang"),
                    F.col(text_col).cast("string").alias("text")))
    sample = bounded_sample(rows, "lang", sample_docs, "doc").select("lang", "text")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:  # a bounded sample of one language
        counts: Counter[str] = Counter()
        for text in pdf["text"]:
            counts.update(WORD.findall((text or "").lower()))
        expected = em_counts(counts, Vocabulary(vocabulary))
        kept = np.flatnonzero(expected > 1e-6)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "piece": kept.astype(np.int32), "n": expected[kept]})

    found = sample.groupBy("lang").applyInPandas(fit, "lang string, piece int, n double").toPandas()
    languages = sorted(found["lang"].unique())
    size = Vocabulary(vocabulary).size + 1
    counts = np.zeros((size, len(languages)))
    for j, lang in enumerate(languages):
        own = found[found["lang"] == lang]
        counts[own["piece"].to_numpy(), j] = own["n"].to_numpy()
    probs = (counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * size)
    probs[-1] = UNKNOWN  # equal for all languages
    return Model(languages, probs, vocabulary)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs``, whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = scorer_of(shared.value)
        names = np.array([*scorer.model.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            if len(names) > 1:
                logs = scorer.score(texts)
                known = ~np.isnan(logs[:, 0])
                best[known] = logs[known].argmax(axis=1)
                rest = np.exp(logs[known] - logs[known].max(axis=1, keepdims=True))
                score[known] = 1.0 / rest.sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[best], pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
