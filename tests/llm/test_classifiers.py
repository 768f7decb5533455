"""Quality, toxicity and language models: held-out accuracy and edge cases."""

import numpy as np
import pytest

from tidelink.llm import language_id, quality, registry, toxicity
from tidelink.llm.common import in_fold, read_docs

SF = "/root/testdata/sf0.01"
EDGE = [(1, None, 1), (2, "", 2), (3, " \n", 3), (None, "no id", 4), (5, "same", 5), (5, "same", 6),
        (6, "word " * 30000, 7), (7, "日本語 🙂 ﬁ", 8)]
EDGE_SCHEMA = "doc_id long, text string, label int"


@pytest.fixture(scope="module")
def tables(spark):
    return read_docs(spark, SF), read_docs(spark, SF, "labels")


@pytest.fixture(scope="module")
def quality_model(tables):
    return quality.train(*tables)


@pytest.fixture(scope="module")
def toxicity_model(tables):
    return toxicity.train(*tables)


def held_out_accuracy(spark, scored, labels, label):
    both = scored.join(labels, "doc_id").filter("held_out").select(label, "predicted").collect()
    assert len(both) > 50
    return np.mean([r[label] == r["predicted"] for r in both])


def test_quality_held_out(spark, tables, quality_model):
    docs, labels = tables
    scored = quality.score(docs, quality_model).withColumn("held_out", in_fold("doc_id", 5, 0))
    assert held_out_accuracy(spark, scored, labels, "quality") >= 0.93
    kept = quality.quality_filter(docs, quality_model)
    good = {r[0] for r in quality.score(docs, quality_model).filter("predicted = 1").select("doc_id").collect()}
    assert kept.columns == docs.columns and {r[0] for r in kept.select("doc_id").collect()} == good


def test_toxicity_held_out(spark, tables, toxicity_model):
    docs, labels = tables
    scored = toxicity.score(docs, toxicity_model).withColumn("held_out", in_fold("doc_id", 5, 0))
    assert held_out_accuracy(spark, scored, labels, "toxic") >= 0.9
    rows = scored.collect()
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) == docs.count()
    clean = {r["doc_id"] for r in rows if r["predicted"] == 0}
    kept = toxicity.toxicity_filter(docs, toxicity_model)
    assert kept.columns == docs.columns and {r[0] for r in kept.select("doc_id").collect()} == clean


def test_edge_rows_are_scored(spark, quality_model, toxicity_model):
    edge = spark.createDataFrame(EDGE, EDGE_SCHEMA)
    for scored in (quality.score(edge, quality_model), toxicity.score(edge, toxicity_model)):
        rows = scored.collect()
        assert len(rows) == len(EDGE) and all(0 <= r["score"] <= 1 for r in rows)
        same = [r["score"] for r in rows if r["doc_id"] == 5]
        assert same[0] == same[1]
    assert quality.quality_filter(edge, quality_model).columns == edge.columns
    assert toxicity.toxicity_filter(edge, toxicity_model).columns == edge.columns


@pytest.mark.parametrize("module", [quality, toxicity])
def test_without_two_classes(spark, module):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(i, 1, 1) for i in range(1, 5)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in module.score(docs, module.train(docs, none)).collect()} == {0.5}
    assert all(r["score"] > 0.5 for r in module.score(docs, module.train(docs, one)).collect())
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert module.score(empty, module.train(empty, none)).collect() == []


def test_predictions_ignore_labels_of_held_out_rows(spark, tables, quality_model):
    docs, labels = tables
    from pyspark.sql import functions as F
    flipped = labels.withColumn("quality", F.when(in_fold("doc_id", 5, 0), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.train(docs, flipped)
    assert np.array_equal(again["weights"], quality_model["weights"])


def test_language_held_out(spark, tables):
    docs, _ = tables
    rows = registry.op4_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.98


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", 0), (2, "le chat et la souris", "fr", 0),
                                  (3, None, "en", 0), (4, "123 !!", "fr", 0), (None, "the", None, 0),
                                  (5, "w" * 500, None, 0), (6, "日本語", None, 0)],
                                 "doc_id long, text string, lang string, score int")
    from pyspark.sql import functions as F
    model = language_id.train(docs, F.lit(True))
    assert model.languages == ["en", "fr"]
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert got[1]["lang_pred"] == "en" and got[2]["lang_pred"] == "fr"
    assert (got[3]["lang_pred"], got[3]["score"]) == ("und", 0.0) and got[4]["lang_pred"] == "und"
    assert got[5]["lang_pred"] in ("en", "fr") and 0 <= got[5]["score"] <= 1
    untaught = language_id.train(docs.filter("doc_id is null"), F.lit(True))
    assert {r["lang_pred"] for r in language_id.predict(docs, untaught).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    vocabulary = language_id.Vocabulary(language_id.VOCABULARY)
    rng = np.random.default_rng(0)
    probs = rng.random((vocabulary.size + 1, 3)) * 1e-3

    def brute(text):
        if not text:
            return np.ones(3)
        total = np.zeros(3)
        for end in range(1, len(text) + 1):
            piece = vocabulary.number.get(text[:end], vocabulary.size if end == 1 else None)
            if piece is not None:
                total += probs[piece] * brute(text[end:])
        return total

    words = ["the", "chat", "zürich", "x", "øresund"]
    got = language_id.forward(words, vocabulary, probs)
    for w, logs in zip(words, got):
        assert np.allclose(np.exp(logs), brute(language_id.MARK + w), rtol=1e-9)
        assert np.allclose(language_id.forward_long(w, vocabulary, probs), logs)


def test_rare_long_words_do_not_underflow(spark):
    vocabulary = language_id.Vocabulary(language_id.VOCABULARY)
    probs = np.full((vocabulary.size + 1, 2), 1e-9)
    probs[:, 1] /= 2
    word = "qxzjvwkq" * 5
    logs = language_id.forward(["the", word], vocabulary, probs)
    assert np.isfinite(logs).all()
    assert np.allclose(logs[1], language_id.forward_long(word, vocabulary, probs))
    model = language_id.Model(["aa", "bb"], probs, language_id.VOCABULARY)
    docs = spark.createDataFrame([(1, word), (2, word * 30)], "doc_id long, text string")
    assert all(r["lang_pred"] == "aa" and 0.5 < r["score"] <= 1 for r in language_id.predict(docs, model).collect())


def test_long_words_are_learned_and_counts_equal_brute_force(monkeypatch):
    vocabulary = language_id.Vocabulary(language_id.VOCABULARY)
    counts = {"the": 5, "there": 2, "chat": 3, "zürich": 1}
    start = np.full(vocabulary.size + 1, 1.0 / (vocabulary.size + 1))

    def cuts(text):
        if not text:
            yield ()
        for end in range(1, len(text) + 1):
            piece = vocabulary.number.get(text[:end], vocabulary.size if end == 1 else None)
            if piece is not None:
                yield from ((piece, *rest) for rest in cuts(text[end:]))

    want = np.zeros(vocabulary.size + 1)
    for word, n in counts.items():
        ways = list(cuts(language_id.MARK + word))
        odds = np.array([np.prod(start[list(way)]) for way in ways])
        for way, share in zip(ways, odds / odds.sum()):
            np.add.at(want, list(way), n * share)
    assert np.allclose(language_id.em_counts(counts, vocabulary, rounds=1), want)
    usual = language_id.em_counts(counts, vocabulary)
    monkeypatch.setattr(language_id, "LONGEST", 3)  # the same words through logarithms
    assert np.allclose(language_id.em_counts(counts, vocabulary), usual)
    monkeypatch.undo()
    assert language_id.em_counts({"donaudampfschiff" * 9: 2}, vocabulary).sum() > 18
    assert language_id.em_counts({}, vocabulary).sum() == 0


def test_sample_takes_one_row_an_id_whatever_its_rows(spark):
    from pyspark.sql import functions as F
    rows = spark.range(40_000).select(F.when(F.col("id") < 30_000, 0).otherwise(F.col("id")).alias("doc"),
                                      F.lit("g").alias("lang"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    from tidelink.llm.common import bounded_sample
    got = bounded_sample(rows, "lang", 2_000, "doc").collect()
    assert 1_700 < len(got) < 2_300 and len({r["doc"] for r in got}) == len(got)
    again = bounded_sample(rows.repartition(7), "lang", 2_000, "doc").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert {r["text"] for r in got if r["doc"] == 0} <= {"t0"}


def test_toxicity_is_repeatable(spark, tables, toxicity_model):
    docs, labels = tables
    again = toxicity.train(docs.repartition(5), labels.repartition(3))
    scores = [sorted((r["doc_id"], r["score"]) for r in toxicity.score(docs, m).select("doc_id", "score").collect())
              for m in (toxicity_model, again)]
    assert scores[0] == scores[1]


def test_obfuscated_tokens_equal_a_plain_reading():
    def plain(text):
        out = []
        for token in text.split():
            sign = [i for i, c in enumerate(token) if c in "0123456789@$!*._-"]
            if (len(token) >= 3 and any(c.isalpha() for c in token)
                    and any(c.isalnum() for i in sign for c in token[i + 1:])):
                out.append(token)
        return out

    rng = np.random.default_rng(3)
    text = " ".join("".join(rng.choice(list("aB1!@_.é"), rng.integers(1, 8))) for _ in range(3000))
    assert toxicity.obfuscated(text) == plain(text) and plain(text)
    calm = "A long and calm text. " * 400
    features = dict(zip(toxicity.FEATURES, toxicity.Featurizer({"idiot": 3.0})(calm + "you 1d!ot")))
    assert features["obfuscated_hits"] > 0  # whatever the share of signs in the text
    import time
    start = time.time()
    toxicity.Featurizer({})("a" + "!" * 1_000_000)
    assert time.time() - start < 2
