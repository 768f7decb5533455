"""The pipeline's stages, each against its operator or brute force, on the small tables."""

import corpus_pipeline as P
from tests.llm.test_decontamination import brute as brute_leaks
from tests.llm.test_jaccard_join import brute as brute_components
from tests.llm.test_near_duplicate_stage import brute_kept
from tests.llm.test_packing import check_packing
from tidelink.llm import decontamination, jaccard_join, packing
from tidelink.llm.common import read_docs

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark):
    docs = read_docs(spark, SF)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept = {r["doc_id"] for r in out.collect()}
        given = {r["doc_id"] for r in docs.collect()}
        assert kept <= given
        if stage is P.near_duplicate_stage:
            assert kept == brute_kept(rows_of(docs))
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert P.ORACLE_SQL is None and 4 <= len(P.STAGES) <= 5


def test_near_duplicates_on_all_documents(spark):
    docs = read_docs(spark, SF)
    got = jaccard_join.jaccard_components(docs)
    assert sorted((r[0], r[1], r[2]) for r in got.select("doc_id", "n_shingles", "component_id").collect()
                  ) == brute_components(rows_of(docs))


def test_packing_of_all_documents(spark):
    docs = read_docs(spark, SF)
    check_packing(rows_of(docs), packing.pack_documents(docs).collect(), packing.CAPACITY)


def test_leaks_of_some_items(spark):
    docs = read_docs(spark, SF)
    bench = read_docs(spark, SF, "benchmark").filter("item_id < 2")
    short = docs.filter("length(text) < 1500")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontamination.find_leaks(short, bench).collect()}
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    assert got == brute_leaks(rows_of(short), items, decontamination.ERROR_RATE)


def test_run_on_edge_rows(spark, tmp_path):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c d e", None, None, None), (4, "x y z", "en", "s", 5),
            (4, "x y z", "en", "s", 5), (6, "w " * 3000, "en", "s", 6000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("documents", rows), ("empty", [])):
        sf = str(tmp_path / name)
        spark.createDataFrame(data, schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        out = P.run(spark, sf)
        assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
        assert out.count() == (0 if not data else len({1, 2, None, 4, 6}) + 1)
