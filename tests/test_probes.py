"""Engine probes the reference issues as plain statements (S9-S12, F8)."""

from pyspark.sql import functions as F


def test_constant_row(spark):
    assert [tuple(r) for r in spark.sql("SELECT 1 AS test").collect()] == [(1,)]


def test_version_and_current_user(spark):
    row = spark.sql("SELECT version() AS v, current_user() AS u").first()
    assert row.v and row.u


def test_table_existence(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/region.parquet").createOrReplaceTempView("region_probe")
    assert spark.catalog.tableExists("region_probe")
    assert not spark.catalog.tableExists("no_such_table_probe")


def test_request_ids_are_unique(spark):
    ids = spark.range(1000).select(F.expr("uuid()").alias("id"))
    assert ids.agg(F.count_distinct("id")).first()[0] == 1000
