"""Seed workload: repeatable keyed inserts, SERIAL keys, defaults, the view,
constraint report (golden values from the reference's seed script)."""

from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from tests.seed import ORDERS, USERS, order_batch, user_batch
from tidelink.operators import keyed, relational
from tidelink.session import shared_dir

RUN_TS = datetime(2025, 1, 1)


def _seed_run(spark, users_path, orders_path):
    """One run of the seed script against lake tables; returns rows added."""
    users = spark.read.schema(USERS).parquet(users_path)
    new_users = keyed.insert_ignore(users, user_batch(spark).drop("id").withColumn(
        "pos", F.monotonically_increasing_id()), ["email"], "pos").drop("pos")
    new_users = keyed.surrogate_keys(users, new_users, "id", ["email"], out="id")
    new_users = keyed.apply_defaults(new_users, {"created_at": F.lit(RUN_TS).cast("timestamp_ntz")})
    n_users = new_users.count()
    keyed.append_rows(new_users.select(*[F.col(f.name).cast(f.dataType) for f in USERS]), users_path)

    orders = spark.read.schema(ORDERS).parquet(orders_path)
    new_orders = keyed.insert_where_not_exists(orders, order_batch(spark).drop("id"),
                                               ["user_id", "product_name"])
    new_orders = keyed.surrogate_keys(orders, new_orders, "id", ["user_id", "product_name"], out="id")
    new_orders = keyed.apply_defaults(new_orders, {"order_date": F.lit(RUN_TS).cast("timestamp_ntz")})
    n_orders = new_orders.count()
    keyed.append_rows(new_orders.select(*[F.col(f.name).cast(f.dataType) for f in ORDERS]), orders_path)
    return n_users, n_orders


def _empty(spark, schema, path):
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def test_seed_is_repeatable_and_matches_golden(spark):
    base = shared_dir(spark, "test_seed")
    up, op = f"{base}/users", f"{base}/orders"
    _empty(spark, USERS, up)
    _empty(spark, ORDERS, op)
    assert _seed_run(spark, up, op) == (10, 12)
    assert _seed_run(spark, up, op) == (0, 0)
    users = spark.read.parquet(up)
    orders = spark.read.parquet(op)
    assert sorted(r.id for r in users.collect()) == list(range(1, 11))
    assert sorted(r.id for r in orders.collect()) == list(range(1, 13))
    assert orders.agg(F.sum("total_amount")).first()[0] == Decimal("2861.88")
    per_user = {r.user_id: r.t for r in orders.groupBy("user_id").agg(F.sum("total_amount").alias("t")).collect()}
    golden = ["1349.97", "399.00", "109.96", "349.00", "159.99", "89.99", "199.00", "129.99", "49.99", "24.99"]
    assert [per_user[i] for i in range(1, 11)] == [Decimal(g) for g in golden]
    assert users.filter(F.col("created_at").isNull()).count() == 0


def _as_tpch(users, orders):
    u = users.select(F.col("id").alias("c_custkey"), F.col("name").alias("c_name"))
    o = orders.select(F.col("id").alias("o_orderkey"), F.col("user_id").alias("o_custkey"),
                      F.lit("O").alias("o_orderstatus"), F.col("total_amount").cast("double").alias("o_totalprice"),
                      F.col("order_date").alias("o_orderdate"))
    return u, o


def test_user_orders_view_order_and_null_extension(spark):
    users = user_batch(spark).unionByName(spark.createDataFrame([(11, "No Orders", "x@y", None)], USERS))
    orders = order_batch(spark).withColumn("id", F.hash("product_name"))
    orders = orders.withColumn("order_date", F.when(F.col("product_name") == "Wireless Mouse",
                                                    F.lit(None)).otherwise(F.lit(RUN_TS).cast("timestamp_ntz")))
    u, o = _as_tpch(users, orders)
    rows = relational.user_orders(u, o).collect()
    assert len(rows) == 13
    assert [r.user_id for r in rows] == sorted(r.user_id for r in rows)
    first_user = [r for r in rows if r.user_id == 1]
    assert first_user[0].order_date is None  # NULLs first on DESC, as PostgreSQL
    assert rows[-1].user_id == 11 and rows[-1].order_id is None


def test_order_listing_is_top_five_by_id(spark, sf_dir):
    from tidelink.tables import read_table
    rows = relational.order_listing(read_table(spark, sf_dir, "orders"),
                                    read_table(spark, sf_dir, "customer")).collect()
    assert [r.order_id for r in rows] == sorted(r.order_id for r in rows)
    assert len(rows) == 5


def test_first_wins_inside_batch_and_constraints(spark):
    target = spark.createDataFrame([], USERS)
    batch = spark.createDataFrame([(1, "A", "dup@x", None), (2, "B", "dup@x", None), (3, "C", "c@x", None)], USERS)
    added = keyed.insert_ignore(target, batch, ["email"], "id").collect()
    assert sorted((r.email, r.id) for r in added) == [("c@x", 3), ("dup@x", 1)]

    users = user_batch(spark)
    orders = spark.createDataFrame([(1, None, "p", 1, Decimal("1.00"), None),
                                    (2, 99, "q", 1, Decimal("2.00"), None),
                                    (3, 1, "r", 1, Decimal("3.00"), None)], ORDERS)
    report = {r.rule: r.violations for r in keyed.constraint_report([
        keyed.rule_foreign_key("fk", orders, "user_id", users, "id"),
        keyed.rule_unique("unique email", batch, ["email"]),
        keyed.rule_not_null("nn", orders, "user_id"),
        keyed.rule_max_length("len", users, "name", 10),
    ]).collect()}
    assert report == {"fk": 1, "unique email": 1, "nn": 1, "len": 7}  # 7 names exceed 10 chars


def test_dense_index_matches_row_number(spark):
    df = spark.range(0, 5000, 7).withColumnRenamed("id", "k").repartition(13)
    out = keyed.dense_index(df, ["k"], out="n", start=100).collect()
    got = sorted((r.k, r.n) for r in out)
    assert got == [(k, 100 + i + 1) for i, k in enumerate(sorted(r.k for r in out))]


def test_row_checks_share_one_scan(spark):
    users = user_batch(spark)
    out = keyed.rule_row_checks(users, {"nn": F.col("name").isNull(), "len": F.length("name") > 10})
    assert sorted((r.rule, r.violations) for r in out.collect()) == [("len", 7), ("nn", 0)]
    report = keyed.constraint_report([out, keyed.rule_unique("pk", users, ["id"])])
    assert report.count() == 3
