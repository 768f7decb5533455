"""The reference's seed tables (10 users, 12 orders) as DataFrames."""

from decimal import Decimal

from pyspark.sql import types as T

USERS = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("email", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType(), True),
])
ORDERS = T.StructType([
    T.StructField("id", T.IntegerType(), True),
    T.StructField("user_id", T.IntegerType(), True),
    T.StructField("product_name", T.StringType(), False),
    T.StructField("quantity", T.IntegerType(), False),
    T.StructField("total_amount", T.DecimalType(10, 2), False),
    T.StructField("order_date", T.TimestampNTZType(), True),
])

# Seed rows of the demo database.
USER_ROWS = [
    ("John Doe", "john.doe@example.com"),
    ("Jane Smith", "jane.smith@example.com"),
    ("Bob Johnson", "bob.johnson@example.com"),
    ("Alice Williams", "alice.williams@example.com"),
    ("Charlie Brown", "charlie.brown@example.com"),
    ("Diana Prince", "diana.prince@example.com"),
    ("Eve Anderson", "eve.anderson@example.com"),
    ("Frank Miller", "frank.miller@example.com"),
    ("Grace Lee", "grace.lee@example.com"),
    ("Henry Taylor", "henry.taylor@example.com"),
]
ORDER_ROWS = [
    (1, "Laptop Computer", 1, "1299.99"),
    (1, "Wireless Mouse", 2, "49.98"),
    (2, "Office Chair", 1, "399.00"),
    (3, "Desk Lamp", 1, "79.99"),
    (3, "USB-C Cable", 3, "29.97"),
    (4, 'Monitor 27"', 1, "349.00"),
    (5, "Keyboard Mechanical", 1, "159.99"),
    (6, "Webcam HD", 1, "89.99"),
    (7, "Headphones", 1, "199.00"),
    (8, "External SSD 1TB", 1, "129.99"),
    (9, "Laptop Stand", 1, "49.99"),
    (10, "Cable Management", 1, "24.99"),
]


def user_batch(spark):
    return spark.createDataFrame([(i, n, e, None) for i, (n, e) in enumerate(USER_ROWS, 1)], USERS)


def order_batch(spark):
    return spark.createDataFrame(
        [(None, u, p, q, Decimal(a), None) for u, p, q, a in ORDER_ROWS], ORDERS)
