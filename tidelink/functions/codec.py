"""Encoding and column protection (hex, base64, AES) as column expressions.

The reference moves bytes as lower-case hex inside JSON and keys/ciphertext
as base64, and encrypts every message with AES-256.  Here the same
transformations are applied to columns; encryption uses Spark's built-in
``aes_encrypt`` in GCM mode (random IV, authenticated), so ciphertext is not
wire-compatible with the reference's CFB framing and need not be.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_hex(c) -> Column:
    return F.lower(F.hex(_col(c)))


def from_hex_text(c) -> Column:
    return F.decode(F.unhex(_col(c)), "UTF-8")


def to_base64(c) -> Column:
    return F.base64(_col(c))


def from_base64_text(c) -> Column:
    """Decoded text, or null when the value is not valid base64."""
    return F.decode(F.try_to_binary(_col(c), F.lit("base64")), "UTF-8")


def hex_byte_length(c) -> Column:
    """Bytes carried by a hex payload (two characters per byte)."""
    return (F.length(_col(c)) / F.lit(2)).cast("long")


def write_key(spark, path: str, key: str) -> None:
    """Store a key as the one row of a table (for tests and demos; a cluster mounts a secret)."""
    spark.createDataFrame([(key,)], "key string").write.mode("overwrite").parquet(path)


def key_from(spark, path: str) -> Column:
    """The key stored at ``path`` as a scalar subquery.

    It is read when the query runs; plans show the path, never the key.
    """
    return spark.read.parquet(path).select("key").scalar()


def encrypt(c, key: Column | str) -> Column:
    """AES-256-GCM; ``key`` must be 32 bytes.  Returns binary (IV || ct || tag)."""
    k = F.lit(key) if isinstance(key, str) else key
    return F.aes_encrypt(_col(c).cast("binary"), k, F.lit("GCM"))


def decrypt_text(c, key: Column | str) -> Column:
    """Clear text, or null when the ciphertext fails authentication."""
    k = F.lit(key) if isinstance(key, str) else key
    return F.decode(F.try_aes_decrypt(_col(c), k, F.lit("GCM")), "UTF-8")


def protect_columns(df, columns, key: Column | str, suffix: str = "_enc"):
    """Replace clear columns by base64 ciphertext columns ``<c><suffix>``."""
    out = df
    for c in columns:
        out = out.withColumn(f"{c}{suffix}", F.base64(encrypt(c, key))).drop(c)
    return out


def unprotect_columns(df, columns, key: Column | str, suffix: str = "_enc"):
    out = df
    for c in columns:
        raw = F.try_to_binary(F.col(f"{c}{suffix}"), F.lit("base64"))
        out = out.withColumn(c, decrypt_text(raw, key)).drop(f"{c}{suffix}")
    return out
