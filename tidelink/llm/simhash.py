"""SimHash near duplicates by meet-in-the-middle ball hashing.

A text's words (A-Z lower-cased, runs of anything but ASCII white space) give
three-word shingles, repeats included, joined by spaces (fewer words: the whole
sequence).  A bit of the fingerprint is set if over half of the shingles' XXH64
hashes (seed 42) have it; a text without words, and a null text, has
fingerprint zero.  Fingerprints link at ``radius`` or fewer differing bits.

1. Equal fingerprints form a class, by a partial aggregation; one row goes on.
2. Every fingerprint emits all variants within half the radius (itself and, at
   radius 2, its 64 one-bit neighbours).  Linked fingerprints share a variant:
   half of the bits that tell them apart lead from either one to it.
3. The variants are shuffled.  Whatever meets at a variant lies within the
   radius of each other, so a variant has at most as many different
   fingerprints as a ball (65), however many rows there are, and linking each
   to the next smaller one there joins the same groups as all their pairs.
   The links are deduplicated and verified by the bits that differ.
4. Components by star contraction; classes carry their documents.

Defined results: repeated rows are rows of one class; a null ``doc_id`` takes
part but never names a component unless it stands alone (then null); an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelink.llm.common import map_rows, materialise, text_bytes
from tidelink.llm.connected import component_roots

WORDS, SEED, RADIUS = 3, 42, 2
PART = 1 << 16  # shingles of a text counted at a time


def fingerprint(text: bytes, n: int = WORDS) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    words = text.lower().split()
    if not words:
        return 0
    length = min(n, len(words))
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:len(ends) - length]])
    ends = ends[length - 1:] - 1
    total, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), PART):
        pairs = zip(starts[at:at + PART].tolist(), ends[at:at + PART].tolist())
        hashes = np.array([digest(line[a:b], SEED) for a, b in pairs], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every row as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, n) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64), pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text")), run, f"doc_id {kind}, fp long")


def _masks(half: int) -> list[int]:
    """Every choice of at most ``half`` of 64 bits, as signed numbers."""
    found = [sum(1 << bit for bit in bits) for k in range(half + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def near_links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links whose components are those of all pairs of ``fp`` within the radius (an even number)."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius is an even number of bits")
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(radius // 2)])
    variants = classes.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    met = variants.select(before.alias("a"), F.col("fp").alias("b")).filter("a is not null").distinct()
    return met.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS,
                    radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``."""
    found = materialise(fingerprints(docs, id_col=id_col, text_col=text_col, n=n), "simhash-fingerprints")
    classes = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    links = materialise(near_links(classes.select("fp"), radius), "simhash-links")
    roots = component_roots(links, "a", "b").withColumnRenamed("node", "fp")
    placed = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = materialise(placed.join(names, "root").select("fp", "component_id"), "simhash-components")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.join(of_class, "fp").select("doc_id", text.alias("fingerprint"), "component_id")
