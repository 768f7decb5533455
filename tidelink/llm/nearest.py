"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Largest inner product becomes smallest Euclidean distance by one added
coordinate (candidates get sqrt(M^2 - |x|^2), queries 0, with M the largest
norm).  Vectors are projected by ``PROJECTIONS`` Gaussian (2-stable)
directions: for a point at distance d, projected^2 / d^2 follows a chi-square
law with that many degrees of freedom.  A kd-tree over the projections yields
projected neighbours incrementally, leaf by leaf in order of distance; each is
verified on the original vectors, until the next leaf's projected distance is
so large that a nearer point than the current k-th would have shown up with
probability ``STOP`` (the chi-square test).

The top of the tree is fitted on a bounded sample (``SAMPLE_ROWS``); every row
is indexed.  Its leaves are Spark partitions of about ``LEAF_ROWS`` vectors,
each with a kd-tree of its own.  A query first searches its home leaf; with
the distance found it goes on to those leaves only that the test does not
rule out.  Equal vectors are one class that carries its smallest ids (as many
as any answer can need), so a common vector costs one row.

Defined results: vectors that are null, empty, zero or hold null, NaN or
infinite components take no part, as do rows with a null id; vectors of
another length than the longest-held one (the most frequent) take no part;
repeated rows of an id and vector count once; ties go to the smaller id; with
fewer candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelink.llm.common import materialise

PROJECTIONS = 8
STOP = 0.95
LEAF_ROWS = 8_192
NODE_ROWS = 128
SAMPLE_ROWS = 20_000
SEED = 29


def chi_square_quantile(p: float, degrees: int) -> float:
    """Quantile for an even number of degrees, by bisection of the closed-form distribution."""

    def cdf(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        return 1.0 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while cdf(high) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def directions(dim: int) -> np.ndarray:
    """(dim + 1, PROJECTIONS) Gaussian directions; the last row belongs to the added coordinate."""
    return np.random.default_rng(SEED).standard_normal((dim + 1, PROJECTIONS))


def project(vectors: np.ndarray, largest: float, queries: bool) -> np.ndarray:
    dirs = directions(vectors.shape[1])
    out = vectors @ dirs[:-1]
    if not queries:
        added = np.sqrt(np.maximum(0.0, largest * largest - np.einsum("ij,ij->i", vectors, vectors)))
        out += added[:, None] * dirs[-1]
    return out


class TopTree:
    """kd-splits fitted on a sample; numbers the leaves and bounds their distance."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.splits: list[list[tuple[int, float]]] = []
        self.depth = max(0, math.ceil(math.log2(leaves))) if leaves > 1 and len(sample) > 1 else 0
        groups = [sample]
        for _ in range(self.depth):
            row, nxt = [], []
            for g in groups:
                dim = int(np.argmax(g.var(axis=0))) if len(g) > 1 else 0
                cut = float(np.median(g[:, dim])) if len(g) else 0.0
                row.append((dim, cut))
                nxt += [g[g[:, dim] < cut], g[g[:, dim] >= cut]]
            self.splits.append(row)
            groups = nxt

    def leaf(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), dtype=np.int64)
        for row in self.splits:
            dims, cuts = np.array([d for d, _ in row]), np.array([c for _, c in row])
            at = 2 * at + (points[np.arange(len(points)), dims[at]] >= cuts[at])
        return at

    def reach(self, point: np.ndarray, radius2: float) -> list[int]:
        """Leaves whose region lies within the squared radius of a point."""
        found, stack = [], [(0, 0, np.zeros(len(point)))]
        while stack:
            level, node, gaps = stack.pop()
            if level == self.depth:
                found.append(node)
                continue
            dim, cut = self.splits[level][node]
            gap = point[dim] - cut
            for side in (0, 1):
                inside = (gap >= 0) == bool(side)
                far = gaps if inside else gaps.copy()
                if not inside:
                    far[dim] = max(far[dim], abs(gap))
                if float(far @ far) <= radius2:
                    stack.append((level + 1, 2 * node + side, far))
        return found


def kd_nodes(points: np.ndarray) -> list[np.ndarray]:
    """Row numbers of the kd-tree's leaves, at most NODE_ROWS each (more only for equal projections)."""
    out, stack = [], [np.arange(len(points))]
    while stack:
        rows = stack.pop()
        if len(rows) <= NODE_ROWS:
            out.append(rows)
            continue
        mine = points[rows]
        dim = int(np.argmax(mine.max(axis=0) - mine.min(axis=0)))
        order = np.argsort(mine[:, dim], kind="stable")
        half = len(rows) // 2
        stack += [rows[order[:half]], rows[order[half:]]]
    return out


def search_leaf(vectors: np.ndarray, projected: np.ndarray, queries: np.ndarray, q_projected: np.ndarray,
                largest: float, known: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best ``want`` vectors of one leaf for each query by incremental verification.

    ``known`` is each query's squared distance to beat (infinite at first).
    Returns row numbers (-1: none), inner products, and the squared distance
    of the last one wanted.
    """
    limit = chi_square_quantile(STOP, projected.shape[1])
    nodes = kd_nodes(projected)
    low = np.stack([projected[n].min(axis=0) for n in nodes])
    high = np.stack([projected[n].max(axis=0) for n in nodes])
    bound = np.zeros((len(queries), len(nodes)))
    for d in range(projected.shape[1]):
        q = q_projected[:, d:d + 1]
        gap = np.maximum(0.0, np.maximum(low[:, d] - q, q - high[:, d]))
        bound += gap * gap
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full((len(queries), want), -np.inf)
    rows = np.full((len(queries), want), -1, dtype=np.int64)
    base = largest * largest + np.einsum("ij,ij->i", queries, queries)
    radius = known.copy()
    active = np.arange(len(queries))
    for step in range(len(nodes)):
        node_of = order[active, step]
        going = bound[active, node_of] <= limit * radius[active]
        active, node_of = active[going], node_of[going]
        if not len(active):
            break
        for node in np.unique(node_of):
            mine = active[node_of == node]
            scores = queries[mine] @ vectors[nodes[node]].T
            both = np.concatenate([best[mine], scores], axis=1)
            names = np.concatenate([rows[mine], np.broadcast_to(nodes[node], scores.shape)], axis=1)
            pick = np.argpartition(-both, want - 1, axis=1)[:, :want] if both.shape[1] > want else np.argsort(-both, axis=1)
            best[mine] = np.take_along_axis(both, pick, axis=1)
            rows[mine] = np.take_along_axis(names, pick, axis=1)
            radius[mine] = np.minimum(known[mine], np.maximum(0.0, base[mine] - 2 * best[mine].min(axis=1)))
    return rows, best, radius


def _vectors(column) -> np.ndarray:
    return np.stack([np.frombuffer(v, dtype="<f8") for v in column]) if len(column) else np.empty((0, 1))


def _classes(rows: DataFrame, want: int, every: int) -> DataFrame:
    """``vec, ids, asks``: distinct vectors with their smallest ids and whether one of them is a query.

    A batch keeps at most ``want`` ids of a vector, so little of a common one is shuffled.
    """

    def run(batches):
        for batch in batches:
            found: dict[bytes, list[int]] = {}
            asks: set[bytes] = set()
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                vec = np.asarray(vector.values, dtype="<f8").tobytes()
                found.setdefault(vec, []).append(vec_id)
                if vec_id % every == 0:
                    asks.add(vec)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()),
                 pa.array([sorted(set(ids))[:want] for ids in found.values()], pa.list_(pa.int64())),
                 pa.array([v in asks for v in found], pa.bool_())], names=["vec", "ids", "asks"])

    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, want)
    return (rows.mapInArrow(run, "vec binary, ids array<long>, asks boolean").groupBy("vec")
            .agg(smallest.alias("ids"), F.max("asks").alias("asks"))
            .withColumn("key", F.md5("vec")))


def nearest(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20,
            k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every`` its ``k`` nearest others."""
    spark = vectors.sparkSession
    usable = ("id is not null and v is not null and size(v) > 0 and exists(v, x -> x != 0) and "
              "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"),
                          F.col(vector_col).cast("array<double>").alias("v")).filter(usable)
    want = k + 1  # the query itself may be among its class's ids
    classes = materialise(_classes(rows, want, every), "nearest-classes")
    width = classes.groupBy(F.length("vec").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "w").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return spark.createDataFrame([], schema)
    classes = classes.filter(F.length("vec") == width["w"])
    dim, n = width["w"] // 8, width["n"]

    def norms(batches):
        for batch in batches:
            v = _vectors(batch.column(0).to_pylist())
            top = float(np.einsum("ij,ij->i", v, v).max()) if len(v) else 0.0
            yield pa.RecordBatch.from_arrays([pa.array([top])], names=["m"])

    largest = math.sqrt(classes.select("vec").mapInArrow(norms, "m double").agg(F.max("m")).first()[0])
    leaves = -(-n // LEAF_ROWS)
    share = F.pmod(F.xxhash64(F.lit("top"), "key"), F.lit(1_000_000)) < F.lit(int(1e6 * min(1.0, SAMPLE_ROWS / n)) + 1)
    sample = classes.filter(share).select("vec").limit(2 * SAMPLE_ROWS).toPandas() if leaves > 1 else None
    top = TopTree(project(_vectors(sample["vec"]), largest, False) if sample is not None else np.empty((0, PROJECTIONS)), leaves)
    shared = spark.sparkContext.broadcast(top)

    def place(batches):
        for batch in batches:
            v = _vectors(batch.column(0).to_pylist())
            asks = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            leaf = shared.value.leaf(project(v, largest, False)) if len(v) else np.empty(0, np.int64)
            home = shared.value.leaf(project(v, largest, True)) if len(v) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(leaf, pa.int64()), pa.array(np.where(asks, home, -1), pa.int64())],
                names=["vec", "ids", "asks", "key", "leaf", "home"])

    placed = classes.select("vec", "ids", "asks", "key").mapInArrow(
        place, "vec binary, ids array<long>, asks boolean, key string, leaf long, home long")
    points = placed.select("leaf", "vec", "ids")
    asked = placed.filter("asks").select(F.col("home").alias("leaf"), "key", F.col("vec").alias("q"),
                                         F.lit(float("inf")).alias("known"))
    found_schema = "key string, q binary, home long, radius double, ids array<long>, scores array<double>"

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right):
            return pd.DataFrame({c: pd.Series(dtype=object) for c in ("key", "q", "home", "radius", "ids", "scores")})
        if not len(left):
            return right.rename(columns={"leaf": "home", "known": "radius"}).assign(
                ids=[[]] * len(right), scores=[[]] * len(right))[["key", "q", "home", "radius", "ids", "scores"]]
        left = left.sort_values("vec", kind="stable")
        x, q = _vectors(left["vec"]), _vectors(right["q"])
        hit, _, radius = search_leaf(x, project(x, largest, False), q, project(q, largest, True), largest,
                                     right["known"].to_numpy(dtype=np.float64), want)
        names = left["ids"].to_list()
        ids, scores = [], []
        for i in range(len(q)):
            own = hit[i][hit[i] >= 0]
            exact = (x[own] * q[i]).sum(axis=1)
            flat = sorted((-s, int(v)) for s, r in zip(exact, own) for v in names[r])[:want]
            ids.append([v for _, v in flat])
            scores.append([-s for s, _ in flat])
        return pd.DataFrame({"key": right["key"].to_numpy(), "q": right["q"].to_numpy(),
                             "home": right["leaf"].to_numpy(), "radius": radius, "ids": ids, "scores": scores})

    def run(queries: DataFrame) -> DataFrame:
        return points.groupBy("leaf").cogroup(queries.groupBy("leaf")).applyInPandas(search, found_schema)

    first = materialise(run(asked), "nearest-home")
    found = first.select("key", "ids", "scores")
    if top.depth:
        limit = chi_square_quantile(STOP, PROJECTIONS)

        def spread(batches):
            for batch in batches:
                keys, vecs, homes, radii = (c.to_pylist() for c in batch.columns)
                q = project(_vectors(vecs), largest, True) if vecs else np.empty((0, PROJECTIONS))
                out = [(leaf, key, vec, r) for key, vec, home, r, p in zip(keys, vecs, homes, radii, q)
                       for leaf in shared.value.reach(p, limit * r) if leaf != home]
                columns = list(zip(*out)) if out else [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.binary(), pa.float64()))],
                    names=["leaf", "key", "q", "known"])

        further = first.select("key", "q", "home", "radius").mapInArrow(
            spread, "leaf long, key string, q binary, known double")
        found = found.unionByName(run(further).select("key", "ids", "scores"))
    # Every leaf gives at most k+1 entries; the best k+1 of them all.
    pairs = F.flatten(F.collect_list(F.arrays_zip(F.transform("scores", lambda s: -s).alias("s"), F.col("ids").alias("v"))))
    best = found.groupBy("key").agg(F.slice(F.array_sort(pairs), 1, want).alias("near"))
    queries = (rows.filter(F.col("id") % every == 0).filter(F.size("v") == dim).distinct()
               .mapInArrow(_keys, "query_id long, key string"))
    return (queries.join(best, "key")
            .select("query_id", F.posexplode(F.slice(F.filter("near", lambda e: e["v"] != F.col("query_id")), 1, k))
                    .alias("pos", "e"))
            .select("query_id", (F.col("pos") + 1).alias("rank"), F.col("e.v").alias("vec_id"), (-F.col("e.s")).alias("score")))


def _keys(batches):
    """``id, v`` to the id and its class key."""
    for batch in batches:
        keys = [hashlib.md5(np.asarray(v.values, dtype="<f8").tobytes()).hexdigest() for v in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string())], names=["query_id", "key"])
