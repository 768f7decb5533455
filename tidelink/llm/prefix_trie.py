"""Conversation prefix trie from padded turn-id matrices.

Every distinct sequence of first d turns (role, text) of a conversation is a
node of depth d; conversations that start with it are its members.

1. *Turn ids.*  A turn becomes 128 bits of hash and its text's length; texts
   are not shuffled.  Equal turn numbers stand in the order of these ids.
2. *Rebuilding* (optional): the first h turns of a conversation are replaced by
   those of the first conversation of its hundred, h by the id's CRC-32.
3. *Shards.*  Conversations are range-partitioned by (turn ids, conv_id) and
   sorted, so a node's members stand together, and a sequence that very many
   conversations share spreads over as many shards as it fills.
4. *Blocks.*  A shard is worked through in blocks of bounded size: a padded
   matrix of turn ids per block, ``lexsort``, a mask of the columns in which a
   row differs from the one before, OR-accumulated from the left.  Its marks
   are the starts of nodes; ``reduceat`` over them gives members, children,
   leaves and savings at every depth.
5. *Border nodes.*  Nodes that hold a block's first or last row may go on in the
   next block.  Their parts are added up by node.  A border node belongs to the
   first block that it occurs in; there it stands on the path of the last row
   (or the first), as all its ancestors do, so sums over the deeper rows of one
   path give every ancestor its border descendants, without a join of nodes.
6. *Ends.*  The ids that end at a node are hashed where they stand; for border
   nodes one text per block goes to the hash, in order, as a stream.

Defined results: a null ``conv_id`` is no conversation, its rows are left out;
null role or text is empty; null turns come first; repeated rows are turns of
their own; an empty table has no node, not even the root; extra columns are
ignored.  The turn ids of one conversation (16 bytes a turn) must fit a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelink.llm.common import materialise

CELLS = 1 << 20          # cells of a block's matrix, about
HUNDRED, HEADS = 100, 6  # conversations that share a head, and one more than the head's largest length
_PAD = np.iinfo(np.int64).min
_NOTHING = hashlib.sha256(b"").hexdigest()

_NODE = ("block long, side int, depth int, key binary, conv_id long, parent_conv_id long, parent_side int, n_convs long, "
         "n_children long, n_leaves long, saved_tokens long, deepest int, last_length long, ends binary, ends_sha256 string")
_NAMES = [part.split()[0] for part in _NODE.split(", ")]
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
_TYPES = [_KINDS[part.split()[1]] for part in _NODE.split(", ")]


def turn_paths(turns: DataFrame, *, rebuild: bool = True) -> DataFrame:
    """``conv_id, path, lengths``: two longs a turn, and the code points of every turn's text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # Chained hashes from two different starts; the padding value stays free.
    ids = [F.greatest(F.xxhash64(F.lit(seed), role, text), F.lit(_PAD + 1).cast("long")).alias(f"id{seed}") for seed in (1, 2)]
    conv = F.col("conv_id").cast("long")
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        (conv - conv % HUNDRED).alias("base"), conv.alias("conv_id"), F.struct("turn", *ids, F.length(text).alias("n")).alias("t"))
    # One shuffle: the hundred conversations of a base lie in one partition.
    own = rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    if rebuild:
        head = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, HEADS - 1)), ignorenulls=True).over(
            Window.partitionBy("base").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
        own = own.select("conv_id", "own", head.alias("head"), h.alias("h"))
        rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1)))
        whole = F.when(F.col("head").isNull(), rest).otherwise(F.concat(F.slice("head", F.lit(1), F.col("h")), rest))
        own = own.select("conv_id", whole.alias("own"))
    return own.select("conv_id", F.flatten(F.transform("own", lambda t: F.array(t["id1"], t["id2"]))).alias("path"),
                      F.transform("own", lambda t: t["n"]).alias("lengths"))


def _keys(ids: np.ndarray) -> list[bytes]:
    """A key for every prefix of a path, the empty one first."""
    h = xxhash.xxh3_128(seed=len("trie"))
    keys = [h.digest()]
    for pair in ids.reshape(-1, 2):
        h.update(pair.tobytes())
        keys.append(h.digest())
    return keys


def block_nodes(conv: np.ndarray, depth: np.ndarray, path: np.ndarray, lengths: np.ndarray, block: int) -> list[pa.RecordBatch]:
    """Nodes of one block: whole ones finished, border ones (with ``key``) in parts.

    ``path`` holds two ids for each of the block's turns, ``lengths`` one number, both flat.
    """
    n, width = len(conv), int(depth.max(initial=0))
    inside = np.arange(width) < depth[:, None]
    ids = np.full((2, n, width), _PAD, dtype=np.int64)
    ids[0][inside], ids[1][inside] = path[0::2], path[1::2]
    size_of = np.zeros((n, width + 1), dtype=np.int64)  # column d: of depth d
    size_of[:, 1:][inside] = lengths
    order = np.lexsort((conv, *(ids[k, :, d] for d in reversed(range(width)) for k in (1, 0))))
    conv, depth, size_of, ids = conv[order], depth[order], size_of[order], ids[:, order]
    starts_at = np.zeros((n, width + 1), dtype=bool)
    starts_at[1:, 1:] = (ids[0, 1:] != ids[0, :-1]) | (ids[1, 1:] != ids[1, :-1])
    starts_at[0] = True
    np.logical_or.accumulate(starts_at, axis=1, out=starts_at)
    node = starts_at & (np.arange(width + 1) <= depth[:, None])
    last_start = n - 1 - np.argmax(starts_at[::-1], axis=0)  # start of the node that holds the last row
    whole = node.copy()
    whole[0] = False
    on_last = np.arange(int(depth[-1]) + 1)
    whole[last_start[on_last], on_last] = False

    names = [str(c) for c in conv.tolist()]
    keys = {0: _keys(ids[:, 0, :depth[0]].T.reshape(-1)), 1: _keys(ids[:, -1, :depth[-1]].T.reshape(-1))}
    leaves, below = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    out: list[dict] = []
    waiting = None  # finished nodes of the next depth, which lack their parents
    for d in range(width, -1, -1):
        starts = np.flatnonzero(starts_at[:, d])
        members = np.diff(np.append(starts, n))
        first = np.minimum.reduceat(conv, starts)
        if waiting is not None:
            at = np.searchsorted(starts, waiting.pop("row"), side="right") - 1
            done = whole[starts[at], d]
            tail = (starts[at] == last_start[d]) & (d <= depth[-1])
            waiting["parent_conv_id"] = pa.array(first[at], pa.int64(), mask=~done)
            waiting["parent_side"] = pa.array(tail.astype(np.int32), pa.int32(), mask=done)
            out.append(waiting)
            waiting = None
        deepest = np.maximum.reduceat(depth, starts)
        ended = np.add.reduceat((depth == d).astype(np.int64), starts)
        children = np.add.reduceat(whole[:, d + 1].astype(np.int64), starts) if d < width else np.zeros(len(starts), np.int64)
        leaves_in, saved_in = np.add.reduceat(leaves, starts), np.add.reduceat(below, starts)
        own_leaf, own_saved = (deepest == d).astype(np.int64), (members - 1) * size_of[starts, d]

        def ends_of(i: int) -> bytes:
            return ",".join(names[starts[i]:starts[i] + ended[i]]).encode()

        pick = np.flatnonzero(whole[starts, d])
        if len(pick):
            leaves[starts[pick]] += own_leaf[pick]
            below[starts[pick]] += own_saved[pick]
            waiting = {"row": starts[pick], "depth": np.full(len(pick), d), "conv_id": first[pick], "n_convs": members[pick],
                       "n_children": children[pick], "n_leaves": leaves_in[pick] + own_leaf[pick],
                       "saved_tokens": saved_in[pick] + own_saved[pick],
                       "ends_sha256": [hashlib.sha256(ends_of(i)).hexdigest() if ended[i] else _NOTHING for i in pick]}
        for side, i in ((0, 0), (1, len(starts) - 1)):
            if d > depth[0 if side == 0 else -1]:
                continue
            row = {"side": side, "depth": d, "key": keys[side][d]}
            if side == 1 or not (i == len(starts) - 1 and d <= depth[-1]):  # the other side has the figures of a node on both
                row |= {"conv_id": first[i], "n_convs": members[i], "n_children": children[i], "n_leaves": leaves_in[i],
                        "saved_tokens": saved_in[i], "deepest": deepest[i], "last_length": size_of[starts[i], d]}
                if ended[i]:
                    row["ends"] = ends_of(i)
            out.append({k: [v] for k, v in row.items()})
    batches = []
    for part in out:
        rows = len(part["depth"])
        part["block"] = np.full(rows, block)
        columns = [pa.nulls(rows, t) if k not in part else part[k] if isinstance(part[k], pa.Array) else pa.array(part[k], t)
                   for k, t in zip(_NAMES, _TYPES)]
        batches.append(pa.RecordBatch.from_arrays(columns, names=_NAMES))
    return batches


def _shard_nodes(batches):
    """Blocks of a sorted shard, at most ``CELLS`` cells (or one row) each; numbered in the shard's order."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        conv = batch.column(0).to_numpy()
        paths, lengths = batch.column(1), batch.column(2)
        depth = lengths.value_lengths().to_numpy().astype(np.int64)
        at = 0
        while at < len(conv):
            cells = np.maximum.accumulate(depth[at:] + 1) * np.arange(1, len(conv) - at + 1)
            end = at + max(1, int(np.searchsorted(cells, CELLS, side="right")))
            found = block_nodes(conv[at:end], depth[at:end], paths[at:end].flatten().to_numpy(),
                                lengths[at:end].flatten().to_numpy(), block)
            yield from pa.Table.from_batches(found).combine_chunks().to_batches()
            block, at = block + 1, end


def _stream_hashes(batches):
    """``key, ends_sha256`` from parts sorted by key and place: one hash runs over all parts of a key."""
    key, running = None, None
    for batch in batches:
        keys, hashes = [], []
        for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k == key:
                running.update(b",")
            else:
                if key is not None:
                    keys.append(key)
                    hashes.append(running.hexdigest())
                key, running = k, hashlib.sha256()
            running.update(part)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], names=["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()], pa.string())],
                                         names=["key", "ends_sha256"])


def prefix_trie(turns: DataFrame, *, rebuild: bool = True, shards: int | None = None) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    spark = turns.sparkSession
    paths = materialise(turn_paths(turns, rebuild=rebuild), "trie-paths")
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sharded = paths.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    found = materialise(sharded.select("conv_id", "path", "lengths").mapInArrow(_shard_nodes, _NODE), "trie-nodes")

    # Place of a part: blocks in order; within one block the last row's path before the first row's.
    parts = found.filter("key is not null").withColumn("place", F.col("block") * 2 + 1 - F.col("side"))
    total = parts.groupBy("key").agg(
        F.min("conv_id").alias("least"), F.sum("n_convs").alias("n"), F.sum("n_children").alias("children_in"),
        F.sum("n_leaves").alias("leaves_in"), F.sum("saved_tokens").alias("saved_in"), F.max("deepest").alias("to"),
        F.max("last_length").alias("length"), F.min("place").alias("owner"))
    chain = parts.select("block", "side", "depth", "key", "place").join(total, "key").withColumn(
        "owned", (F.col("place") == F.col("owner")).cast("long")).withColumn(
        "leaf", (F.col("to") == F.col("depth")).cast("long")).withColumn("saved", (F.col("n") - 1) * F.col("length"))
    downward = Window.partitionBy("block", "side").orderBy(F.desc("depth"))
    deeper = downward.rowsBetween(Window.unboundedPreceding, -1)
    chain = materialise(chain.select(
        "*", F.coalesce(F.lag("owned").over(downward), F.lit(0)).alias("children_more"),
        F.coalesce(F.sum(F.col("owned") * F.col("leaf")).over(deeper), F.lit(0)).alias("leaves_more"),
        F.coalesce(F.sum(F.col("owned") * F.col("saved")).over(deeper), F.lit(0)).alias("saved_more"),
        F.lead("least").over(downward).alias("parent")), "trie-chain")
    hashed = (parts.filter("ends is not null").select("key", "ends", "place").repartition("key")
              .sortWithinPartitions("key", "place").select("key", "ends").mapInArrow(_stream_hashes, "key binary, ends_sha256 string"))
    border = (chain.groupBy("key").agg(
        F.max("least").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent_conv_id"),
        F.max("n").alias("n_convs"), (F.max("children_in") + F.sum("children_more")).alias("n_children"),
        (F.max("leaves_in") + F.max("leaf") + F.sum("leaves_more")).alias("n_leaves"),
        (F.max("saved_in") + F.max("saved") + F.sum("saved_more")).alias("saved_tokens"))
        .join(hashed, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NOTHING))))

    # Whole nodes under a border node get its name; there are at most a block's rows of one (block, side, depth).
    finished = found.filter("key is null")
    root = chain.filter("depth = 0").agg(F.min("least").alias("least")).first()["least"]
    named = finished.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root).cast("long")).otherwise(F.col("parent_conv_id")))
    above = chain.select("block", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), F.col("least").alias("above"))
    under = named.filter("parent_conv_id is null").join(above, ["block", "parent_side", "depth"]).withColumn("parent_conv_id", F.col("above"))
    columns = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
               "saved_tokens", "ends_sha256"]
    return (border.select(*columns).unionByName(named.filter("parent_conv_id is not null").select(*columns))
            .unionByName(under.select(*columns)))


def oracle_sql() -> str:
    """DuckDB twin: nodes by their lists of turns, subtree sums over the prefixes of every node."""
    crc = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
        lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
            lambda bits, step: xor(bits >> 1, 3988292384 * (bits & 1))))"""
    return f"""WITH own AS (SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
        ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    headed AS (SELECT o.c, o.turns, coalesce(b.turns, []) AS head, xor({crc.replace('c::VARCHAR', 'o.c::VARCHAR')}, 4294967295) % 6 AS h
        FROM own o LEFT JOIN own b ON b.c = o.c - o.c % 100),
    convs AS (SELECT c, list_concat(list_slice(head, 1, h), list_slice(turns, h + 1, len(turns))) AS turns FROM headed),
    prefixes AS (SELECT c, d, list_slice(turns, 1, d) AS p, d = len(turns) AS ended
        FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM convs)),
    nodes AS (SELECT p, d, min(c) AS conv_id, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '') AS ends,
        bool_and(ended) AS childless FROM prefixes GROUP BY p, d),
    above AS (SELECT list_slice(p, 1, a) AS p, a, sum((n - 1) * CASE WHEN d > 0 THEN length(p[d].t) ELSE 0 END) AS saved,
        count(*) FILTER (childless) AS leaves, count(*) FILTER (d = a + 1) AS children
        FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM nodes) GROUP BY ALL)
    SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n AS n_convs, above.children AS n_children,
        above.leaves AS n_leaves, above.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
    FROM nodes n JOIN above ON above.p = n.p AND above.a = n.d
    LEFT JOIN nodes up ON n.d > 0 AND up.d = n.d - 1 AND up.p = list_slice(n.p, 1, n.d - 1)"""
