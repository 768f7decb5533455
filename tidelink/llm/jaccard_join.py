"""N-gram Jaccard join by PartEnum signatures, with its connected components.

A text's set holds the 64-bit hashes of its distinct word n-grams (A-Z lower-
cased; words are runs of anything but ASCII white space; a text of fewer than
n words has one element, its whole word sequence; a text without words, and a
null text, has none).  Two sets link when ``den * |A & B| >= num * |A | B|``
(0.9 is 90/100).

1. *Classes.*  Equal sets (128-bit digest) form a class, found by a partial
   aggregation; one representative goes on.
2. *Signatures.*  Sizes are cut into bands.  A linked pair of sizes a, b has
   symmetric difference at most (a+b)(1-g)/(1+g); for the bands of a pair this
   bounds the distance by k.  The hashed feature domain is split into first-
   level parts, of which all but k / 2 hold at most one of the differences, and
   each of those into three second-level parts; every subset of two of them
   gives one signature (the sum of its mixed features).  A set signs for its
   own band and, near the band's upper end, for the next one.
   A subset that holds no feature is signed only by sets that have too few
   parts without such a subset: the parts are so many that a few may be missing.
3. *Rare signatures.*  So linked sets share not one signature but at least a
   number r that each of them knows: its parts without an empty subset, less
   k / 2.  Both may leave out their r - 1 most frequent signatures and still
   share the least frequent common one.  Signatures of a passage that very many
   texts hold are the frequent ones, and go.
4. *Hubs.*  In every signature group the member met most often over all groups
   is the hub.  Only pairs (member, hub) are compared, so a group of m sets
   costs m rows, not m*m.
   *The rest, exactly.*  Two members of one group that both link to its hub are in
   one component already.  A member is near its hub if it links to it, or if the
   triangle inequality leaves room for a set that links to both.  Near members are
   compared by their differences from the hub, which are all that the distance of
   two of them needs, in blocks of about ``BLOCK`` members, of which every two meet
   in one task; a task gives a forest of the links, at most one row a member, no
   pairs.  A member that is not near links to members only that are not linked to
   the hub.  Such two have a common element within short prefixes of their sets,
   elements that the hub lacks first, which an equi-join on (hub, element) finds;
   these pairs are compared by their whole sets.  No component loses a link.
5. *Components* of the links by star contraction; classes carry their members.
6. *Link counts.*  The same blocks count the links of each member.  A pair that is
   near several hubs in common counts at the smallest of them.

Defined results: repeated rows are rows of one class; a text without words has
``n_shingles`` 0 and only itself as component; a null ``doc_id`` takes part but
never names a component unless it stands alone (then null); an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, sqrt
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelink.llm.common import in_parts, map_rows, materialise, text_bytes
from tidelink.llm.connected import component_roots

WORDS = 3                # shingle length
NUM, DEN = 90, 100       # similarity of a link, as a fraction
BAND_STEPS = 1           # a band's sizes span this many factors 1/threshold
SECOND = 3               # second-level parts of a first-level part, of which one may differ
SPARE = 0.05             # share of first-level parts beyond those needed, for signatures that may be left out
_DROP_BITS = 10          # a class carries how many signatures it may leave out, up to 1023, for both bands
_TAIL_BITS = 2 * _DROP_BITS + 1
BITMAP_BITS = 1 << 24    # fixed size of the row prefilter below (2 MB)
REMEMBER = 200_000       # word hashes kept by a task
BLOCK = 512              # near members of one hub in a block, about
VALUES = 4096            # values that two blocks share, compared at a time
SALTS = 32               # tasks that the members of one hub spread over before they are dealt to blocks

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word to 64-bit hash; forgets when full (the hash itself never changes)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_set(text: bytes, known: WordHashes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    length = min(n, len(words))
    code = np.full(len(h) - length + 1, length, dtype=np.uint64)
    for j in range(length):
        code = _mix(code * _M1 + h[j:len(h) - length + 1 + j])
    return np.unique(code)


class PartEnum:
    """Size bands and signatures for one threshold num/den."""

    def __init__(self, num: int = NUM, den: int = DEN, largest: int = 1 << 40):
        self.num, self.den = num, den
        low, self.bands = 1, []
        while low < largest:
            high = low
            for _ in range(BAND_STEPS):
                high = max(high, high * den // num)
            self.bands.append((low, high))
            low = high + 1
        self.lows = np.array([b[0] for b in self.bands], dtype=np.int64)
        self._parts: dict[int, int] = {}

    def distance(self, total: int) -> int:
        """Largest symmetric difference of linked sets whose sizes sum to ``total``."""
        return total * (self.den - self.num) // (self.den + self.num)

    def parts(self, band: int) -> int:
        """First-level parts of a band: as many as the distance needs, some spare ones, and about as
        many as have an empty subset in the band's smallest sets (loads are close to Poisson ones)."""
        if band not in self._parts:
            low, high = self.bands[band]
            least = self.distance(2 * high) // 2 + 1
            sure, more = least + ceil(least * SPARE), 0
            while more <= least:
                empty = exp(-low / (sure + more) / SECOND)
                light = (sure + more) * (3 * empty ** 2 * (1 - empty) + empty ** 3)
                want = ceil(light + 2 * sqrt(light))
                if want <= more:
                    break
                more = want
            self._parts[band] = sure + (more if more <= least else 0)
        return self._parts[band]

    def reach(self, a: int, b: int) -> int:
        """Largest symmetric difference of sets of ``a`` and ``b`` elements with both of which a third one links."""
        third = min(a, b) * self.den // self.num
        return self.distance(a + third) + self.distance(b + third)

    def sign(self, items: np.ndarray) -> tuple[np.ndarray, int]:
        """A set's signatures, and a number of ``_TAIL_BITS`` bits: its band's parity, and how many
        signatures it may leave out in its own band and in the next one.  A signature's last bit is
        its band's parity."""
        n = len(items)
        if n * self.den // self.num == n:  # no other size and no difference can link
            return np.empty(0, dtype=np.uint64), 0
        band = int(np.searchsorted(self.lows, n, side="right")) - 1
        own, drop = self._sign(items, band)
        after, drop_after = np.empty(0, dtype=np.uint64), 0
        if band + 1 < len(self.bands) and n * self.den >= self.num * self.bands[band + 1][0]:
            after, drop_after = self._sign(items, band + 1)
        return np.concatenate([own, after]), ((band & 1) << 2 * _DROP_BITS) | (drop << _DROP_BITS) | drop_after

    def signatures(self, items: np.ndarray) -> np.ndarray:
        return self.sign(items)[0]

    def _sign(self, items: np.ndarray, band: int) -> tuple[np.ndarray, int]:
        n1 = self.parts(band)
        seed = _mix(np.array([band + 1], dtype=np.uint64) * _M1)[0]
        part = ((_mix(items ^ seed) >> np.uint64(33)) % np.uint64(n1 * SECOND)).astype(np.int64)
        sums = np.zeros(n1 * SECOND, dtype=np.uint64)
        np.add.at(sums, part, _mix(items + seed))
        sums = sums.reshape(n1, SECOND)
        load = np.bincount(part, minlength=n1 * SECOND).reshape(n1, SECOND)
        # Every subset leaves out one second-level part.
        subsets = (sums.sum(axis=1, dtype=np.uint64)[:, None] - sums).ravel()
        filled = (load.sum(axis=1)[:, None] - load) > 0
        shared = int(filled.all(axis=1).sum()) - self.distance(2 * self.bands[band][1]) // 2
        signed = _mix(_mix(subsets + seed) + np.arange(len(subsets), dtype=np.uint64) * _M1)
        signed = (signed & ~np.uint64(1)) | np.uint64(band & 1)
        if shared < 1:
            return signed, 0
        return signed[filled.ravel()], min(shared - 1, (1 << _DROP_BITS) - 1)


def _longs(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _packed(items: np.ndarray) -> bytes:
    """The low 48 bits of every hash: two sets of 10,000 mix up an element once in millions of comparisons."""
    return items.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(data: pa.BinaryScalar) -> np.ndarray:
    raw = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, :6] = raw
    return wide.reshape(-1).view(np.uint64)


#: Values of the six bytes of a packed element.
_PLACES = np.int64(1) << (8 * np.arange(6, dtype=np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *(len(a) for a in arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))


def _digest(items: np.ndarray) -> bytes | None:
    """The class of a set; a set without elements has none."""
    return xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None


def _route(digest: bytes | None) -> int | None:
    """The first bits of a class, by which signature rows name it; classes that share them are compared all."""
    return None if digest is None else int.from_bytes(digest[:8], "big") >> _TAIL_BITS


def _size_docs(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, n_shingles, key, route`` per row; ``key`` is the class."""

    def run(batches):
        known = WordHashes()
        for batch in in_parts(batches):
            sets = [shingle_set(text, known, n) for text in batch.column(1).to_pylist()]
            keys = [_digest(items) for items in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(items) for items in sets], pa.int64()), pa.array(keys, pa.binary()),
                 pa.array([_route(k) for k in keys], pa.int64())], names=["doc_id", "n_shingles", "key", "route"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_shingles long, key binary, route long")


def _signatures(docs: DataFrame, scheme: PartEnum, n: int) -> DataFrame:
    """``sig, name``: a row per signature; a name is a class's route and its ``sign`` number.  A task signs a class once."""

    def run(batches):
        known, signed = WordHashes(), set()
        for batch in in_parts(batches):
            sigs, names = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
            for text in batch.column(1).to_pylist():
                items = shingle_set(text, known, n)
                key = _digest(items)
                if key is None or key in signed:
                    continue
                if len(signed) >= REMEMBER:
                    signed.clear()
                signed.add(key)
                found, tail = scheme.sign(items)
                sigs.append(found)
                name = (_route(key) << _TAIL_BITS) | tail
                names.append(np.full(len(found), name - (1 << 64) if name >> 63 else name, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_longs(np.concatenate(sigs)), pa.int64()), pa.array(np.concatenate(names), pa.int64())], names=["sig", "name"])

    return docs.mapInArrow(run, "sig long, name long")


def _hub_pairs(signatures: DataFrame) -> DataFrame:
    """Routes of member and hub (``rx``, ``rp``) of every group of two or more classes that share a
    signature; ``others``: whether such a group has a third member."""
    group = Window.partitionBy("sig")
    met = signatures.select("sig", "name", F.min("name").over(group).alias("low"), F.max("name").over(group).alias("high"),
                            F.count(F.lit(1)).over(group).alias("m"))  # one shuffle, fixed-width rows
    members = materialise(met.filter("low <> high").select("sig", "name", "m").distinct(), "jaccard-members")
    # Of a class's signatures in a band, the most frequent ones go, as many as it may leave out.
    mask = (1 << _DROP_BITS) - 1
    parity = F.col("sig").bitwiseAND(F.lit(1))
    own = parity == F.shiftright("name", 2 * _DROP_BITS).bitwiseAND(F.lit(1))
    drop = F.when(own, F.shiftright("name", _DROP_BITS)).otherwise(F.col("name")).bitwiseAND(F.lit(mask))
    rank = F.row_number().over(Window.partitionBy("name", parity).orderBy(F.desc("m"), "sig"))
    kept = members.select("sig", "name", drop.alias("drop"), rank.alias("rank")).filter("rank > drop").select("sig", "name")
    # The member met most often over all groups is the hub of its groups, so that a class has few hubs.
    often = members.groupBy("name").agg(F.sum("m").alias("met"))
    grouped = kept.join(often, "name").select("name", F.max(F.struct("met", "name")).over(group)["name"].alias("hub"),
                                              F.count(F.lit(1)).over(group).alias("m")).filter("name <> hub")
    route = lambda c: F.shiftrightunsigned(c, _TAIL_BITS)
    return grouped.groupBy(route("name").alias("rx"), route("hub").alias("rp")).agg(F.max(F.col("m") > 2).alias("others"))


def _bitmap(ids: DataFrame) -> bytes:
    """Fixed-size bitmap of hashed ids: a prefilter that lets some other rows through, never loses one."""
    words = (ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_BITS)).alias("bit"))
             .selectExpr("cast(bit div 32 as int) as w", "shiftleft(1L, cast(bit % 32 as int)) as b")
             .groupBy("w").agg(F.bit_or("b").alias("b")))
    table = np.zeros(BITMAP_BITS // 32, dtype=np.uint32)
    found = words.toPandas()  # at most BITMAP_BITS / 32 rows
    table[found["w"].to_numpy(dtype=np.int64)] = found["b"].to_numpy(dtype=np.int64).astype(np.uint32)
    return table.tobytes()


def _sets_of(docs: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """``key, items, as_member, as_hub``: one row for each needed class, from its representative's text.

    Rows whose id hashes to the same bit come along as far as the shuffle.  Among them are copies of
    the representative, the more the larger the class; each would repeat all comparisons of its class.
    """
    table = docs.sparkSession.sparkContext.broadcast(_bitmap(needed))

    def run(batches):
        known, given = WordHashes(), set()
        for batch in in_parts(batches):
            bit = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            listed = ((np.frombuffer(table.value, dtype=np.uint32)[bit // 32] >> (bit % 32).astype(np.uint32)) & np.uint32(1)).astype(bool)
            keys, items = [], []
            for text in batch.column(1).take(pa.array(np.flatnonzero(listed))).to_pylist():
                found = shingle_set(text, known, n)
                key = _digest(found)
                if key is None or key in given:
                    continue
                if len(given) >= REMEMBER:
                    given.clear()
                given.add(key)
                keys.append(key)
                items.append(_packed(found))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(items, pa.binary())], names=["key", "items"])

    hashed = docs.withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_BITS)))
    found = hashed.mapInArrow(run, "key binary, items binary").dropDuplicates(["key"])
    return found.join(needed.select("key", "as_member", "as_hub"), "key")


def _compare(pairs: DataFrame, sets: DataFrame, scheme: PartEnum, members: bool) -> DataFrame:
    """Exact comparison of pairs of classes ``x, p`` (their digests: ``xk, pk``): ``x, p, linked``.

    With ``members`` the pairs are (member, hub, others) and the result has also
    ``near`` (x links to p, or a third set may link to both and there are
    others), ``n_x`` (size of x), ``d_x`` (size of the difference of x and p),
    ``diff`` (the difference, if x is near), ``elements`` (if there are others
    and x does not link: the prefix of x, of which every set that links with x
    holds one) and ``parity``, two longs of 128 parity bits of x: they differ
    in no more bits than two sets in elements.
    """
    left = (sets.filter("as_member") if members else sets).select(F.col("key").alias("xk"), F.col("items").alias("xi"))
    right = (sets.filter("as_hub") if members else sets).select(F.col("key").alias("pk"), F.col("items").alias("pi"))
    carried = ["others"] if members else []
    both = pairs.select("x", "p", "xk", "pk", *carried).join(left, "xk").join(right, "pk").select("x", "p", "xi", "pi", *carried)
    num, den = scheme.num, scheme.den

    def batch_fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        linked, near, elements, own, apart, diffs, parities = [], [], [], [], [], [], []
        others = batch.column(4).to_pylist() if members else [False] * batch.num_rows
        for xi, pi, more in zip(batch.column(2), batch.column(3), others):
            a, p = _unpacked(xi), _unpacked(pi)
            extra = np.setdiff1d(a, p, assume_unique=True)
            inter = len(a) - len(extra)
            link = den * inter >= num * (len(a) + len(p) - inter)
            linked.append(bool(link))
            if not members:
                continue
            missing = np.setdiff1d(p, a, assume_unique=True)
            distance = len(extra) + len(missing)
            close = link or bool(more) and distance <= scheme.reach(len(a), len(p))
            near.append(bool(close))
            if link or not more:
                elements.append(np.empty(0, dtype=np.int64))
            else:
                prefix = len(a) - (num * len(a) + den - 1) // den + 1
                ordered = np.concatenate([extra, np.setdiff1d(a, extra, assume_unique=True)])  # both in the order of the hashes
                elements.append(_longs(ordered[:prefix]))
            diffs.append(_packed(np.concatenate([extra, missing])) if close else None)
            own.append(len(a))
            apart.append(distance)
            odd = np.bincount((a & np.uint64(127)).astype(np.int64), minlength=128) & 1
            parities.append(np.packbits(odd.astype(bool), bitorder="little").view(np.int64))
        columns = [batch.column(0), batch.column(1), pa.array(linked, pa.bool_())]
        names = ["x", "p", "linked"]
        if members:
            columns += [pa.array(near, pa.bool_()), _lists(elements), *(pa.array(v, pa.int32()) for v in (own, apart)),
                        pa.array(diffs, pa.binary()), _lists(parities)]
            names += ["near", "elements", "n_x", "d_x", "diff", "parity"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = "x long, p long, linked boolean"
    if members:
        schema += ", near boolean, elements array<long>, n_x int, d_x int, diff binary, parity array<long>"
    return map_rows(both, batch_fn, schema)


def _remaining_pairs(compared: DataFrame, scheme: PartEnum) -> DataFrame:
    """Pairs of one hub's members that may link although they are not both near the hub.

    At the first common element, at places i, j of the two ordered sets, at most
    min(n_x - i, n_y - j) elements are common; a link needs the share
    num / (num + den) of both sizes.
    """
    num, den = scheme.num, scheme.den
    # Narrow rows: hub and element as one hash, place and distance in one number.
    spread = compared.filter("not linked").select("x", "p", "near", F.col("n_x").cast("long").alias("n"), "d_x", F.col("parity")[0].alias("s"),
                             F.col("parity")[1].alias("t"), F.posexplode("elements").alias("pos", "e"))
    spread = spread.select("x", F.xxhash64("p", "e").alias("pe"), "n", "s", "t", "near",
                           (F.shiftleft(F.col("pos").cast("long"), 32) + F.col("d_x")).alias("at"))
    own = spread.filter("not near").drop("near")
    other = spread.select("pe", "near", *[F.col(c).alias(f"{c}_y") for c in ("x", "n", "s", "t", "at")])
    place, apart = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1)))
    both = F.col("n") + F.col("n_y")
    within = F.expr(f"((n + n_y) * {den - num}) div {den + num}")
    bits = F.bit_count(F.col("s").bitwiseXOR(F.col("s_y"))) + F.bit_count(F.col("t").bitwiseXOR(F.col("t_y")))
    met = own.join(other, (own["pe"] == other["pe"])
                   & F.when(F.col("near"), F.col("x") != F.col("x_y")).otherwise(F.col("x") < F.col("x_y"))
                   & (den * F.least("n", "n_y") >= num * F.greatest("n", "n_y")) & (bits <= within)
                   & (F.abs(apart("at") - apart("at_y")) <= within)  # distances to the hub
                   & ((den + num) * F.least(F.col("n") - place("at"), F.col("n_y") - place("at_y")) >= num * both))
    met = met.withColumnRenamed("x_y", "y")
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("p")).distinct()


class _Lists(NamedTuple):
    """Lists of numbers: all values, and where each list begins (and the last one ends)."""

    values: np.ndarray
    starts: np.ndarray

    def cut(self, first: int, end: int) -> _Lists:
        return _Lists(self.values[self.starts[first]:self.starts[end]], self.starts[first:end + 1] - self.starts[first])

    def rows(self) -> np.ndarray:
        """The number of the list that each value stands in."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def joined(self, other: _Lists) -> _Lists:
        return _Lists(np.concatenate([self.values, other.values]), np.concatenate([self.starts, other.starts[1:] + self.starts[-1]]))


class _Members(NamedTuple):
    """Members of a hub, by block: number, whether linked to the hub, size, distance to the hub, difference, hubs."""

    block: np.ndarray
    x: np.ndarray
    linked: np.ndarray
    size: np.ndarray
    apart: np.ndarray
    diff: _Lists
    hubs: _Lists

    def cut(self, first: int, end: int) -> _Members:
        return _Members(*(c.cut(first, end) if isinstance(c, _Lists) else c[first:end] for c in self))

    def joined(self, other: _Members) -> _Members:
        return _Members(*(c.joined(o) if isinstance(c, _Lists) else np.concatenate([c, o]) for c, o in zip(self, other)))


def _members_of(batch: pa.RecordBatch) -> _Members:
    column = lambda name: batch.column(batch.schema.get_field_index(name))
    numbers = {name: column(name).to_numpy(zero_copy_only=False) for name in ("block", "x", "linked", "n_x", "d_x")}
    raw = column("diff").to_pylist()
    diff = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 6) @ _PLACES
    starts = np.cumsum([0, *map(len, raw)]) // 6
    hubs = column("hubs") if "hubs" in batch.schema.names else pa.array([[]] * batch.num_rows, pa.list_(pa.int64()))
    return _Members(numbers["block"], numbers["x"], numbers["linked"].astype(bool), numbers["n_x"].astype(np.int64),
                    numbers["d_x"].astype(np.int64), _Lists(diff, starts),
                    _Lists(hubs.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                           np.cumsum([0, *hubs.value_lengths().to_pylist()])))


def _common_values(left: _Lists, right: _Lists) -> np.ndarray:
    """How many values every list on the left has in common with every one on the right."""
    shape = len(left.starts) - 1, len(right.starts) - 1
    common = np.zeros(shape, dtype=np.float32)  # whole numbers below 2 ** 24
    shared = np.intersect1d(left.values, right.values)
    placed = []
    for side in (left, right) if len(shared) else ():
        place = np.minimum(np.searchsorted(shared, side.values), len(shared) - 1)
        hit = shared[place] == side.values
        placed.append((place[hit], side.rows()[hit]))
    for at in range(0, len(shared), VALUES):
        held = []
        for (place, rows), count in zip(placed, shape):
            now = (place >= at) & (place < at + VALUES)
            table = np.zeros((count, min(VALUES, len(shared) - at)), dtype=np.float32)
            table[rows[now], place[now] - at] = 1
            held.append(table)
        common += held[0] @ held[1].T
    return common.astype(np.int64)


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) that connect whatever all links connect, fewer than there are rows and columns."""
    found, rows, columns = [], np.zeros(links.shape[0], dtype=bool), np.zeros(links.shape[1], dtype=bool)
    for first in np.flatnonzero(links.any(axis=1)).tolist():
        waiting = [] if rows[first] else [first]
        rows[first] = True
        while waiting:
            i = waiting.pop()
            for j in np.flatnonzero(links[i] & ~columns).tolist():
                columns[j] = True
                found.append((i, j))
                more = np.flatnonzero(links[:, j] & ~rows).tolist()
                rows[more] = True
                found += [(k, j) for k in more]
                waiting += more
    return found


def _block_links(hub: int, sides: list[_Members], num: int, den: int, counts: bool) -> tuple[np.ndarray, ...]:
    """Links of two blocks of one hub (or, if there is one side, within it): pairs that connect what
    links, as two arrays, and with ``counts`` the members and their links counted here, as two more."""
    left, right = sides[0], sides[-1]
    distance = left.apart[:, None] + right.apart[None, :] - 2 * _common_values(left.diff, right.diff)
    total = left.size[:, None] + right.size[None, :]
    links = den * (total - distance) >= num * (total + distance)
    if len(sides) == 1:
        np.fill_diagonal(links, False)
    # The hub connects those that link to it.
    i, j = np.array(_forest(links & ~(left.linked[:, None] & right.linked[None, :])), dtype=np.int64).reshape(-1, 2).T
    if not counts:
        return left.x[i], right.x[j], np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    # Counted elsewhere: pairs with a smaller hub in common, and links of a member to a hub.
    smaller = []
    for side in sides:
        less = side.hubs.values < hub
        smaller.append(_Lists(side.hubs.values[less], np.concatenate([[0], np.cumsum(less)])[side.hubs.starts]))
    links &= _common_values(smaller[0], smaller[-1]) == 0
    for mine, other, those in ((left, right, links), (right, left, links.T)):
        order = np.argsort(other.x)
        place = order[np.minimum(np.searchsorted(other.x, mine.hubs.values, sorter=order), len(order) - 1)]
        hit = other.x[place] == mine.hubs.values
        those[mine.hubs.rows()[hit], place[hit]] = False
    sums = [links.sum(axis=1), links.sum(axis=0)][:len(sides)]
    return left.x[i], right.x[j], np.concatenate([side.x for side in sides]), np.concatenate(sums)


def _links_of_blocks(batches: Iterator[pa.RecordBatch], num: int, den: int, counts: bool) -> Iterator[pa.RecordBatch]:
    """``a, b`` and ``a, n`` rows of ``_block_links`` from rows in the order of ``p, low, high, block``."""
    key, waiting = None, None

    def ended() -> list[tuple[np.ndarray, ...]]:
        if waiting is None:
            return []
        at = int(np.searchsorted(waiting.block, key[1], side="right"))
        sides = [waiting] if key[1] == key[2] else [waiting.cut(0, at), waiting.cut(at, len(waiting.x))]
        return [_block_links(key[0], sides, num, den, counts)] if all(len(side.x) for side in sides) else []

    def given(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        a, b, key, n = (np.concatenate([np.empty(0, dtype=np.int64), *x]) for x in (zip(*found) if found else [[]] * 4))
        some = n > 0
        key, n = key[some], n[some]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([a, key])), pa.concat_arrays([pa.array(b), pa.nulls(len(n), pa.int64())]),
             pa.concat_arrays([pa.nulls(len(b), pa.int64()), pa.array(n)])], names=["a", "b", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        found, members = [], _members_of(batch)
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for first, end in zip(cuts, cuts[1:]):
            now, part = tuple(keys[:, first].tolist()), members.cut(first, end)
            if now == key:
                waiting = waiting.joined(part)
            else:
                found += ended()
                key, waiting = now, part
        yield given(found)
    yield given(ended())


def _near_hubs(compared: DataFrame) -> DataFrame:
    """``x, hubs``: the hubs that a class is near to, as many at most as a text has signatures."""
    return compared.filter("near").groupBy("x").agg(F.sort_array(F.collect_set("p")).alias("hubs"))


def _near_links(compared: DataFrame, scheme: PartEnum, hubs: DataFrame | None) -> DataFrame:
    """``a, b, n`` of the blocks of near members (``_block_links``); ``hubs`` of a class only if links are counted.

    Without counts only blocks meet of which one's members do not link to the hub.
    """
    num, den, counts = scheme.num, scheme.den, hubs is not None
    near = compared.filter("near").select("x", "p", "linked", "n_x", "d_x", "diff")
    of_hub = near.groupBy("p").agg(F.count_if("linked").alias("l"), F.count_if(~F.col("linked")).alias("u"))
    # Of a hub with few members all are in one block, otherwise those that link to it have blocks of their own.
    few = F.col("l") + F.col("u") <= F.lit(BLOCK)
    blocks = of_hub.filter("l + u > 1" if counts else "l + u > 1 and u > 0").select(
        "p", *(F.when(few, F.lit(of_few)).otherwise(F.ceil(F.col(c) / F.lit(BLOCK))).cast("int").alias(name)
               for c, name, of_few in (("l", "n_linked", 0), ("u", "n_other", 1))))
    # The members of one hub are met in as many places as there are salts.
    salted = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = near.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")).join(salted, ["p", "salt"]).drop("salt")
    at = lambda n: F.pmod(F.xxhash64(F.lit("block"), "x"), F.greatest(n, F.lit(1))).cast("int")
    dealt = dealt.withColumn("block", F.when(F.col("linked") & (F.col("n_linked") > 0), at(F.col("n_linked"))).otherwise(F.col("n_linked") + at(F.col("n_other"))))
    columns = ["block", "x", "linked", "n_x", "d_x", "diff"]
    if counts:
        dealt, columns = dealt.join(hubs, "x"), [*columns, "hubs"]
    first = F.lit(0) if counts else F.when(F.col("linked"), F.col("n_linked")).otherwise(F.lit(0))
    met = dealt.withColumn("other", F.explode(F.sequence(first, F.col("n_linked") + F.col("n_other") - 1))).select(
        "p", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), *columns)
    # A number of its own, as a task's work is not in the bytes that it reads, by which partitions are put together.
    spread = met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), "p", "low", "high")
    return spread.sortWithinPartitions("p", "low", "high", "block").mapInArrow(
        lambda batches: _links_of_blocks(batches, num, den, counts), "a long, b long, n long")


def _link_counts(compared: DataFrame, inside: DataFrame, rest: DataFrame, hubs: DataFrame) -> DataFrame:
    """``key, n_links``: the number of other classes that a class links with."""
    # A remaining pair that is near a hub in common is counted there.
    direct = compared.filter("linked").select(F.least("x", "p").alias("a"), F.greatest("x", "p").alias("b")).distinct()
    named = (rest.join(direct, ["a", "b"], "left_anti")
             .join(hubs.select(F.col("x").alias("a"), F.col("hubs").alias("of_a")), "a", "left")
             .join(hubs.select(F.col("x").alias("b"), F.col("hubs").alias("of_b")), "b", "left")
             .filter(F.coalesce(~F.arrays_overlap("of_a", "of_b"), F.lit(True))).select("a", "b"))
    single = direct.unionByName(named).select(F.explode(F.array("a", "b")).alias("key"), F.lit(1).cast("long").alias("n"))
    counted = inside.filter("n is not null").select(F.col("a").alias("key"), "n")
    return single.unionByName(counted).groupBy("key").agg(F.sum("n").alias("n_links"))


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS,
                       num: int = NUM, den: int = DEN, counts: bool = True) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for every row of ``docs``.

    ``n_links`` counts all other classes (different sets) that the row's set
    links with; without ``counts`` the column is left out, and its work saved.
    """
    scheme = PartEnum(num, den)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text"))
    sized = materialise(_size_docs(rows, n), "jaccard-sizes")
    # Written with a number of its own, which the steps below call the class by.
    classes = materialise(sized.filter("key is not null").groupBy("key", "route").agg(F.min("doc_id").alias("first_id"))
                          .withColumn("id", F.monotonically_increasing_id()), "jaccard-class-numbers")
    hub_pairs = materialise(_hub_pairs(_signatures(rows, scheme, n)), "jaccard-hubs")
    touched = (hub_pairs.select(F.col("rx").alias("route"), F.lit(1).alias("m"), F.lit(0).alias("h"))
               .unionByName(hub_pairs.select(F.col("rp").alias("route"), F.lit(0).alias("m"), F.lit(1).alias("h")))
               .groupBy("route").agg((F.max("m") == 1).alias("as_member"), (F.max("h") == 1).alias("as_hub")))
    needed = materialise(classes.join(touched, "route").select("key", "id", "route", F.col("first_id").alias("doc_id"), "as_member",
                                                               "as_hub"), "jaccard-needed")
    sets = materialise(_sets_of(rows, needed, n), "jaccard-sets")

    def named(by: str, names: tuple[str, str], pairs: DataFrame) -> DataFrame:
        """Numbers and digests of both sides of pairs that name classes by ``by``."""
        for column, (number, digest) in zip(names, (("x", "xk"), ("p", "pk"))):
            side = needed.select(F.col(by).alias(column), F.col("id").alias(f"_{number}"), F.col("key").alias(digest))
            pairs = pairs.join(side, column)
        return pairs.withColumns({"x": F.col("_x"), "p": F.col("_p")}).filter("x <> p").drop("_x", "_p")

    met = materialise(named("route", ("rx", "rp"), hub_pairs).select("x", "p", "xk", "pk", "others"), "jaccard-pairs")
    compared = materialise(_compare(met, sets, scheme, members=True), "jaccard-compared")
    hubs = materialise(_near_hubs(compared), "jaccard-hubs-of") if counts else None
    inside = materialise(_near_links(compared, scheme, hubs), "jaccard-inside")
    ordered = lambda df: df.select(F.least("x", "p").alias("a"), F.greatest("x", "p").alias("b")).distinct()
    rest = materialise(ordered(_compare(named("id", ("x", "p"), _remaining_pairs(compared, scheme)), sets, scheme, members=False)
                               .filter("linked")), "jaccard-rest")
    links = ordered(compared.filter("linked")).unionByName(rest).unionByName(inside.filter("b is not null").select("a", "b"))
    roots = component_roots(links, "a", "b").select(F.col("node").alias("id"), "root")
    placed = classes.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    names = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = placed.join(names, "root").select("id", "key", "component_id")
    if counts:
        of_class = of_class.join(_link_counts(compared, inside, rest, hubs).withColumnRenamed("key", "id"), "id", "left")
    of_class = materialise(of_class.drop("id"), "jaccard-classes")
    plain = sized.select("doc_id", "n_shingles", "key")
    with_words = plain.filter("key is not null").join(of_class, "key")
    without = plain.filter("key is null").withColumn("component_id", F.col("doc_id"))
    out = ["doc_id", "n_shingles", "component_id"]
    if counts:
        without = without.withColumn("n_links", F.lit(0))
        out.append(F.coalesce(F.col("n_links"), F.lit(0)).cast("long").alias("n_links"))
    return with_words.select(*out).unionByName(without.select(*out))


def keep_one_per_component(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` with one row left of every component, all columns kept.

    The row with the component's smallest id stays; of rows repeating that id
    and text, one.  Rows without words and rows with a null id stay.
    """
    found = jaccard_components(docs, id_col=id_col, text_col=text_col, counts=False, **options)
    # Only ids that lose, or stand in several rows, take part in the join with the documents.
    fate = (found.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id")
            .agg(F.min((F.col("doc_id") != F.col("component_id")).cast("int")).alias("gone"), F.count(F.lit(1)).alias("n"))
            .filter("gone = 1 or n > 1").select("doc_id", (F.col("gone") == 1).alias("_gone")))
    fate = materialise(fate, "jaccard-fate")
    table = docs.sparkSession.sparkContext.broadcast(_bitmap(fate))

    @F.pandas_udf("boolean")
    def listed(bit: pd.Series) -> pd.Series:
        at = bit.to_numpy(dtype=np.int64)
        words = np.frombuffer(table.value, dtype=np.uint32)
        return pd.Series(((words[at // 32] >> (at % 32).astype(np.uint32)) & np.uint32(1)).astype(bool))

    # Most rows are in no list: the bitmap lets them past the join.
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    marked = rows.withColumn("_listed", listed(F.pmod(F.xxhash64("_doc"), F.lit(BITMAP_BITS))))
    ids = fate.withColumnRenamed("doc_id", "_id")
    met = marked.filter("_listed").join(ids, F.col("_doc") == F.col("_id"), "left")
    single = marked.filter("not _listed").select("_row").unionByName(met.filter(F.col("_id").isNull()).select("_row"))
    repeated = met.filter(~F.col("_gone")).dropDuplicates(["_doc", "_text"]).select("_row")
    return single.unionByName(repeated).select("_row.*")
