"""Best-fit packing with bound-certified repacking.

A document's token ids (word BPE, then the end id) are cut into pieces of at
most ``CAPACITY`` tokens; only longer documents are cut, and all their pieces
but the last are full.  Full pieces are sequences of their own.  The rest are
dealt to partitions and packed by best-fit decreasing.  Dual-feasible
functions give a lower bound of every partition's bin count; a partition that
meets its bound is certified and done.  Partitions with a gap exchange their
pieces (they are dealt anew among themselves) and are packed again, until all
are certified, the bins in use meet the bound of all open pieces together, or
a round brings no gain.

Only (length, row) pairs are packed: token ids stay with the tokenising scan.
Piece lengths are dealt out by a hash that includes a per-row salt, so a
repeated id does not gather in one partition.  One partition holds about
``TARGET_PIECES`` pieces.

Defined results: a null or empty text is one piece holding only the end id;
repeated rows are documents of their own; an empty table packs into nothing;
extra columns are ignored.  ``sequence_id`` values are unique, not dense.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from tidelink.llm.common import in_parts, materialise, text_bytes

CAPACITY = 2048
END_ID = 0
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
TARGET_PIECES = 20_000
MAX_ROUNDS = 4
REMEMBER_BYTES = 192 << 20    # token ids of words kept by a worker, unless it is told another bound


class WordIds(dict):
    """Word (bytes without ASCII white space) to its token ids as little-endian uint32.

    The tokenizer drops white space and merges within words only, so the ids
    of a text are those of its words in order.  It also starts a new unit
    between letters and punctuation, so a word's closing punctuation is looked
    up by itself; words of Latin letters need neither normal form nor split.
    """

    CLOSING = b".,!?;:|#$%&*"

    def __init__(self, path: str, remember: int = REMEMBER_BYTES):
        super().__init__()
        self.remember = remember
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.used = 0

    @staticmethod
    def _latin(word: str) -> bool:
        return word.isalpha() and max(word) < "\u0100"

    def words_of(self, text: bytes) -> list[bytes]:
        """Words of a text; lower-cased unless special tokens (which know case) may stand in it."""
        return (text if b"<|" in text else text.lower()).split()

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(self.CLOSING)
        plain = core.decode("utf-8", "replace")
        if not self._latin(plain):
            found = self._bytes(self.tokenizer, word.decode("utf-8", "replace"))
        elif len(core) < len(word):
            found = self[core] + self._bytes(self.tokenizer, word[len(core):].decode())
        else:
            found = self._bytes(self.letters, plain.lower())
        self.used += 160 + len(word) + len(found)
        if self.used > self.remember:
            self.clear()
            self.used = 0
        self[word] = found
        return found

    @staticmethod
    def _bytes(tokenizer: Tokenizer, text: str) -> bytes:
        return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


#: Word ids by tokenizer file and bound, kept by a Python worker from task to task.
_KNOWN: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, remember: int = REMEMBER_BYTES) -> WordIds:
    if (path, remember) not in _KNOWN:
        _KNOWN[path, remember] = WordIds(path, remember)
    return _KNOWN[path, remember]


def token_pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                 end_id: int = END_ID, tokenizer: str = TOKENIZER, remember: int = REMEMBER_BYTES) -> DataFrame:
    """``doc_id, piece, start, length, ids`` (ids: little-endian uint32 bytes) for every piece.

    ``remember`` bounds the bytes of token ids that a worker keeps; it changes no result.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()
    width = 4 * capacity

    def run(batches):
        known = word_ids(tokenizer, remember)
        for batch in in_parts(batches):
            at, piece, ids = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                tokens = b"".join(map(known.__getitem__, known.words_of(text))) + end
                for j in range(0, len(tokens), width):
                    at.append(i)
                    piece.append(j // width)
                    ids.append(tokens[j:j + width])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array([p * capacity for p in piece], pa.int64()),
                 pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, `start` long, length long, ids binary")


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing of these lengths needs."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity) if len(lengths) else 0


def bound_of_counts(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing of ``count[x]`` items of each length x needs: the best of a family of dual-feasible functions.

    For a threshold t <= capacity/2: items over capacity - t count as a whole
    bin, items under t as nothing, the others by their length; and the rounded
    functions that count items by how many of their kind a bin can hold.
    """
    size = np.arange(capacity + 1, dtype=np.int64)
    total = int((count * size).sum())
    best = -(-total // capacity)
    above = np.concatenate([np.cumsum(count[::-1])[::-1], [0]])          # items of at least a size
    mass = np.concatenate([np.cumsum((count * size)[::-1])[::-1], [0]])  # their lengths
    for t in range(1, capacity // 2 + 1):
        whole = above[capacity - t + 1]
        middle = mass[t] - mass[capacity - t + 1]
        best = max(best, int(whole + -(-middle // capacity)))
    for k in range(1, 51):  # u(k): x -> x if x(k+1) is whole, else floor(x(k+1)) / k
        scaled = size * (k + 1)
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)  # in 1/(k * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every item, and the number of bins.

    Open bins are kept by free space, so placing an item looks up the smallest
    space that holds it.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: dict[int, list[int]] = {}
    spaces: list[int] = []
    used = 0
    for i in order.tolist():
        need = int(lengths[i])
        at = bisect_left(spaces, need)
        if at == len(spaces):
            number, space = used, capacity
            used += 1
        else:
            space = spaces[at]
            stack = free[space]
            number = stack.pop()
            if not stack:
                del free[space]
                spaces.pop(at)
        bins[i], offsets[i] = number, capacity - space
        left = space - need
        if left:
            if left not in free:
                insort(spaces, left)
                free[left] = []
            free[left].append(number)
    return bins, offsets, used


def _pack_round(dealt: DataFrame, columns: list[str], capacity: int) -> DataFrame:
    """Pack every partition; adds ``bin, offset, group_bins, group_bound``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        lengths = pdf["length"].to_numpy(dtype=np.int64)
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        return pdf.assign(bin=bins, offset=offsets, group_bins=used, group_bound=lower_bound(lengths, capacity))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    return dealt.groupBy("part").applyInPandas(
        run, schema + ", bin long, offset long, group_bins long, group_bound long").select(
        *columns, "row", "length", "part", "bin", "offset", "group_bins", "group_bound")


def pack_pieces(pieces: DataFrame, *, capacity: int = CAPACITY, target: int = TARGET_PIECES,
                rounds: int = MAX_ROUNDS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of at most ``capacity``.

    Other columns are carried along, so give it digests rather than token ids.
    """
    columns = [c for c in pieces.columns if c != "length"]
    numbered = materialise(pieces.withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    full = numbered.filter(F.col("length") >= capacity)
    open_rows = numbered.filter(F.col("length") < capacity)
    # Full pieces: a sequence each, numbered below zero so that no partition's bin has the same number.
    done = full.withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    out = done.select(*columns, "length", "sequence_id", "offset")
    previous = None
    for turn in range(rounds):
        n = open_rows.count()
        if not n:
            break
        parts = max(1, -(-n // target))
        salted = F.pmod(F.xxhash64(F.lit(turn), "row"), F.lit(parts)).cast("int")
        packed = materialise(_pack_round(open_rows.withColumn("part", salted), columns, capacity),
                             f"packing-round-{turn}")
        groups = packed.groupBy("part").agg(F.first("group_bins").alias("bins"), F.first("group_bound").alias("bound"))
        state = groups.agg(F.sum("bins").alias("bins"), F.sum(F.expr("if(bins = bound, bins, 0)")).alias("certified"),
                           F.count(F.lit(1)).alias("parts")).first()
        number = (F.col("bin") * F.lit(parts) + F.col("part")) * F.lit(rounds) + F.lit(turn)
        placed = packed.withColumn("sequence_id", number)
        gap = F.col("group_bins") > F.col("group_bound")
        still_open = state["bins"] - state["certified"]
        last = turn == rounds - 1 or parts == 1 or not still_open or _meets_bound(packed.filter(gap), still_open, capacity)
        if previous is not None and still_open >= previous[0] and not last:
            last = True  # dealing anew brought nothing
        keep = placed if last else placed.filter(~gap)
        out = out.unionByName(keep.select(*columns, "length", "sequence_id", "offset"))
        if last:
            break
        open_rows = packed.filter(gap).select(*columns, "length", "row")
        previous = (still_open,)
    return out


def _meets_bound(open_rows: DataFrame, bins: int, capacity: int) -> bool:
    """Whether the open partitions' bins already meet the bound of their pieces together.

    The bound needs only how often each length occurs: at most ``capacity`` rows.
    """
    rows = open_rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toPandas()
    count = np.zeros(capacity + 1, dtype=np.int64)
    count[rows["length"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return bins <= bound_of_counts(count, capacity)


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every row."""
    digests = token_pieces(docs, **options).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack_pieces(digests, capacity=options.get("capacity", CAPACITY))


def packed_ids(docs: DataFrame, placed: DataFrame, **options) -> DataFrame:
    """``sequence_id, ids``: the token ids of every packed sequence, in place order.

    ``placed`` is the result of ``pack_documents`` over ``docs`` with unique
    ids.  A sequence holds at most ``capacity`` tokens, so a group is bounded.
    """
    pieces = token_pieces(docs, **options).select("doc_id", "piece", "ids")
    rows = pieces.join(placed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (rows.groupBy("sequence_id").agg(ordered.alias("parts"))
            .select("sequence_id", F.expr("aggregate(parts, X'', (acc, p) -> concat(acc, p.ids))").alias("ids")))
