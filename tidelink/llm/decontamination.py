"""Benchmark decontamination by pigeonhole edit matching.

Texts are normalised (lower case; every run of other characters than letters
and digits becomes one space).  An item of m normalised characters may occur
in a document with at most ``k = floor(m * error_rate)`` edits.  Cut into
k + 1 pieces, at least one piece of such an occurrence is unchanged, so all
exact piece hits (one Aho-Corasick pass over the whole document) locate all
candidates; each candidate window is verified with Myers' bit-parallel
distance, run on the window only.

An item of under ``SHORT_ITEM`` normalised characters may occur inside other
words by chance: it is found without edits and between word borders only.

The benchmark is the small side: slices of at most ``MAX_BENCH_BYTES`` (an item
is never cut) pass through the driver one after the other, each broadcast and
matched against all documents.
Documents are never shuffled or collected; texts are read whole.

Defined results: null and empty texts and items match nothing, nor do items
without letters and digits; a document holding an item several times gives one row with the
best occurrence (ties: the earliest); repeated rows of documents give repeated
rows; repeated items each count; empty tables give an empty result; extra
columns are ignored, whatever their names; ids are of any type.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidelink.llm.common import in_parts

ERROR_RATE = 0.05
SHORT_ITEM = 30
MAX_BENCH_BYTES = 8 << 20
_OTHER = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def edits_of(item: str, error_rate: float) -> int:
    """Edits that a normalised item may occur with."""
    return int(len(item) * error_rate) if len(item) >= SHORT_ITEM else 0


def pieces_of(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 contiguous pieces (start, piece) that cover the item."""
    cuts = [len(item) * j // (k + 1) for j in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers_best(pattern_masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Smallest edit distance of the pattern to any substring of ``text`` and the (first) end of it.

    Myers' recurrence on Python integers used as m-bit vectors; the search
    form, in which an occurrence may start anywhere.
    """
    full = (1 << m) - 1
    top = 1 << (m - 1)
    pv, mv, dist = full, 0, m
    best, best_end = m, 0
    get = pattern_masks.get
    for end, ch in enumerate(text, 1):
        eq = get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            dist += 1
        elif mh & top:
            dist -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if dist < best:
            best, best_end = dist, end
    return best, best_end


class Matcher:
    """Automaton over the pieces of one slice of benchmark items."""

    def __init__(self, items: Iterable[tuple[int, str]], error_rate: float = ERROR_RATE):
        self.items: list[tuple[object, str, int, dict[str, int]]] = []
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            norm = normalise(text)
            if not norm:
                continue
            k = edits_of(norm, error_rate)
            masks: dict[str, int] = {}
            for i, ch in enumerate(norm):
                masks[ch] = masks.get(ch, 0) | 1 << i
            number = len(self.items)
            self.items.append((item_id, norm, k, masks))
            for start, piece in pieces_of(norm, k):
                by_piece.setdefault(piece, []).append((number, start))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in by_piece.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if by_piece:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[object, int, int, int]]:
        """``item_id, distance, start, end`` (in the normalised text) of every matched item."""
        norm = normalise(text)
        if not norm or not self.items:
            return []
        starts: dict[int, set[int]] = {}
        for last, (length, uses) in self.automaton.iter(norm):
            for number, at in uses:
                starts.setdefault(number, set()).add(last + 1 - length - at)
        found = []
        for number, where in sorted(starts.items()):
            item_id, item, k, masks = self.items[number]
            best = None
            if len(item) < SHORT_ITEM:  # the piece is the item: only its borders are left to check
                around = " " + norm + " "
                first = min((s for s in where if around[s] == around[s + len(item) + 1] == " "), default=None)
                if first is not None:
                    found.append((item_id, 0, first, first + len(item)))
                continue
            for begin, end in self._windows(sorted(where), len(item), k, len(norm)):
                exact = norm.find(item, begin, end)
                if exact >= 0:
                    best = (0, exact, exact + len(item))
                    break
                dist, stop = myers_best(masks, len(item), norm[begin:end])
                if dist <= k and (best is None or dist < best[0]):
                    best = (dist, max(0, begin + stop - len(item)), begin + stop)
            if best:
                found.append((item_id, *best))
        return found

    @staticmethod
    def _windows(starts: list[int], m: int, k: int, n: int) -> list[tuple[int, int]]:
        """Joined windows in which occurrences beginning near ``starts`` lie."""
        out: list[list[int]] = []
        for s in starts:
            begin, end = max(0, s - 2 * k), min(n, s + m + 2 * k)
            if out and begin <= out[-1][1] - m:
                out[-1][1] = max(end, out[-1][1])
            else:
                out.append([begin, end])
        return [(a, b) for a, b in out]


def _slices(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """Benchmark items in slices of at most ``MAX_BENCH_BYTES`` (an item is never cut), one at a time.

    Partitions of the sorted items are fetched as they are reached, and a slice is
    let go when it has been sent out: the driver never holds the whole benchmark.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).filter(
        "text is not null")
    part: list[tuple[object, str]] = []
    room = MAX_BENCH_BYTES
    for row in items.orderBy("item_id", "text").toLocalIterator():
        size = len(row["text"].encode("utf-8", "surrogatepass"))
        if part and size > room:
            yield part
            part, room = [], MAX_BENCH_BYTES
        part.append((row["item_id"], row["text"]))
        room -= size
    if part:
        yield part


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text: str = "text", error_rate: float = ERROR_RATE) -> DataFrame:
    """``doc_id, item_id, distance, max_distance, start, end`` for each matched (document, item).

    Spans are offsets in the normalised text.  Clean documents give no row.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    doc_kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = (f"doc_id {doc_kind}, item_id {item_kind}, distance int, max_distance int, "
              "`start` int, `end` int")
    parts = [_match_slice(rows, part, item_type, schema, error_rate) for part in _slices(benchmark, item_col, item_text)]
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _match_slice(rows: DataFrame, items: list[tuple[object, str]], item_type: pa.DataType, schema: str,
                 error_rate: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        matcher = Matcher(shared.value, error_rate)
        budget = {item_id: k for item_id, _, k, _ in matcher.items}
        for batch in in_parts(batches):
            at, items_, dist, most, start, end = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for item_id, d, a, b in matcher.find(text):
                    at.append(i)
                    items_.append(item_id)
                    dist.append(d)
                    most.append(budget[item_id])
                    start.append(a)
                    end.append(b)
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(items_, item_type), *(pa.array(v, pa.int32()) for v in (dist, most, start, end))],
                names=["doc_id", "item_id", "distance", "max_distance", "start", "end"])

    return rows.mapInArrow(run, schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns kept."""
    kept = docs
    for part in _slices(benchmark, "item_id", "text"):
        leaked = _leak_test(docs.sparkSession.sparkContext.broadcast(part), error_rate)
        kept = kept.filter(~leaked(F.col("text").cast("string")))
    return kept


def _leak_test(shared, error_rate: float):
    built: list[Matcher] = []

    @F.arrow_udf("boolean")
    def leaked(texts: pa.Array) -> pa.Array:
        if not built:
            built.append(Matcher(shared.value, error_rate))
        return pa.array([bool(built[0].find(t.as_py())) for t in texts], pa.bool_())

    return leaked
