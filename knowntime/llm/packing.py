"""Best-fit packing of token sequences in bulk-synchronous rounds.

Texts become pieces of at most ``capacity`` tokens, which one range sort puts in
order, longest first, each with its rank. Gaps of sequences are kept in order too,
widest first, each with its position. A round takes the pieces of one band of
lengths, from ``capacity`` down by a factor of ``STEP``:

1. a successor sweep goes down the lengths of the band. A length takes the smallest
   gap that holds it, as often as it fits, then the next one, and a new sequence only
   where no gap is left. As lengths and widths are whole numbers up to ``capacity``,
   it moves whole runs of equal gaps: it needs only how many there are of each;
2. tasks sweep their sorted pieces against these runs: ranks within a run decide
   which piece takes which gap, and a join by position brings the two together;
3. tasks take the placed pieces off their gaps and give the gaps their positions in
   the new order, for the next round.

The result is that of sequential best fit over falling lengths. Only counts by length
(``capacity`` of them at most) and by range reach the driver; pieces, gaps and
matches stay in the shared folder.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowntime.llm._shared import release, small_batches, stash
from knowntime.llm.pretokens import word_ids

END_ID = 1
STEP = 8
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """documents -> (doc_id, piece, start, length, ids_crc32); a null text is only its end."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = word_ids(path), END_ID.to_bytes(4, "little")
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = (encode(text) if text else b"") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(cut, PIECE)


class Order:
    """Ranks of range-sorted rows: rows of earlier ranges, then the place in the own one."""

    def __init__(self, counts: list[tuple[int, int, int]]):
        """``counts``: (range, length, rows) of a table sorted by falling length."""
        counts = sorted(counts, key=lambda c: (c[0], -c[1]))
        self.ranges = np.array(sorted({c[0] for c in counts}), np.int64)
        before = np.cumsum([0, *(c[2] for c in counts)])
        self.before = before[np.searchsorted([c[0] for c in counts], self.ranges)]
        self.lengths: dict[int, list[int]] = {}  # length -> first rank, rows
        for first, (_, length, n) in zip(before.tolist(), counts):
            self.lengths.setdefault(length, [first, 0])[1] += n

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Ranks of ``monotonically_increasing_id`` values: range and row within it."""
        return self.before[np.searchsorted(self.ranges, place >> 33)] + (place & ((1 << 33) - 1))


class Runs:
    """Runs of equally wide gaps, told by their positions at the start of a round."""

    def __init__(self, gaps: dict[int, int]):
        """``gaps``: number of gaps by width; the widest have the first positions."""
        self.by_width: dict[int, list[tuple[int, int]]] = {}
        self.widths: list[int] = []
        self.total = 0
        for width in sorted(gaps, reverse=True):
            self.put(width, self.total, self.total + gaps[width])
            self.total += gaps[width]

    def put(self, width: int, low: int, high: int) -> None:
        if low == high:
            return
        if width not in self.by_width:
            self.by_width[width] = []
            insort(self.widths, width)
        self.by_width[width].append((low, high))

    def take(self, least: int, capacity: int, fresh: int) -> tuple[int, int, int]:
        """The first run of the smallest width that holds ``least``; else ``fresh`` new sequences."""
        at = bisect_left(self.widths, least)
        if at == len(self.widths):
            self.put(capacity, self.total, self.total + fresh)
            self.total += fresh
        width = self.widths[at]
        low, high = self.by_width[width].pop()
        if not self.by_width[width]:
            del self.by_width[width]
            self.widths.pop(at)
        return width, low, high

    def order(self) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
        """(ends of the old runs, what to add for the new position or -1 where the gap is
        filled, number of gaps by width), old runs in order."""
        first, at, gaps = {}, 0, {}
        for width in reversed(self.widths):
            for low, high in sorted(self.by_width[width]):
                first[low, high] = at if width else None
                if width:
                    at += high - low
                    gaps[width] = gaps.get(width, 0) + high - low
        runs = sorted(first)
        return np.array([h for _, h in runs], np.int64), np.array([-1 if first[r] is None else first[r] - r[0] + self.total for r in runs], np.int64), gaps


def sweep(lengths: list[tuple[int, int, int]], runs: Runs, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces), longest first -> (first rank, pieces a gap, first position,
    offset, length) of each run of matches, in the order of ranks; ``runs`` is kept up."""
    routes = []
    for length, rank, n in lengths:
        while n:
            width, low, high = runs.take(length, capacity, -(-n // (capacity // length)))
            each = min(width // length, n)
            gaps = min(high - low, n // each)
            routes.append((rank, each, low, capacity - width, length))
            runs.put(width - each * length, low, low + gaps)
            runs.put(width, low + gaps, high)
            rank, n = rank + gaps * each, n - gaps * each
    return routes


def _matched(pieces: DataFrame, order: Order, routes: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Each piece with the position of its gap and its offset."""
    first, each, position, offset, length = np.array(routes, np.int64).T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank = order.rank(batch.pop("place").to_numpy())
            r = np.searchsorted(first, rank, "right") - 1
            gap, nth = np.divmod(rank - first[r], each[r])
            yield batch.assign(position=position[r] + gap, offset=offset[r] + nth * length[r])

    return pieces.mapInPandas(run, f"{PIECE}, position long, offset long")


def _moved(gaps: DataFrame, ends: np.ndarray, shift: np.ndarray, total: int) -> DataFrame:
    """Gaps that are left, at their positions in the new order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            by = shift[np.searchsorted(ends, batch["position"].to_numpy(), "right")]
            yield batch.assign(position=batch["position"] + by - total)[by >= 0]

    return gaps.mapInPandas(run, "position long, sequence_id long")


def best_fit(pieces: DataFrame, capacity: int, step: int = STEP) -> DataFrame:
    """Pieces of 1 to ``capacity`` tokens -> the same rows with sequence_id and offset."""
    spark = pieces.sparkSession
    by_length = [F.desc("length"), F.asc("id")]
    ordered = pieces.repartitionByRange(*by_length).sortWithinPartitions(*by_length).drop("id")
    ordered = stash(ordered.withColumn("place", F.monotonically_increasing_id()))
    order = Order([tuple(r) for r in ordered.groupBy(F.shiftright("place", 33), "length").count().collect()])
    bands = [capacity]
    while bands[-1]:
        bands.append(bands[-1] // step)
    gaps, widths, opened, placed = None, {}, 0, []
    for high, low in pairwise(bands):
        lengths = [(s, *order.lengths[s]) for s in range(high, low, -1) if s in order.lengths]
        if not lengths:
            continue
        runs = Runs(widths)
        had = runs.total
        routes = sweep(lengths, runs, capacity)
        new = spark.range(had, runs.total).select(F.col("id").alias("position"), (F.col("id") - had + opened).alias("sequence_id"))
        gaps = new if gaps is None else gaps.unionByName(new)
        opened += runs.total - had
        band = ordered.where((F.col("length") <= high) & (F.col("length") > low))
        placed.append(_matched(band, order, routes).join(gaps, "position").drop("position"))
        ends, shift, widths = runs.order()
        gaps = stash(_moved(gaps, ends, shift, runs.total))
    if not placed:
        return ordered.drop("place").select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096) -> DataFrame:
    """documents -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row per piece.

    ``path`` names the tokenizer's file. Texts longer than ``capacity`` tokens (their
    end included) are cut, others never. Null and empty texts are one end token.
    Rows with equal or null doc_id are packed each for itself. Gaps lie at the end of
    sequences only.
    """
    pieces = stash(token_pieces(docs, path, capacity).withColumn("id", F.monotonically_increasing_id()))
    out = best_fit(pieces, capacity)
    release(pieces)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
