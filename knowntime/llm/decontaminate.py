"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance.

A test item may differ from a passage by ``budget`` edits (a share of its
length). Cut into budget + 1 pieces, at least one piece of such a passage is
exact, so an Aho-Corasick pass over the text finds every possible place; Myers'
bit-parallel algorithm (the whole item as one machine word of any length) then
gives the least distance of the item to any substring around it.

Benchmark items are the query set: they are dealt into blocks of bounded size,
and each block is searched against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowntime.llm._shared import release, small_batches, stash

#: Characters of items that one pass holds in memory.
BLOCK_CHARS = 4_000_000


def normalised(text: str | None) -> str:
    """Lower case, white space as single spaces."""
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float) -> int:
    """Edits allowed to an item of ``length`` characters; pieces keep 4 characters at least."""
    return max(0, min(int(length * rate), length // 4 - 1))


def pieces(item: str, rate: float) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces of even length that make up the item."""
    n = budget(len(item), rate) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def edit_distance_within(item: str, text: str, most: int) -> tuple[int, int]:
    """(least edit distance of ``item`` to a substring of ``text``, end of the first such), by
    Myers' bit-vectors; distance most + 1 and end -1 if none is within ``most``."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, at = full, 0, m, most + 1, -1
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (~(xh | up) & full), up & xh
        score += bool(plus & high) - bool(minus & high)
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | (~(xv | plus) & full), plus & xv
        if score < best:
            best, at = score, j + 1
            if not best:
                break
    return best, at


class PieceIndex:
    """An automaton over the pieces of one block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, normalised(t)) for i, t in items]
        self.items = [(i, t) for i, t in self.items if t]
        self.rate, places = rate, {}
        for k, (_, text) in enumerate(self.items):
            for offset, piece in pieces(text, rate):
                places.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def search(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item_id, distance, budget, start, end) of each item found, at its best place."""
        if self.empty or not text:
            return []
        begins: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for k, offset in where:
                begins.setdefault(k, set()).add(end + 1 - size - offset)
        found = []
        for k, starts in begins.items():
            item_id, item = self.items[k]
            most, best = budget(len(item), self.rate), None
            reach = 0
            for start in sorted(starts):
                if best and best[0] == 0:
                    break
                exact = text.startswith(item, start) if start >= 0 else False
                if exact:
                    best = (0, start, start + len(item))
                    continue
                if start < reach:  # the window before has covered this diagonal
                    continue
                low = max(0, start - most)
                high = start + len(item) + 2 * most + 1
                reach = start + most + 1
                distance, end = edit_distance_within(item, text[low:high], most)
                if end >= 0 and (best is None or distance < best[0]):
                    size = edit_distance_within(item[::-1], text[low : low + end][::-1], most)[1]  # read backwards, the end is the start
                    best = (distance, low + end - size, low + end)
            if best:
                found.append((item_id, best[0], most, best[1], best[2]))
        return found


def _blocks(benchmark: DataFrame, block_chars: int) -> tuple[int, Iterator[Broadcast]]:
    """Number of blocks, and the items block by block as broadcast lists of (item_id, text),
    ``block_chars`` characters each on average."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    count = -(-size // block_chars) or 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    sc = benchmark.sparkSession.sparkContext
    return count, (sc.broadcast([(r["item_id"], r["text"]) for r in items.where(block == b).collect()]) for b in range(count))


def contaminations(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, budget, start, end): a row for each document and item in it.

    ``distance`` is the least edit distance of the item to the text and ``start``,
    ``end`` its place there, both after normalisation. Null and empty texts and
    items match nothing; repeated rows of documents give repeated rows, equal
    items each their own. A document without a hit has no row. Of several blocks of items one
    is broadcast at a time, and its hits are written before the next.
    """
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = None
    count, blocks = _blocks(benchmark, block_chars)
    for held in blocks:

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            index = PieceIndex(held.value, rate)
            for batch in batches:
                hits = [(d, *hit) for d, t in zip(batch["doc_id"], batch["text"]) for hit in index.search(normalised(t))]
                yield pd.DataFrame(hits, columns=["doc_id", "item_id", "distance", "budget", "start", "end"])

        one = rows.mapInPandas(run, "doc_id long, item_id long, distance int, budget int, start int, end int")
        if count > 1:
            one = stash(one)
            held.destroy()
        found = one if found is None else found.unionByName(one)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """documents without those that hold a test item; columns as given.

    Each block of items filters rows where they lie, so no text is shuffled; of several
    blocks one is broadcast at a time, and what it leaves is written before the next.
    """
    left = docs
    count, blocks = _blocks(benchmark, block_chars)
    for held in blocks:

        def keep(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = PieceIndex(held.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([not index.search(normalised(t)) for t in batch.column("text").to_pylist()], pa.bool_()))

        rest = small_batches(left).mapInArrow(keep, docs.schema)
        if count > 1:
            rest = stash(rest)
            held.destroy()
            if left is not docs:  # what the block before left
                release(left)
        left = rest
    return left
