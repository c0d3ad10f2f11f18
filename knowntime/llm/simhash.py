"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints within ``radius`` bits of each other agree on at least one of
``radius + 1`` bit blocks, so rows are dealt out by (block, value). A group of
more than ``group_limit`` fingerprints is dealt again by blocks of its remaining
bits, which loses no pair: distinct fingerprints run out of bits long before a
group can stay large, hence no task ever holds more than ``group_limit`` rows of
a group and nothing is capped.

Within a group the fingerprints lie in Gray order, so neighbours share bits.
Runs of ``FANOUT`` nodes get a parent holding the bits they share (a mask and a
pattern); a search compares whole nodes first, and drops every pair of groups
whose shared bits already differ in more than ``radius`` places. Links found are
reduced to a spanning star per local component, so output is linear in rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowntime.llm._shared import connected_components, small_batches, stash

FANOUT = 8
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Hashes of the runs of ``words`` words, repeats included; a shorter text is one run."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    size = min(words, len(tokens))
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = (ends - [len(t) + 1 for t in tokens])[: len(tokens) - size + 1].tolist()
    ends = (ends[size - 1 :] - 1).tolist()
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends)), np.uint64, len(starts))


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text; 0 for null and for texts without words."""
    return fingerprint_of(shingle_hashes(text, words))


def fingerprint_of(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of shingle hashes, repeats included; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].byteswap().view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """documents -> (doc_id, fp): one signed long per row, null texts like empty ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t, words) for t in batch["text"]), np.uint64, len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fp.view(np.int64)})

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, fp long")


def blocks(mask: int, parts: int) -> list[int]:
    """``mask`` extended by each of ``parts`` even runs of the bits it leaves free."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in run.tolist()) for run in np.array_split(free, parts) if len(run)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _deal(rows: DataFrame, parts: int) -> DataFrame:
    """Each (id, fp, mask) row once for every block that extends its mask."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for mask, group in batch.groupby("mask"):
                for wider in blocks(int(mask) & int(ALL), parts):
                    yield group.assign(mask=_signed(wider))

    dealt = rows.select("id", "fp", "mask").mapInPandas(run, "id long, fp long, mask long")
    return dealt.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))


def _gray_rank(fp):
    """Position of a code in Gray order (the inverse of n ^ n >> 1)."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


class _Levels:
    """The index over all groups of a batch, leaves first; one root per group."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        self.levels = [(fp, np.full(len(fp), ALL), None, None)]
        while True:
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            within = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
            if len(first) == len(group):
                break
            starts = np.flatnonzero(within % FANOUT == 0)
            counts = np.diff(np.r_[starts, len(group)])
            pattern, mask = self.levels[-1][:2]
            lead = np.repeat(pattern[starts], counts)
            shared = ~np.bitwise_or.reduceat((pattern ^ lead) | ~mask, starts)
            self.levels.append((pattern[starts] & shared, shared, starts, counts))
            group = group[starts]
        self.roots = len(group)


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the classes of the linked leaves; labels are smallest leaf numbers."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        np.minimum.at(label, np.maximum(la, lb)[differ], np.minimum(la, lb)[differ])
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def local_links(group: np.ndarray, fp: np.ndarray, radius: int, chunk: int = 1 << 18) -> np.ndarray:
    """Labels of the components of each group; rows sorted by group, then Gray rank.

    Two nodes are compared on the bits that both share with all their leaves; a
    pair of nodes that differs too much, or whose leaves are in one component
    already, is dropped with everything below it.
    """
    index, label = _Levels(group, fp), np.arange(len(fp))
    top = len(index.levels) - 1
    work = [(top, np.arange(index.roots), np.arange(index.roots))]
    while work:
        level, a, b = work.pop()
        if level == 0:
            label = _settle(label, a, b)
            continue
        _, _, first, count = index.levels[level]
        pairs = count[a] * count[b]
        if pairs.sum() > chunk and len(a) > 1:
            half = len(a) // 2
            work += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
            continue
        which = np.repeat(np.arange(len(a)), pairs)
        at = np.arange(len(which)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        width = count[b][which]
        ca, cb = first[a][which] + at // width, first[b][which] + at % width
        below = level - 1
        keep = (ca < cb) if below == 0 else (ca <= cb)
        ca, cb = ca[keep], cb[keep]
        pattern, mask = index.levels[below][:2]
        keep = np.bitwise_count((pattern[ca] ^ pattern[cb]) & mask[ca] & mask[cb]) <= radius
        ca, cb = ca[keep], cb[keep]
        if below == 0 and len(ca):
            apart = label[ca] != label[cb]
            ca, cb = ca[apart], cb[apart]
        elif len(ca) > 4096:
            low, high = label, label
            for at_level in range(1, below + 1):
                starts = index.levels[at_level][2]
                low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            settled = (low[ca] == high[cb]) & (high[ca] == low[cb]) & (low[ca] == high[ca])
            ca, cb = ca[~settled], cb[~settled]
        if len(ca):
            work.append((below, ca, cb))
    return label


def near_links(classes: DataFrame, radius: int = 3, group_limit: int = 2048) -> DataFrame:
    """(id, fp), fp distinct -> (a, b): enough links within ``radius`` bits to connect
    everything that such links connect. ``group_limit`` bounds a task's group; groups of
    fingerprints that differ in ``radius`` bits or fewer can't be split below 2 ** radius."""
    if group_limit < 1 << radius:
        raise ValueError("group_limit must be 2 ** radius at least")
    parts = radius + 1
    rows = _deal(classes.select("id", "fp", F.lit(0).cast("long").alias("mask")), parts)
    settled: DataFrame | None = None
    while True:
        hot = stash(rows.groupBy("mask", "value").count().where(F.col("count") > group_limit).select("mask", "value"))
        if hot.isEmpty():
            settled = rows if settled is None else settled.unionByName(rows)
            break
        cold = rows.join(hot, ["mask", "value"], "left_anti").select("id", "fp", "mask", "value")
        settled = cold if settled is None else settled.unionByName(cold)
        rows = _deal(stash(rows.join(hot, ["mask", "value"], "left_semi").select("id", "fp", "mask")), parts)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def links(part: pd.DataFrame) -> pd.DataFrame:
            change = (part["mask"].to_numpy()[1:] != part["mask"].to_numpy()[:-1]) | (part["value"].to_numpy()[1:] != part["value"].to_numpy()[:-1])
            group = np.cumsum(np.r_[0, change])
            many = np.bincount(group)[group] > 1
            group, ids, fp = group[many], part["id"].to_numpy()[many], part["fp"].to_numpy()[many].view(np.uint64)
            if not len(ids):
                return pd.DataFrame({"a": ids, "b": ids})
            label = local_links(group, fp, radius)
            linked = label != np.arange(len(label))
            return pd.DataFrame({"a": ids[linked], "b": ids[label[linked]]})

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= 60_000:
                part = pd.concat(held, ignore_index=True)
                last = part.iloc[-1]
                open_group = ((part["mask"] == last["mask"]) & (part["value"] == last["value"])).to_numpy()
                if not open_group.all():
                    yield links(part[~open_group].reset_index(drop=True))
                    part = part[open_group]
                held, n = [part], len(part)
        if n:
            yield links(pd.concat(held, ignore_index=True))

    return (
        settled.repartition("mask", "value")
        .withColumn("rank", _gray_rank(F.col("fp")))
        .sortWithinPartitions("mask", "value", "rank")
        .select("id", "fp", "mask", "value")
        .mapInPandas(search, "a long, b long")
    )


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, group_limit: int = 2048) -> DataFrame:
    """documents -> (doc_id, fingerprint, component_id), a row for each row.

    Equal fingerprints are one class, and classes are what the index links, so a
    group of copies of any size is one row there. Texts that are null or without
    words have fingerprint zero and are linked like any other. A null doc_id keeps
    its row, and its class links others; a component of null ids alone has no id.
    """
    fps = stash(fingerprints(docs, words))
    classes = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("id")))
    links = near_links(classes.select(F.col("fp").alias("id"), "fp"), radius, group_limit)
    comps = connected_components(links)
    placed = stash(classes.join(comps, classes["fp"] == comps["node"], "left").select("fp", "id", F.coalesce("component", "fp").alias("component")))
    first = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    owner = stash(placed.join(first, "component").select("fp", "component_id"))
    return fps.join(owner, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
