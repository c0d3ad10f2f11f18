"""Near-copies by SimHash and exact Jaccard similarity of word shingles.

SimHash fingerprints of the shingles are linked within ``RADIUS`` bits by the Gray-order index,
and what such links connect shares a key. It can't reach every pair: at a similarity of 0.8
fingerprints differ in about 10 of 64 bits. So MinHash bands give more keys, and rows that share a
key of either kind are held to the exact similarity. A pair of similarity s agrees on a band of ``ROWS`` minima with probability
s ** ROWS, so it is missed by all ``BANDS`` with (1 - s ** ROWS) ** BANDS: 0.0005 at
0.8, less above. Equal shingle sets are one class and need no key.

Rows that share a key are first compared with a few centres: the row of most company,
which edits of one text have in common, then two others. That connects groups of near-copies
for a few comparisons a row. Rows of a group that are still apart are then compared with each
other, all of them: the group is cut into blocks of bounded size, a task holds two blocks and
gets the intersections of their shingle sets as products of incidence matrices. So no link
between rows that share a key is lost, whatever the group's size; a group whose rows stay
apart costs the square of its rows, in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowntime.llm._shared import connected_components, release, small_batches, stash
from knowntime.llm.simhash import fingerprint_of, near_links, shingle_hashes

BANDS, ROWS = 25, 6
RADIUS = 3  # differing bits of linked fingerprints
BLOCK_BYTES = 1 << 22  # of the sets and keys of a block; a task holds two
TILE_ROWS = 256  # rows of each side whose sets meet in one product
COLUMNS = 1 << 13  # shingles of a product at a time
_random = np.random.default_rng(20)
_FACTOR = _random.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _random.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)


def band_keys(shingles: np.ndarray) -> list[int]:
    """One signed key a band for a set of shingle hashes; none for an empty set."""
    if not len(shingles):
        return []
    low = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(low, (shingles[at : at + 4096] * _FACTOR + _SHIFT).min(1), out=low)
    keys = [xxhash.xxh64_intdigest(low[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _signatures(rows: DataFrame, words: int) -> DataFrame:
    """(row, text) -> (row, set_a, set_b, fp, keys): a 128-bit digest of the shingle set, the shingles'
    SimHash fingerprint, and the set's bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            digests, keys, fps = [], [], []
            for text in batch["text"]:
                hashes = shingle_hashes(text, words)
                found = np.unique(hashes)
                fps.append(fingerprint_of(hashes))
                digests.append(xxhash.xxh128_digest(found.tobytes()))
                keys.append(band_keys(found))
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pd.DataFrame({"row": batch["row"], "set_a": halves[:, 0], "set_b": halves[:, 1], "fp": np.array(fps, np.uint64).view(np.int64), "keys": keys})

    return small_batches(rows).select("row", "text").mapInPandas(run, "row long, set_a long, set_b long, fp long, keys array<long>")


def with_index_key(rows: DataFrame) -> DataFrame:
    """Stored (node, fp, keys) -> (node, keys) with one key more, in front: that of all rows whose
    fingerprints links within ``RADIUS`` bits connect, found by the Gray-order index."""
    links = near_links(rows.select(F.col("fp").alias("id"), "fp").distinct(), RADIUS)
    comps = connected_components(links).withColumnRenamed("node", "fp")
    key = F.xxhash64(F.coalesce("component", "fp"), F.lit("simhash"))
    joined = rows.join(comps.hint("merge"), "fp", "left")  # both sides grow with the table
    return joined.select("node", F.concat(F.array(key), "keys").alias("keys"))


def _verified(pairs: DataFrame, sets: DataFrame, words: int, similarity: float) -> DataFrame:
    """The (a, b) pairs whose texts' shingle sets reach ``similarity``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, left = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for a, text_a, text_b in zip(batch["a"], batch["text_a"], batch["text_b"]):
                if a != last:
                    last, left = a, np.unique(shingle_hashes(text_a, words))
                right = np.unique(shingle_hashes(text_b, words))
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(both >= similarity * (len(left) + len(right) - both) - 1e-9)
            yield batch.loc[keep, ["a", "b"]]

    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(sets.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long")


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``, as matrix products."""
    ids = np.unique(np.concatenate(a))
    ids = ids[np.isin(ids, np.concatenate(b))]
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(ids):
        return out

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row, values = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(ids, values), len(ids) - 1)
        there = ids[at] == values
        return row[there], at[there]

    (row_a, at_a), (row_b, at_b) = places(a), places(b)
    for low in range(0, len(ids), COLUMNS):
        width, parts = min(COLUMNS, len(ids) - low), []
        for n, row, at in ((len(a), row_a, at_a), (len(b), row_b, at_b)):
            inside = (at >= low) & (at < low + width)
            matrix = np.zeros((n, width), np.float32)
            matrix[row[inside], at[inside] - low] = 1
            parts.append(matrix)
        out += parts[0] @ parts[1].T
    return out


class _Side:
    """One block of a tile, by size of the sets."""

    def __init__(self, rows: pd.DataFrame, words: int):
        sets = [np.unique(shingle_hashes(x, words)) for x in rows["text"]]
        size = np.array([len(x) for x in sets], np.int64)
        order = np.argsort(size, kind="stable")
        self.sets, self.size = [sets[i] for i in order], size[order]
        self.node, self.comp = rows["node"].to_numpy()[order], rows["comp"].to_numpy()[order]
        self.keys = np.array(rows["keys"].tolist(), np.int64)[order]


def tile_links(a: _Side, b: _Side, same: bool, key: int, similarity: float, known: dict[int, int]) -> Iterator[tuple[int, int]]:
    """Links between two blocks of the rows of ``key`` that are in different components, enough to
    connect them; a pair counts in the first band that it shares. ``known`` holds what was joined."""

    def root(x: int) -> int:
        while known.get(x, x) != x:
            x = known[x]
        return x

    first_a, first_b = (np.argmax(s.keys == key, axis=1) for s in (a, b))
    for at in range(0, len(a.sets), TILE_ROWS):
        for to in range(at if same else 0, len(b.sets), TILE_ROWS):
            p, q = slice(at, at + TILE_ROWS), slice(to, to + TILE_ROWS)
            if a.size[p][-1] < similarity * b.size[q][0] or b.size[q][-1] < similarity * a.size[p][0]:
                continue
            roots_a, roots_b = (np.array([root(x) for x in s.comp[r].tolist()]) for s, r in ((a, p), (b, q)))
            few, many = np.minimum(a.size[p][:, None], b.size[q]), np.maximum(a.size[p][:, None], b.size[q])
            wanted = (roots_a[:, None] != roots_b) & (few >= similarity * many - 1e-9) & (first_a[p][:, None] == first_b[q])
            for band in range(int(min(first_a[p].max(), first_b[q].max()))):
                wanted &= ~((a.keys[p][:, band, None] == b.keys[q][:, band]) & (band < first_a[p])[:, None])
            if not wanted.any():
                continue
            both = intersections(a.sets[p], b.sets[q]).astype(np.float64)
            good = wanted & (both >= similarity * (a.size[p][:, None] + b.size[q] - both) - 1e-9)
            for i, j in zip(*np.nonzero(good)):
                x, y = root(int(roots_a[i])), root(int(roots_b[j]))
                if x != y:
                    known[max(x, y)] = min(x, y)
                    yield int(a.node[p][i]), int(b.node[q][j])


def _all_links(left: DataFrame, sets: DataFrame, words: int, similarity: float) -> DataFrame:
    """(key, node, comp) -> links between all rows of a key in different components."""
    weight = (F.octet_length("text") * 2 + 400).alias("bytes")  # a text and its shingles' hashes
    blocks = F.greatest(F.lit(1), F.ceil(F.col("total") / BLOCK_BYTES)).cast("int")
    groups = left.join(sets.select("node", weight), "node").groupBy("key").agg(F.sum("bytes").alias("total")).select("key", blocks.alias("blocks"))
    placed = left.join(groups, "key").withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    tiles = F.expr("transform(sequence(0, blocks - 1), j -> struct(least(block, j) as i, greatest(block, j) as j, if(j < block, 1, 0) as side))")
    placed = placed.withColumn("tile", F.explode(tiles)).select("key", "tile.*", "node", "comp").join(sets, "node").select("key", "i", "j", "side", "node", "comp", "keys", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, parts = None, ([], [])

        def close() -> pd.DataFrame:
            sides = [_Side(pd.concat(p, ignore_index=True), words) if p else None for p in parts]
            same = at[1] == at[2]
            other = sides[0] if same else sides[1]
            found = [] if sides[0] is None or other is None else list(tile_links(sides[0], other, same, at[0], similarity, {}))
            return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

        for batch in batches:
            place = batch[["key", "i", "j", "side"]].to_numpy()
            cuts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(1)]) if len(batch) else []
            for x, y in zip(cuts, [*cuts[1:], len(batch)]):
                key, i, j, side = place[x].tolist()
                if (key, i, j) != at:
                    if at is not None:
                        yield close()
                    at, parts = (key, i, j), ([], [])
                parts[side].append(batch.iloc[x:y])
        if at is not None:
            yield close()

    return placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side").mapInPandas(run, "a long, b long")


def similar_links(texts: DataFrame, keyed: DataFrame, words: int, similarity: float) -> DataFrame | None:
    """Stored (row, text) and (node, keys) -> (a, b): links of at least ``similarity`` between rows
    that share a key, enough to connect all that are; None without any candidate."""
    members = keyed.select(F.explode("keys").alias("key"), "node")
    groups = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    live = stash(members.join(groups, "key"))
    company = live.groupBy("node").agg(F.sum("n").alias("company"))
    left = stash(live.join(company, "node").select("key", "node", "company", F.col("node").alias("comp")))
    release(live)
    if left.isEmpty():
        return None
    wanted = keyed.join(left.select("node").distinct(), "node", "left_semi").hint("merge")  # both sides grow with the table
    sets = stash(texts.withColumnRenamed("row", "node").join(wanted, "node"))
    links: DataFrame | None = None
    for most in (1, 2, 0):
        apart = left.groupBy("key").agg(F.count("*").alias("rows"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.max_by("node", F.struct("company", "node")).alias("first")).where("low < high")
        left = stash(left.join(apart.drop("low", "high"), "key"))
        if left.isEmpty():
            break
        if most == 0:
            found = stash(_all_links(left.select("key", "node", "comp"), sets, words, similarity))
        else:
            chosen = F.col("node") == F.col("first") if most == 1 else F.pmod(F.xxhash64("node", F.lit(most)), F.col("rows")) < most
            marked = left.withColumn("centre", chosen)
            centres = marked.where("centre").select("key", F.col("node").alias("c"), F.col("comp").alias("c_comp"))
            pairs = centres.join(marked, "key").where("comp <> c_comp and (not centre or c < node)")
            pairs = stash(pairs.select(F.least("c", "node").alias("a"), F.greatest("c", "node").alias("b")).distinct())
            found = stash(_verified(pairs, sets, words, similarity))
            release(pairs)
        old, left = left, left.where(F.col("rows") > (2 if most == 1 else 0)).drop("rows", "first")  # two rows have been compared
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            if most:
                comps = connected_components(links)
                left = stash(left.drop("comp").join(comps, "node", "left").select("key", "node", "company", F.coalesce("component", "node").alias("comp")))
                release(old)
    release(sets)
    return links


def _free_name(taken: list[str]) -> str:
    """A column name that no column has."""
    name = "__row"
    while name in {c.lower() for c in taken}:
        name += "_"
    return name


def keep_representatives(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near-copies, with all columns; every other row stays.

    Rows are linked where their sets of ``words``-word shingles (a shorter text is one
    shingle) have a Jaccard similarity of at least ``similarity``; groups are what links
    connect, and the row of the smallest doc_id stays, nulls last, of equal ids any one.
    Rows are told apart by a stored row number, so null and repeated ids are rows like
    others. Texts that are null or without words are copies of each other.
    """
    row = _free_name(docs.columns)
    rows = stash(docs.withColumn(row, F.monotonically_increasing_id()))
    texts = rows.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text"))
    signed = stash(_signatures(texts, words))
    classes = stash(signed.groupBy("set_a", "set_b").agg(F.min("row").alias("node")))
    # an empty set has no keys: its class is alone
    banded = stash(signed.where(F.size("keys") > 0).join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "fp", "keys"))
    keyed = stash(with_index_key(banded))
    release(banded)
    links = similar_links(texts, keyed, words, similarity)
    release(keyed)
    if links is not None:
        comps = connected_components(links)
        classes = stash(classes.join(comps, "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("node")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    ids = rows.select(F.col(row).alias("row"), "doc_id").join(signed.select("row", "set_a", "set_b"), "row").join(classes, ["set_a", "set_b"])
    kept = stash(ids.groupBy("node").agg(F.min(order).alias("best")).select(F.col("best.row").alias(row)))
    release(signed)
    return rows.join(kept.hint("merge"), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
