"""Near-duplicate embeddings by product quantisation with exact rerank.

Vectors are dealt to inverted lists by their nearest coarse centroid; within a
list a vector is known by the code of its residual in each subspace. A query
reads the lists of its nearest centroids, gets distances to their members from
per-subspace tables, and drops members that are too far even after their own
quantisation error is allowed for (the triangle inequality makes this lossless);
the rest are compared exactly, in double precision.

Lists are cut into blocks of bounded size, so a crowded region spreads over
tasks. Tasks emit counts and a spanning star per local component, never pairs,
and each pair is counted in one place only. Centroids and codebooks are fitted on
a bounded sample, for each dimension by itself; every vector is indexed. Equal vectors
are one class, told by a digest of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowntime.llm._shared import connected_components, release, stash
from knowntime.llm.neighbours import comparable, matrix, pack
from knowntime.llm.simhash import _settle

SAMPLE, SAMPLE_BYTES = 20_000, 1 << 27  # vectors that centroids and codebooks are fitted on, at most about
MOST_LISTS = 4096
PER_LIST = 256
SUBSPACES = 8
CODES = 64
PROBES = 8
BLOCK, MOST_BLOCK = 1024, 1 << 15  # members of a list that a task holds; more of them where lists are longer


def _kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 4096] @ c.T * -2 + (c * c).sum(1)).argmin(1) for a in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which loses nothing, so that no square leaves the range of doubles."""
    raw = np.asarray(vectors, np.float64)
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(1, keepdims=True))[1])


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


class Codec:
    """Coarse centroids and one codebook of residuals per subspace."""

    def __init__(self, coarse: np.ndarray, books: list[np.ndarray]):
        self.coarse, self.books = coarse, books
        widths = [b.shape[1] for b in books]
        self.cuts = list(zip(np.cumsum([0, *widths[:-1]]), np.cumsum(widths)))

    @staticmethod
    def fit(sample: np.ndarray, lists: int) -> Codec:
        coarse = _kmeans(sample, lists)
        near = (sample @ coarse.T * -2 + (coarse * coarse).sum(1)).argmin(1)
        rest = sample - coarse[near]
        return Codec(coarse, [_kmeans(np.ascontiguousarray(part), CODES) for part in np.array_split(rest, min(SUBSPACES, rest.shape[1]), axis=1)])

    def probes(self, unit: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest lists of each vector, nearest first."""
        d = unit @ self.coarse.T * -2 + (self.coarse * self.coarse).sum(1)
        return np.argsort(d, axis=1, kind="stable")[:, :n]

    def encode(self, unit: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, length of what the codes leave out)."""
        rest = unit - self.coarse[lists]
        codes = np.empty((len(unit), len(self.books)), np.uint8)
        lost = np.zeros(len(unit))
        for m, ((a, b), book) in enumerate(zip(self.cuts, self.books)):
            d = (rest[:, a:b] @ book.T) * -2 + (book * book).sum(1)
            codes[:, m] = d.argmin(1)
            gap = rest[:, a:b] - book[codes[:, m]]
            lost += (gap * gap).sum(1)
        return codes, np.sqrt(lost)

    def distances(self, unit: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Query x member distances to the members' codes, summed from tables."""
        rest, total = unit - self.coarse[at], np.zeros((len(unit), len(codes)))
        for m, ((a, b), book) in enumerate(zip(self.cuts, self.books)):
            part = rest[:, a:b]
            table = (part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)
            total += table[:, codes[:, m]]
        return np.sqrt(np.maximum(total, 0))


def _block_links(codec: Codec, at: int, members: dict, visitors: dict, least: float, label: np.ndarray, count: np.ndarray):
    """Links of ``visitors`` (or of members among themselves) to members: (visitor, member) rows."""
    same = visitors is members
    far = codec.distances(visitors["unit"], at, members["codes"]) - members["lost"]
    q, n = np.nonzero(far <= np.sqrt(2 - 2 * least) + 1e-6)
    if same:
        q, n = q[q < n], n[q < n]
    else:  # a pair that both lists could see counts in the lower one
        twice = (visitors["own"][q] != at) & (visitors["own"][q] < at)
        if twice.any():
            seen = (members["probes"][n] == visitors["own"][q][:, None]).any(1)
            q, n = q[~(twice & seen)], n[~(twice & seen)]
    a, b = visitors["raw"][q], members["raw"][n]
    good = ((a * b).sum(1) / (visitors["norm"][q] * members["norm"][n]) >= least) & (visitors["dim"][q] == members["dim"][n])
    return q[good], n[good]


def near_vectors(vectors: DataFrame, least: float = 0.9, probes: int = PROBES) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, n_links, component_id, kept), a row for each row.

    A vector that is null, empty, zero, or holds null or non-finite components links
    with nothing; vectors of different dimensions don't link. Equal vectors are one class
    in the index and linked with each other. ``least`` is a cosine; labels and other
    columns are not read. Rows with equal or null vec_id count each for itself; a
    component of null ids alone has no id. Recall depends on ``probes``; the tests hold
    it above 0.9 against brute force.
    """
    sc = vectors.sparkSession.sparkContext
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    packed = stash(pack(rows.where(comparable(F.col("v"))).withColumns({"row": F.monotonically_increasing_id(), "asked": F.lit(False)})))
    same = ["dim", "hi", "lo"]
    classes = packed.groupBy(*same).agg(F.min("vec_id").alias("least_id"), F.count("*").alias("n"), F.first("raw").alias("raw"))
    classes = stash(classes.withColumn("id", F.monotonically_increasing_id()))
    counts = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a number per dimension
    total = sum(counts.values())
    room = F.floor(F.lit(SAMPLE_BYTES) / (F.col("dim") * 8))  # of a wide dimension few vectors fit
    share = F.least(F.lit(1.0), F.lit(SAMPLE / max(1, total)), room / F.lit(max(1, total)))
    chosen = classes.where(F.pmod(F.xxhash64("hi", "lo", F.lit("fit")), F.lit(1 << 30)) < share * (1 << 30)).select("dim", "raw").toPandas()
    codecs, sizes_of = {}, {}
    for dim, n in counts.items():
        some = chosen[chosen["dim"] == dim]["raw"]
        some = matrix(some, dim) if len(some) else np.eye(1, dim)  # any centroid serves few vectors
        lists = int(np.clip(n // PER_LIST, 1, MOST_LISTS))
        codec = Codec.fit(_unit(_scaled(some)), lists)
        codecs[dim], sizes_of[dim] = (codec.coarse, codec.books), int(np.clip(n // lists // 8, BLOCK, MOST_BLOCK))
    sent = sc.broadcast(codecs)
    fields = "id long, n long, dim int, raw binary, own int, probes array<int>"

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                codec = Codec(*sent.value[dim])
                near = codec.probes(_unit(_scaled(matrix(part["raw"], dim))), min(probes, len(codec.coarse)))
                yield part[["id", "n", "dim", "raw"]].assign(own=near[:, 0], probes=list(near.astype(np.int32)))

    dealt = stash(classes.select("id", "n", "dim", "raw").mapInPandas(deal, fields))
    sizes = dealt.groupBy("dim", "own").agg(F.count("*").alias("n")).collect()  # a number per list
    blocks = sc.broadcast({(r["dim"], r["own"]): -(-r["n"] // sizes_of[r["dim"]]) for r in sizes})

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = blocks.value
        for batch in batches:
            out = []
            mixed = (batch["id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for i, (dim, own, near) in enumerate(zip(batch["dim"], batch["own"], batch["probes"])):
                mine = int(mixed[i]) % count[dim, own]
                out.append((i, own, mine, 0))
                out += [(i, own, b, 1) for b in range(mine)]
                out += [(i, p, b, 1) for p in near if p != own for b in range(count.get((dim, p), 0))]
            i, at, block, kind = map(list, zip(*out)) if out else ([], [], [], [])
            yield batch.iloc[i].assign(at=at, block=block, kind=kind)

    routed = dealt.mapInPandas(route, fields + ", at int, block int, kind int")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, members, label, count = None, None, None, None

        def prepare(part: pd.DataFrame) -> dict:
            raw = _scaled(matrix(part["raw"], part["dim"].iloc[0]))
            return {"id": part["id"].to_numpy(), "dim": part["dim"].to_numpy(), "n": part["n"].to_numpy(), "raw": raw, "norm": np.sqrt((raw * raw).sum(1)), "unit": _unit(raw), "own": part["own"].to_numpy(), "probes": np.stack(part["probes"])}

        def close() -> pd.DataFrame:
            linked = label != np.arange(len(label))
            ids = members["id"]
            return pd.DataFrame({"a": np.r_[ids, ids[linked]], "b": np.r_[ids, ids[label[linked]]], "n": np.r_[count, np.zeros(linked.sum(), np.int64)]})

        for batch in batches:
            change = batch[["dim", "at", "block", "kind"]].to_numpy()
            cuts = np.flatnonzero(np.r_[True, (change[1:] != change[:-1]).any(1)]) if len(batch) else []
            for a, b in zip(cuts, [*cuts[1:], len(batch)]):
                dim, at, block, kind = (int(x) for x in change[a])
                codec, part = Codec(*sent.value[dim]), prepare(batch.iloc[a:b])
                if kind == 0:
                    if key != (dim, at, block):
                        if members is not None:
                            yield close()
                        key, members = (dim, at, block), None
                    old = members
                    part["codes"], part["lost"] = codec.encode(part["unit"], np.full(len(part["id"]), at))
                    if old is not None:  # the block came in two batches
                        members = {k: np.concatenate([old[k], part[k]]) for k in part}
                        label = np.r_[label, len(old["id"]) + np.arange(len(part["id"]))]
                        count = np.r_[count, np.zeros(len(part["id"]), np.int64)]
                        q, n = _block_links(codec, at, old, part | {"own": np.full(len(part["id"]), at)}, least, label, count)
                        np.add.at(count, n, part["n"][q])
                        np.add.at(count, len(old["id"]) + q, old["n"][n])
                        label = _settle(label, len(old["id"]) + q, n)
                        shift = len(old["id"])
                    else:
                        members, shift = part, 0
                        label, count = np.arange(len(part["id"])), np.zeros(len(part["id"]), np.int64)
                    q, n = _block_links(codec, at, part, part, least, label, count)
                    np.add.at(count, shift + q, part["n"][n])
                    np.add.at(count, shift + n, part["n"][q])
                    label = _settle(label, shift + q, shift + n)
                    continue
                if key != (dim, at, block):
                    continue
                step = max(16, (1 << 19) // len(members["id"]))
                for some in range(0, len(part["id"]), step):
                    few = {k: v[some : some + step] for k, v in part.items()}
                    q, n = _block_links(codec, at, members, few, least, label, count)
                    if not len(q):
                        continue
                    np.add.at(count, n, few["n"][q])
                    mine = np.zeros(len(few["id"]), np.int64)
                    np.add.at(mine, q, members["n"][n])
                    both = _settle(np.r_[label, len(label) + np.arange(len(few["id"]))], len(label) + q, n)
                    hit = np.unique(q)
                    yield pd.DataFrame({"a": np.r_[few["id"][hit], few["id"][hit]], "b": np.r_[few["id"][hit], members["id"][both[len(label) + hit]]], "n": np.r_[mine[hit], np.zeros(len(hit), np.int64)]})
                    label = both[: len(label)]
        if members is not None:
            yield close()

    found = stash(
        routed.repartition("dim", "at", "block").sortWithinPartitions("dim", "at", "block", "kind", "id").mapInPandas(search, "a long, b long, n long")
    )
    release(dealt)
    links = found.where("a = b").groupBy("a").agg(F.sum("n").alias("links"))
    comps = connected_components(found.where("a <> b").select("a", "b"))
    placed = stash(
        classes.drop("raw").join(links, F.col("id") == F.col("a"), "left")
        .join(comps, F.col("id") == F.col("node"), "left")
        .select(*same, "least_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    )
    for frame in (found, classes):
        release(frame)
    owner = placed.join(placed.groupBy("component").agg(F.min("least_id").alias("component_id")), "component").select(*same, "n_links", "component_id")
    linked = packed.select("vec_id", *same).join(owner, same).select("vec_id", "n_links", "component_id")
    alone = rows.where(~comparable(F.col("v"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    component = F.coalesce("component_id", "vec_id")
    return linked.unionByName(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
