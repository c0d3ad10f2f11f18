"""Nearest neighbours by a block matrix join of int8 codes with exact recomputation.

A vector x is coded as s * q with an int8 vector q, and its own error |x - s * q| is
kept. For two vectors the product of their codes gives a distance that lies within
the sum of both errors of the true one (triangle inequality), so a pair whose lower
bound exceeds the k-th distance known so far is out for certain; the others are
computed again from the original vectors in double precision and enter the query's
heap. Nothing is approximate, so recall is 1.

Queries are cut into blocks of bounded size and candidates are dealt into stripes. A
tile is one query block met with one stripe: its task holds the block, its heaps and
one batch of candidates at a time, and returns k + 1 rows for each query, however
many candidates survive. Equal vectors are one class of which the k + 1 smallest
ids can be a result, so copies of one vector, however many, are one row of the join.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowntime.llm._shared import release, stash

BLOCK_BYTES = 1 << 26  # of a query block: codes, vectors and heaps
STRIPE_PAIRS = 1 << 36  # pairs of a tile at most about
TILE = 1 << 21  # pairs whose bounds a task holds at a time
SLICE = 1024  # dimensions whose int8 products float32 sums exactly (1024 * 127 ** 2 < 2 ** 24)
NO_ID = (1 << 63) - 1  # a null id comes last


def comparable(v: Column) -> Column:
    """True for vectors that are neither null, empty nor zero and hold finite numbers only."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances row by row; a power of two keeps squares in range and loses nothing."""
    with np.errstate(over="ignore", invalid="ignore"):
        gap = a - b
        power = np.frexp(np.abs(gap).max(1))[1]
        part = np.ldexp(gap, -power[:, None])
        return np.where(np.isfinite(gap).all(1), np.ldexp(np.sqrt((part * part).sum(1)), power), np.inf)


class Codes:
    """int8 codes of vectors with scales, squared lengths and errors of the coded vectors."""

    def __init__(self, raw: np.ndarray):
        scale = np.abs(raw).max(1) / 127.0
        safe = np.where(scale > 0, scale, 1.0)
        self.q = np.rint(np.clip(raw / safe[:, None], -127, 127)).astype(np.int8)
        coded = self.q * safe[:, None]
        with np.errstate(over="ignore", under="ignore", invalid="ignore"):
            self.scale, self.square = safe, (coded * coded).sum(1)
            self.error = np.sqrt(((raw - coded) ** 2).sum(1)) * (1 + 1e-9)

    def __getitem__(self, at: slice) -> Codes:
        part = object.__new__(Codes)
        part.q, part.scale, part.square, part.error = self.q[at], self.scale[at], self.square[at], self.error[at]
        return part


def bounds(a: Codes, b: Codes) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of all distances between two tiles from their int8 product."""
    product = np.zeros((len(a.q), len(b.q)))
    for at in range(0, a.q.shape[1], SLICE):  # whole numbers below 2 ** 24, so float32 products are exact
        product += a.q[:, at : at + SLICE].astype(np.float32) @ b.q[:, at : at + SLICE].astype(np.float32).T
    with np.errstate(over="ignore", invalid="ignore"):
        both = a.square[:, None] + b.square
        product *= a.scale[:, None] * b.scale
        near = np.sqrt(np.maximum(both - 2 * product, 0))
        slack = a.error[:, None] + b.error + np.sqrt(both) * 1e-7 + 1e-150  # the last two for rounding
        return near - slack, near + slack


class Heaps:
    """The ``k`` nearest classes of each query of a block, by (distance, least id, class)."""

    def __init__(self, raw: np.ndarray, k: int):
        self.raw, self.k, self.codes = raw, k, Codes(raw)
        self.heaps: list[list[tuple]] = [[] for _ in raw]
        self.worst = np.full(len(raw), np.inf)

    def meet(self, raw: np.ndarray, least: np.ndarray, ids: np.ndarray) -> None:
        step = max(1, TILE // len(self.raw))
        codes = Codes(raw)
        for at in range(0, len(raw), step):
            part = slice(at, at + step)
            low, high = bounds(self.codes, codes[part])
            most = self.worst
            if low.shape[1] >= self.k and np.isinf(most).any():
                most = np.fmin(most, np.partition(high, self.k - 1, axis=1)[:, self.k - 1])
            query, other = np.nonzero(~(low > most[:, None]))  # not a number stays
            few = max(1, (1 << 22) // self.raw.shape[1])
            for some in range(0, len(query), few):
                self._push(query[some : some + few], other[some : some + few], raw[part], least[part], ids[part])

    def _push(self, query, other, raw, least, ids) -> None:
        d = distances(self.raw[query], raw[other])
        good = d <= self.worst[query]
        for q, x, y, i in zip(query[good].tolist(), d[good].tolist(), least[other[good]].tolist(), ids[other[good]].tolist()):
            heap = self.heaps[q]
            if len(heap) < self.k:
                heapq.heappush(heap, (-x, -y, -i))
            else:
                heapq.heappushpop(heap, (-x, -y, -i))
            if len(heap) == self.k:
                self.worst[q] = -heap[0][0]

    def rows(self, ids: np.ndarray) -> pd.DataFrame:
        found = [(q, -i, -y, -x) for q, heap in zip(ids.tolist(), self.heaps) for x, y, i in heap]
        return pd.DataFrame(found, columns=["q", "c", "least", "score"]).astype({"q": "int64", "c": "int64", "least": "int64", "score": "float64"})


def matrix(packed: pd.Series, dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float32 if len(x) == 4 * dim else np.float64) for x in packed]).astype(np.float64)


def pack(rows: DataFrame) -> DataFrame:
    """(row, vec_id, asked, v) -> the same with the vector's bytes and a 128-bit digest of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed, digests = [], []
            for v in batch["v"]:
                wide = np.asarray(v, np.float64) + 0.0  # one zero
                with np.errstate(over="ignore"):
                    short = wide.astype(np.float32)
                digests.append(xxhash.xxh128_digest(wide.tobytes()))
                packed.append((short if np.array_equal(short, wide) else wide).tobytes())
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield batch[["row", "vec_id", "asked", "dim"]].assign(hi=halves[:, 0], lo=halves[:, 1], raw=packed)

    return rows.select("row", "vec_id", "asked", F.size("v").alias("dim"), "v").mapInPandas(run, "row long, vec_id long, asked boolean, dim int, hi long, lo long, raw binary")


def _tiles(sides: DataFrame, k: int) -> DataFrame:
    """(dim, block, stripe, kind, id, least, raw), queries of a tile before its candidates -> its heaps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, heaps, ids, parts = None, None, None, []
        for batch in batches:
            key = batch[["dim", "block", "stripe", "kind"]].to_numpy()
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]) if len(batch) else []
            for a, b in zip(cuts, [*cuts[1:], len(batch)]):
                part, (dim, block, stripe, kind) = batch.iloc[a:b], key[a].tolist()
                if (dim, block, stripe) != at:
                    if heaps is not None:
                        yield heaps.rows(ids)
                    at, heaps, parts = (dim, block, stripe), None, []
                if kind == 0:
                    parts.append((part["id"].to_numpy(), matrix(part["raw"], dim)))
                    continue
                if heaps is None and parts:
                    ids = np.concatenate([x for x, _ in parts])
                    heaps, parts = Heaps(np.concatenate([x for _, x in parts]), k), []
                if heaps is not None:
                    heaps.meet(matrix(part["raw"], dim), part["least"].to_numpy(), part["id"].to_numpy())
        if heaps is not None:
            yield heaps.rows(ids)

    dealt = sides.repartition("dim", "block", "stripe").sortWithinPartitions("dim", "block", "stripe", "kind")
    return dealt.mapInPandas(run, "q long, c long, least long, score double")


def nearest_vectors(vectors: DataFrame, asked: Column, k: int = 10) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, score): of each row that ``asked`` names
    (null: not asked), the ``k`` nearest other rows, nearest first, ties to the smaller vec_id.

    Nearness is Euclidean distance in double precision. Vectors that are null, empty, zero or
    hold null or non-finite components take no part; vectors of different dimensions are not
    compared. Rows are told apart by a row number: rows of one vec_id are rows like others, so
    a repeated query id has ``k`` rows for each of its rows, and a null id can be a result, last
    among ties. A distance beyond the range of doubles is infinite. Other columns are not read.
    """
    picked = vectors.select(F.col("vec_id").cast("long"), F.coalesce(asked, F.lit(False)).alias("asked"), F.col("embedding").cast("array<double>").alias("v"))
    packed = stash(pack(picked.where(comparable(F.col("v"))).withColumn("row", F.monotonically_increasing_id())))
    order = Window.partitionBy("hi", "lo", "dim").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    members = stash(packed.select("hi", "lo", "dim", "vec_id", "row", "raw").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1))
    classes = stash(members.where("place = 1").select("hi", "lo", "dim", "raw", F.col("row").alias("id"), F.coalesce("vec_id", F.lit(NO_ID)).alias("least")))
    wanted = packed.where("asked").select("hi", "lo", "dim").distinct()
    queries = stash(classes.join(wanted, ["hi", "lo", "dim"], "left_semi"))

    rows = F.greatest(F.lit(1), F.least(F.lit(1 << 16), F.floor(BLOCK_BYTES / (F.col("dim") * 9 + 24 * (k + 1)))))
    plan = classes.groupBy("dim").agg(F.count("*").alias("c")).join(queries.groupBy("dim").agg(F.count("*").alias("q")), "dim")
    stripes = F.greatest(F.ceil(F.col("c") * F.least("q", rows) / STRIPE_PAIRS), F.least(F.lit(32), F.ceil(F.col("c") / 1024)))
    plan = stash(plan.select("dim", F.ceil(F.col("q") / rows).cast("int").alias("blocks"), stripes.cast("int").alias("stripes")))
    left = queries.join(plan, "dim").select("dim", F.pmod("hi", "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)).alias("stripe"), F.lit(0).alias("kind"), "id", "least", "raw")
    right = classes.join(plan, "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod("lo", "stripes").cast("int").alias("stripe"), F.lit(1).alias("kind"), "id", "least", "raw")
    found = stash(_tiles(left.unionByName(right), k + 1))

    best = Window.partitionBy("q").orderBy("score", "least", "c")
    near = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).select("q", "c", "score")
    owners = members.select("hi", "lo", "dim", F.col("vec_id").alias("other"), F.col("row").alias("other_row"))
    heads = classes.select("hi", "lo", "dim", F.col("id").alias("c"))
    rows_of = near.join(heads.join(owners, ["hi", "lo", "dim"]).select("c", "other", "other_row"), "c")
    first = Window.partitionBy("q").orderBy("score", F.col("other").asc_nulls_last(), "other_row")
    rows_of = rows_of.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    lists = rows_of.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "other", "other_row", "score"))).alias("found"))  # k + 1 of a query
    lists = stash(lists.join(queries.select("hi", "lo", "dim", F.col("id").alias("q")), "q").drop("q"))
    for frame in (found, members, classes, queries, plan):
        release(frame)
    each = packed.where("asked").select("hi", "lo", "dim", F.col("vec_id").alias("query_id"), "row").join(lists, ["hi", "lo", "dim"])
    others = F.slice(F.filter("found", lambda x: x["other_row"] != F.col("row")), 1, k)
    return each.select("query_id", F.posexplode(others).alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("x.other").alias("vec_id"), F.col("x.score").alias("score")
    )
