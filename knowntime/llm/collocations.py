"""Phrase collocations by SON partitioning (Savasere, Omiecinski and Navathe 1995).

A task deals its texts into shards of bounded size. A shard that holds the part w of all
words is mined completely at the local support ceil(support * w): a phrase that is frequent
overall reaches that in one shard at least. What shards report are hashes with counts; a
shard that does not report a phrase holds it at most its local support less one times, so a
phrase whose counts and these allowances stay below the support is no candidate. The
candidates' phrases are then counted exactly, as text, over all shards.

Texts are read four times: for the words and for the pairs of frequent words (a phrase with an
infrequent part is not frequent, so shards needn't mine it), for the longer phrases, and for
the exact count. What passes from one reading
to the next is a Bloom filter of at most ``FILTER`` bytes, made block by block in tasks: a
false positive costs a row, never a count, and more candidates than it can tell apart make the
last count larger, not wrong. Reports are packed arrays by range of hash, so neither a common
word or language nor the number of phrases makes a large group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowntime.llm._shared import release, small_batches, stash
from knowntime.llm.lm import mix, word_key

LONGEST = 4
SHARD_WORDS, SHARD_DISTINCT = 500_000, 200_000  # a shard ends beyond either
RANGES = 64  # blocks of a filter
FILTER = 1 << 25  # bytes of a filter at most
MERGED = 1 << 21  # reported hashes that a task merges at a time, at most about
STOP = b"."
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + STOP * 9)
_MORE = np.uint64(0x9E3779B97F4A7C15)


def words_and_stops(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased, a ``STOP`` between pieces."""
    return (text or b"").translate(_TABLE).replace(STOP, b" . ").split()


class _Numbers(dict):
    """Word -> its number as four bytes, in the order met."""

    def __init__(self):
        super().__init__()
        self.met: list[bytes] = []

    def __missing__(self, word):
        self[word] = number = len(self.met).to_bytes(4, "little")
        self.met.append(word)
        return number


class Shard:
    """Texts as numbers; every text ends with a stop, so no phrase spans two."""

    def __init__(self):
        self.numbers, self.langs = _Numbers(), _Numbers()
        self.numbers[STOP]
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, texts: list[bytes | None], langs: list[str]) -> None:
        find, stop = self.numbers.__getitem__, self.numbers[STOP]
        packed = [b"".join(map(find, words_and_stops(t))) + stop for t in texts]
        lang = np.frombuffer(b"".join(map(self.langs.__getitem__, langs)), "<u4")
        self.parts.append((np.frombuffer(b"".join(packed), "<u4"), np.repeat(lang, [len(p) // 4 for p in packed])))
        self.size += len(self.parts[-1][0])

    def close(self) -> None:
        self.number = np.concatenate([n for n, _ in self.parts])
        self.lang = np.concatenate([x for _, x in self.parts])
        self.parts = []
        self.word = self.number != 0
        self.words = int(self.word.sum())

    def keys(self) -> np.ndarray:
        """Hashes of (language, word) at every place."""
        word = np.fromiter(map(word_key, self.numbers.met), np.uint64, len(self.numbers.met))
        lang = np.fromiter((xxhash.xxh64_intdigest(x, 5) for x in self.langs.met), np.uint64, len(self.langs.met))
        return mix(word[self.number] ^ lang[self.lang])


def shards(batches: Iterator[pd.DataFrame], most: tuple[int, int]) -> Iterator[Shard]:
    """The texts of a task in shards of about ``most`` words and distinct words."""
    shard = Shard()
    for batch in batches:
        texts, langs = batch["text"].tolist(), batch["lang"].tolist()
        for at in range(0, len(texts), 64):
            shard.add(texts[at : at + 64], langs[at : at + 64])
            if shard.size >= most[0] or len(shard.numbers.met) >= most[1]:
                shard.close()
                yield shard
                shard = Shard()
    if shard.size:
        shard.close()
        yield shard


class Sieve:
    """A Bloom filter of hashes in ``RANGES`` blocks by their highest bits; one 64-bit cell a hash.
    It reads the first 32 + ``bits`` bits of a hash, which is what shards report."""

    def __init__(self, cells: np.ndarray, bits: int):
        self.cells, self.bits, self.size = cells, bits, len(cells) // RANGES

    def places(self, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, its bits) of each hash's first bits."""
        h, one, low = mix(short), np.uint64(1), np.uint64(63)
        cell = (short >> np.uint64(26 + self.bits)) * np.uint64(self.size) + ((h >> np.uint64(20)) & np.uint64(self.size - 1))
        return cell, (one << (h & low)) | (one << ((h >> np.uint64(6)) & low)) | (one << ((h >> np.uint64(12)) & low))

    def has(self, key: np.ndarray) -> np.ndarray:
        out = np.empty(len(key), bool)
        for at in range(0, len(key), 1 << 18):
            cell, bits = self.places(key[at : at + (1 << 18)] >> np.uint64(32 - self.bits))
            out[at : at + (1 << 18)] = self.cells[cell] & bits == bits
        return out


def _counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts or sums of weights."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    counts = np.diff(np.r_[first, len(keys)]) if weights is None else np.add.reduceat(weights, first)
    return keys[first], counts


def longer(key: np.ndarray, alive: np.ndarray, one: np.ndarray, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the phrases of ``size`` words whose first ``size`` - 1 are at the
    places ``alive`` with hashes ``key``, and whose last word is ``words`` at its place."""
    good = alive + (size - 1) < len(words)
    alive, key = alive[good], key[good]
    good = words[alive + (size - 1)]
    alive, key = alive[good], key[good]
    return mix(key * _MORE + one[alive + (size - 1)]), alive


def mine(one: np.ndarray, words: np.ndarray, least: int, sizes: tuple[int, ...] = (2, 3, 4), pairs: Sieve | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of all phrases of ``sizes`` words that a shard holds ``least``
    times or more; ``words`` tells the places that a phrase may hold, ``pairs`` knows those of two."""
    alive = np.flatnonzero(words)
    key, keys, counts, paired = one[alive], [], [], None
    for size in range(2, max(sizes) + 1):
        key, alive = longer(key, alive, one, words, size)
        if pairs is not None:
            good = pairs.has(key) if size == 2 else paired[alive + (size - 2)]
            key, alive = key[good], alive[good]
            if size == 2:
                paired = np.zeros(len(words), bool)
                paired[alive] = True
        if size not in sizes:
            continue
        found, n = _counted(key)
        found, n = found[n >= least], n[n >= least]
        keys.append(found)
        counts.append(n)
        if least > 1 and size < max(sizes) and len(key):  # a part of a frequent phrase is frequent
            there = np.zeros(len(key), bool)
            if len(found):
                at = np.minimum(np.searchsorted(found, key), len(found) - 1)
                there = found[at] == key
            key, alive = key[there], alive[there]
    return (keys[0], counts[0]) if len(keys) == 1 else _counted(np.concatenate(keys), np.concatenate(counts))


def _report(keys: np.ndarray, counts: np.ndarray, bits: int, enough: int) -> pd.DataFrame:
    """Hashes in order with counts -> a row for each of 2 ** ``bits`` ranges of hashes: the 32 bits
    after the range's, and counts up to ``enough``, beyond which they tell nothing more."""
    short = keys >> np.uint64(32 - bits)
    place = short >> np.uint64(32)
    cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(keys) else []
    ends = [*cuts[1:], len(keys)]
    low, few = short.astype("<u4"), np.minimum(counts, enough).astype(_count_type(enough))
    return pd.DataFrame({
        "range": place[cuts].astype(np.int64) if len(keys) else np.zeros(0, np.int64),
        "keys": [low[a:b].tobytes() for a, b in zip(cuts, ends)],
        "counts": [few[a:b].tobytes() for a, b in zip(cuts, ends)],
    })


def _count_type(enough: int) -> str:
    return "<u1" if enough < 1 << 8 else "<u8"


_REPORT = "range long, keys binary, counts binary, lang string, n long"


def _bits(entries: int) -> int:
    """Ranges, as a power of two from ``RANGES`` on, of ``MERGED`` entries at most on average."""
    return RANGES.bit_length() - 1 + max(0, math.ceil(math.log2(max(1, entries) / (MERGED * RANGES))))


def _sieve(reports: DataFrame, bits: int, least: int, enough: int) -> Sieve:
    """The hashes whose reported counts reach ``least`` in all shards, as a filter."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, keys, counts = None, [], []

        def close() -> pd.DataFrame:
            key, n = _counted(np.concatenate(keys), np.concatenate(counts))
            key = (np.uint64(at) << np.uint64(32)) | key[n >= least].astype(np.uint64)
            return pd.DataFrame({"block": [at >> (bits - RANGES.bit_length() + 1)], "n": [len(key)], "keys": [key.tobytes()]})

        for batch in batches:
            for place, k, c in zip(batch["range"].tolist(), batch["keys"], batch["counts"]):
                if place != at and at is not None:
                    yield close()
                    keys, counts = [], []
                at = place
                keys.append(np.frombuffer(k, "<u4"))
                counts.append(np.frombuffer(c, _count_type(enough)).astype(np.int32 if enough < 1 << 8 else np.int64))
        if at is not None:
            yield close()

    dealt = reports.where("range >= 0").select("range", "keys", "counts").repartition("range").sortWithinPartitions("range")
    merged = stash(dealt.mapInPandas(merge, "block int, n long, keys binary"))
    total = merged.agg(F.sum("n").alias("n")).first()["n"] or 0
    size = 1 << min((FILTER // 8 // RANGES).bit_length() - 1, max(3, math.ceil(math.log2(max(1, total) / RANGES / 4))))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sieve = None, None
        for batch in batches:
            for block, keys in zip(batch["block"].tolist(), batch["keys"]):
                if block != at:
                    if at is not None:
                        yield pd.DataFrame({"block": [at], "cells": [sieve.cells[at * size : (at + 1) * size].tobytes()]})
                    at, sieve = block, Sieve(np.zeros(RANGES * size, np.uint64), bits)
                key = np.frombuffer(keys, np.uint64)
                np.bitwise_or.at(sieve.cells, *sieve.places(key))
        if at is not None:
            yield pd.DataFrame({"block": [at], "cells": [sieve.cells[at * size : (at + 1) * size].tobytes()]})

    cells = np.zeros(RANGES * size, np.uint64)
    filled = merged.where("n > 0").repartition("block").sortWithinPartitions("block").select("block", "keys").mapInPandas(fill, "block int, cells binary")
    for row in filled.toLocalIterator():  # FILTER bytes in all
        cells[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["cells"], np.uint64)
    release(merged)
    return Sieve(cells, bits)


def _exact_counts(shard: Shard, one: np.ndarray, words: np.ndarray, pairs: Sieve, phrases: Sieve) -> Iterator[pd.DataFrame]:
    """(lang, phrase, n) of the words and of the phrases that the filters let pass, by their numbers."""
    alive = np.flatnonzero(words)
    key, same = one[alive], np.zeros(0)
    for size in range(1, LONGEST + 1):
        if size > 1:
            key, alive = longer(key, alive, one, words, size)
            good = (pairs if size == 2 else phrases).has(key)
            key, alive = key[good], alive[good]
        if not len(alive):
            return
        same = shard.lang[alive].astype(np.uint64)
        for k in range(size):  # places of equal phrases get one number, word by word
            _, same = np.unique((same << np.uint64(32)) | shard.number[alive + k], return_inverse=True)
            same = same.astype(np.uint64)
        _, first, n = np.unique(same, return_index=True, return_counts=True)
        met, places = shard.numbers.met, alive[first]
        text = [[met[i] for i in shard.number[places + k].tolist()] for k in range(size)]
        yield pd.DataFrame({
            "lang": [shard.langs.met[i] for i in shard.lang[places].tolist()],
            "phrase": [b" ".join(p).decode("utf-8", "replace") for p in zip(*text)],
            "n": n,
        })


def frequent_phrases(docs: DataFrame, support: int = 30, most: tuple[int, int] = (SHARD_WORDS, SHARD_DISTINCT)) -> tuple[DataFrame, DataFrame]:
    """(lang, text) -> ((lang, phrase, words, f): all phrases of 1 to 4 words with ``support``
    occurrences or more, (lang, n): all words), both stored. A shard ends beyond ``most`` words or
    distinct words."""
    sc = docs.sparkSession.sparkContext
    texts = small_batches(docs).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))

    start = _bits(0)

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard in shards(batches, most):
            yield _report(*_counted(shard.keys()[shard.word]), start, support).assign(lang=None, n=0)
            n = np.bincount(shard.lang[shard.word], minlength=len(shard.langs.met))
            yield pd.DataFrame({"range": -1, "keys": None, "counts": None, "lang": shard.langs.met, "n": n})

    first = stash(texts.mapInPandas(count_words, _REPORT))
    totals = stash(first.where("range = -1").groupBy("lang").agg(F.sum("n").alias("n")))
    total = totals.agg(F.sum("n").alias("n")).first()["n"] or 0
    sent_words = sc.broadcast(_sieve(first, start, support, support))
    release(first)

    def mined(sizes: tuple[int, ...], known_pairs: Broadcast | None) -> Broadcast:
        """The filter of one round's candidates."""
        bits = _bits(len(sizes) * total)

        def mine_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, pairs = sent_words.value, None if known_pairs is None else known_pairs.value
            for shard in shards(batches, most):
                one, least = shard.keys(), max(1, -(-support * shard.words // max(1, total)))
                keys, counts = mine(one, shard.word & known.has(one), least, sizes, pairs)
                yield _report(keys, counts - (least - 1), bits, support).assign(lang=None, n=0)
                yield pd.DataFrame({"range": [-1], "keys": None, "counts": None, "lang": None, "n": [least - 1]})

        reports = stash(texts.mapInPandas(mine_shards, _REPORT))
        allowance = reports.where("range = -1").agg(F.sum("n").alias("n")).first()["n"] or 0
        sent = sc.broadcast(_sieve(reports, bits, support - allowance, support))
        release(reports)
        return sent

    sent_pairs = mined((2,), None)
    sent_phrases = mined(tuple(range(3, LONGEST + 1)), sent_pairs)

    def count_phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, pairs, phrases = sent_words.value, sent_pairs.value, sent_phrases.value
        for shard in shards(batches, most):
            one = shard.keys()
            yield from _exact_counts(shard, one, shard.word & known.has(one), pairs, phrases)

    counted = texts.mapInPandas(count_phrases, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    words = F.size(F.split("phrase", " ")).alias("words")
    return stash(counted.where(F.col("f") >= support).select("lang", "phrase", words, "f")), totals


def _whole(x: Column | str | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x).cast("decimal(19,0)")


def _first(rows: DataFrame, most: int, deal: int = 64) -> DataFrame:
    """The first ``most`` rows of each language, ranked: of each of ``deal`` parts first, so no
    task sorts a language whole."""
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(deal)))
    some = dealt.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= most)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most).drop("part", "place")


def collocations(docs: DataFrame, support: int = 30, most: int = 2000, shard: tuple[int, int] = (SHARD_WORDS, SHARD_DISTINCT)) -> DataFrame:
    """documents -> (lang, rank, phrase, a, l, r, n, score): each language's first ``most`` phrases.

    Words are runs without space and tab inside pieces, which end at ``.,;:!?`` and line ends;
    A-Z are lower-cased. A null text is empty, a null lang is ``und``. Phrases of 2 to 4 words
    with a >= ``support`` occurrences are cut in two at each place; the cut with the lowest
    floor(2000000 a / (l + r)) counts, l and r the parts' occurrences, ties to the shortest first
    part. A phrase is dropped where a longer one with 100 f >= 80 a holds it. Ranked by score,
    then a, falling, then by the phrase's bytes. Counts are exact over all texts, repeated rows
    and all; other columns are not read.
    """
    found, totals = frequent_phrases(docs, support, shard)
    parts = F.split("phrase", " ")

    def span(first: Column | int, size: Column | int) -> Column:
        return F.concat_ws(" ", F.slice(parts, first, size))

    candidates = found.where("words > 1")
    cut = candidates.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", span(F.lit(1), F.col("k")).alias("left"), span(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    cut = cut.join(found.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cut = cut.join(found.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cut = cut.select("lang", "phrase", "a", "k", "l", "r", _whole(2_000_000).alias("scale"), _whole("a").alias("x"), (_whole("l") + _whole("r")).alias("y"))
    cut = cut.withColumn("score", F.expr("CAST((scale * x) div y AS BIGINT)"))
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = candidates.where("words > 2").select("lang", "words", F.col("f").alias("around"), parts.alias("parts"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "around", "parts", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    inner = inner.select("lang", "around", F.concat_ws(" ", F.slice("parts", F.col("at"), F.col("size"))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("around").isNull() | (_whole(100) * _whole("around") < _whole(80) * _whole("a")))
    kept = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    return _first(kept, most).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
