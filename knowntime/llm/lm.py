"""Language-model scores from a log-frequency Bloom filter (Talbot and Osborne 2007).

Counts of words and of word pairs are quantised, q = 1 + floor(log2 c), and each
n-gram enters a Bloom filter once for every level up to its q; a count is read
back by probing levels until one is missing, so it is never too low. The bits of one
level lie in one 64-bit word, so a probe is one look. Counting is a distributed
aggregation over all training texts. The filter consists of blocks that tasks fill
side by side; their number follows the corpus, so the rate of false levels does not
grow with it. They are broadcast in successive groups of at most ``most_bytes``: each
pass probes the keys of its own blocks, and the levels found travel with the rows to
the last pass, which scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowntime.llm._shared import frequent, release, small_batches, stash, training_part

BLOCK = 1 << 17  # bytes of a filter block
CELLS = BLOCK // 8  # 64-bit words of a block
PROBES = 4  # bits that a level sets
LEVELS = 48
START, END = b" s", b" e"  # no word holds a space
TASK_TOKENS = 1_500_000  # pairs that a task sorts at a time
TASK_WORDS = 150_000  # distinct words that a task holds at a time
PART_BYTES = 2_000_000  # of text that is scored at a time
_random = np.random.default_rng(16)
_MASKS = np.bitwise_or.reduce(np.uint64(1) << np.argsort(_random.random((4096, 64)), axis=1)[:, :PROBES].astype(np.uint64), axis=1)
_FACTORS = _random.integers(0, 1 << 63, LEVELS, np.uint64) * np.uint64(2) + np.uint64(1)


def words(text: bytes | None) -> list[bytes]:
    """Runs without ASCII white space of a UTF-8 text, A-Z lower-cased."""
    return (text or b"").lower().split()


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, vectorised."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + (second ^ np.uint64(0xD1B54A32D192ED03)))


def block_of(key: np.ndarray, blocks: int) -> np.ndarray:
    """Rises with the key, so keys in order lie in runs by block."""
    return ((key >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def _cell(key: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the 64-bit word within the key's block, bits of the level in it)."""
    h = key * _FACTORS[level]
    return h >> np.uint64(50), _MASKS[(h >> np.uint64(38)) & np.uint64(4095)]


def fill(cells: np.ndarray, key: np.ndarray, count: np.ndarray) -> None:
    """Enter keys of one block with their counts."""
    level = 1 + np.floor(np.log2(np.maximum(count, 1))).astype(np.int64)
    for q in range(1, int(level.max(initial=0)) + 1):
        cell, mask = _cell(key[level >= q], q)
        np.bitwise_or.at(cells, cell, mask)


def read_levels(cells: np.ndarray, blocks: int, key: np.ndarray, low: int = 0) -> np.ndarray:
    """The highest level before a gap, 0 for none and for keys of other blocks than those
    in ``cells``, which start with block ``low``."""
    level = np.zeros(len(key), np.uint8)
    place = block_of(key, blocks).astype(np.int64) - low
    alive = np.flatnonzero((place >= 0) & (place < len(cells) // CELLS))
    key, base = key[alive], place[alive].astype(np.uint64) * np.uint64(CELLS)
    for q in range(1, LEVELS):
        cell, mask = _cell(key, q)
        there = np.flatnonzero(cells[base + cell] & mask == mask)
        if not len(there):
            break
        alive, key, base = alive[there], key[there], base[there]
        level[alive] = q
    return level


def counts_of(level: np.ndarray) -> np.ndarray:
    """The middle of each level's quantum, 0 for none."""
    return _MIDDLE[level]


_MIDDLE = np.array([0.0] + [(3.0 * 2.0**q - 1) / 2 for q in range(255)])


class _Numbers(dict):
    """Word -> its number as four bytes, in the order met."""

    def __init__(self):
        super().__init__()
        self.met: list[bytes] = []

    def __missing__(self, word: bytes) -> bytes:
        number = len(self.met).to_bytes(4, "little")
        self.met.append(word)
        self[word] = number
        return number


class Scorer:
    """Reads filter blocks from ``low`` on; what it learns of a word is kept, for ``most`` words
    about, and so is the word's exact count where ``known`` has it."""

    def __init__(self, cells: np.ndarray, blocks: int, tokens: int, distinct: int, weight: float, prior: float, low: int = 0, known: dict[bytes, int] | None = None, most: int = 150_000):
        self.cells, self.blocks, self.tokens, self.distinct = cells, blocks, tokens, distinct
        self.weight, self.prior, self.low, self.known, self.most = weight, prior, low, known or {}, most
        self._reset()

    def _reset(self) -> None:
        self.numbers = _Numbers()
        self.numbers[START], self.numbers[END]
        self.key, self.level, self.count = np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64)

    def read(self, texts: list[list[bytes]]) -> np.ndarray:
        """Numbers of all words, a START and an END around each text."""
        if len(self.numbers) > self.most:
            self._reset()
        first, last, find = self.numbers[START], self.numbers[END], self.numbers.__getitem__
        number = np.frombuffer(b"".join([first + b"".join(map(find, t)) + last for t in texts]), "<u4")
        new = self.numbers.met[len(self.key) :]
        if new:
            key = np.fromiter(map(word_key, new), np.uint64, len(new))
            self.key = np.concatenate([self.key, key])
            self.level = np.concatenate([self.level, read_levels(self.cells, self.blocks, key, self.low)])
            self.count = np.concatenate([self.count, np.fromiter((self.known.get(w, 0) for w in new), np.int64, len(new))])
        return number

    def _levels(self, number: np.ndarray, texts: list[list[bytes]], seen: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
        """Levels of all words and of all pairs within texts; ``seen`` has those of earlier blocks."""
        first = np.flatnonzero(number[:-1] != 1)
        key, word = self.key[number], self.level[number]
        pair = read_levels(self.cells, self.blocks, pair_key(key[first], key[first + 1]), self.low)
        if seen is not None:
            word = np.maximum(word, np.frombuffer(b"".join(s[: len(t) + 2] for s, t in zip(seen, texts)), np.uint8))
            pair = np.maximum(pair, np.frombuffer(b"".join(s[len(t) + 2 :] for s, t in zip(seen, texts)), np.uint8))
        return word, pair

    def levels(self, texts: list[list[bytes]], seen: list[bytes] | None) -> list[bytes]:
        """Per text a byte for each word, START and END included, then for each pair."""
        word, pair = (x.tobytes() for x in self._levels(self.read(texts), texts, seen))
        out, w, p = [], 0, 0
        for t in texts:
            out.append(word[w : w + len(t) + 2] + pair[p : p + len(t) + 1])
            w, p = w + len(t) + 2, p + len(t) + 1
        return out

    def score(self, texts: list[list[bytes]], seen: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
        """(log10 probability, tokens with an exact count, sum of their log10(count + 1), the other
        tokens) of each text: its words, then one end.

        The probability comes from filter probes alone: pair counts smoothed by ``prior`` words
        of the add-one word estimate, mixed with that estimate by ``weight``.
        """
        number = self.read(texts)
        word, pair = self._levels(number, texts, seen)
        token = np.flatnonzero(number != 0)
        context, count, pair = counts_of(word[token - 1]), counts_of(word[token]), counts_of(pair)
        alone = (count + 1) / (self.tokens + self.distinct + 1)
        log = np.log10(self.weight * (np.minimum(pair, context) + self.prior * alone) / (context + self.prior) + (1 - self.weight) * alone)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        starts = np.cumsum(sizes) - sizes
        exact = self.count[number[token]]
        rare: list[list[bytes]] = [[] for _ in texts]
        met = self.numbers.met
        missing = np.flatnonzero(exact == 0)
        for text, n in zip((np.searchsorted(starts, missing, "right") - 1).tolist(), number[token[missing]].tolist()):
            rare[text].append(met[n])
        return np.add.reduceat(log, starts), np.add.reduceat((exact > 0).astype(np.int64), starts), np.add.reduceat(np.log10(exact + 1.0), starts), rare


def parts_of(texts: list[list[bytes]], size: int = PART_BYTES) -> Iterator[slice]:
    """Slices of texts of some megabytes each, one text at least."""
    at = held = 0
    for i, t in enumerate(texts):
        n = 8 * len(t) + 16
        if held and held + n > size:
            yield slice(at, i)
            at, held = i, 0
        held += n
    if held:
        yield slice(at, len(texts))


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n) over all training texts; each text ends with END."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.update(words(text))
                if len(held) > TASK_WORDS:
                    yield flush()
                    held = Counter()
            held[END] += len(batch)
        if held:
            yield flush()

    return train.mapInArrow(tally, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _packed(key: np.ndarray, n: np.ndarray, blocks: int, shelf: int) -> pd.DataFrame:
    """Rows (shelf, keys, counts) of sorted keys; a shelf is ``shelf`` neighbouring blocks."""
    number = block_of(key, blocks) // np.uint64(shelf)
    cuts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(key) else np.zeros(0, np.int64)
    ends = [*cuts[1:].tolist(), len(key)]
    return pd.DataFrame({"shelf": number[cuts].astype(np.int64), "keys": [key[a:b].tobytes() for a, b in zip(cuts, ends)], "counts": [n[a:b].tobytes() for a, b in zip(cuts, ends)]})


PACKED = "shelf long, keys binary, counts binary"


def pair_counts(train: DataFrame, blocks: int, shelf: int) -> DataFrame:
    """Packed counts of the pairs of neighbouring words, counted per task."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Keys(dict):
            def __missing__(self, word: bytes) -> bytes:
                key = self[word] = word_key(word).to_bytes(8, "little")
                return key

        keys, runs, held = Keys(), [], 0

        def flush() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(runs), return_counts=True)
            runs.clear()
            return pa.RecordBatch.from_pandas(_packed(pair, n.astype(np.int64), blocks, shelf), preserve_index=False)

        for batch in batches:
            if len(keys) > TASK_WORDS:
                keys = Keys()
            first, last, find = keys[START], keys[END], keys.__getitem__
            texts = [words(t) for t in batch.column("text").to_pylist()]
            for some in parts_of(texts):
                key = np.frombuffer(b"".join([first + b"".join(map(find, t)) + last for t in texts[some]]), "<u8")
                inside = np.ones(len(key), bool)
                inside[np.cumsum([len(t) + 2 for t in texts[some]]) - 1] = False
                inside = np.flatnonzero(inside)
                runs.append(pair_key(key[inside], key[inside + 1]))
                held += len(inside)
                if held > TASK_TOKENS:
                    yield flush()
                    held = 0
        if runs:
            yield flush()

    return train.mapInArrow(tally, PACKED)


def _word_keys(vocabulary: DataFrame, blocks: int, shelf: int) -> DataFrame:
    """Packed counts of words; START occurs as often as END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            key, n = map(np.concatenate, zip(*held))
            order = np.argsort(key)
            return pa.RecordBatch.from_pandas(_packed(key[order], n[order], blocks, shelf), preserve_index=False)

        for batch in batches:
            found, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            if END in found:
                found, n = [*found, START], np.append(n, n[found.index(END)])
            held.append((np.fromiter(map(word_key, found), np.uint64, len(found)), n))
            if sum(len(k) for k, _ in held) > TASK_WORDS:
                yield flush()
                held = []
        if held:
            yield flush()

    return vocabulary.mapInArrow(run, PACKED)


def _blocks_filled(entries: DataFrame, blocks: int) -> DataFrame:
    """(block, bits) from packed counts; a task holds the keys of one shelf at a time, whose
    number hashing bounds."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[bytes, bytes]] = []
        shelf = None

        def close() -> pd.DataFrame:
            key, n = (np.concatenate([np.frombuffer(x, kind) for x in part]) for part, kind in zip(zip(*held), ("<u8", "<i8")))
            order = np.argsort(key)
            key, n = key[order], n[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            key, n = key[first], np.add.reduceat(n, first)
            block = block_of(key, blocks)
            cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            made = []
            for a, b in zip(cuts, [*cuts[1:].tolist(), len(key)]):
                cells = np.zeros(CELLS, np.uint64)
                fill(cells, key[a:b], n[a:b])
                made.append(cells.tobytes())
            return pd.DataFrame({"block": block[cuts].astype(np.int64), "bits": made})

        for batch in batches:
            for number, keys, counts in zip(batch["shelf"], batch["keys"], batch["counts"]):
                if held and number != shelf:
                    yield close()
                    held = []
                shelf = number
                held.append((keys, counts))
        if held:
            yield close()

    return entries.repartition("shelf").sortWithinPartitions("shelf").mapInPandas(build, "block long, bits binary")


def score_documents(
    docs: DataFrame, folds: int = 7, held_out: int = 2, weight: float = 0.8, prior: float = 2.0, head: int = 100_000, most_bytes: int = 1 << 27
) -> DataFrame:
    """documents -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Learns from rows whose crc32(doc_id as text) modulo ``folds`` is not
    ``held_out`` (a null doc_id trains). A null text is an empty one: its only
    token is the end. ``base_score`` uses exact counts: those of the ``head`` most
    frequent words by broadcast, the rest by a join. With no training rows every
    count is 0. Each row gives a row, also when doc_ids repeat or are null.
    ``most_bytes`` bounds what is broadcast at a time, not the filter. See
    :meth:`Scorer.score` for ``weight`` and ``prior``.
    """
    sc = docs.sparkSession.sparkContext
    rows = small_batches(docs).select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"), (~training_part(F.col("doc_id"), folds, held_out)).alias("held_out")
    )
    train = rows.where(~F.col("held_out")).select("text")
    size = train.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks, group = max(1, size // 10 // BLOCK), max(1, most_bytes // BLOCK)
    shelf = min(16, 1 + blocks // 4096)
    vocabulary = stash(word_counts(train))
    totals = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct")).first()
    entries = pair_counts(train, blocks, shelf).unionByName(_word_keys(vocabulary, blocks, shelf))
    filled = stash(_blocks_filled(entries, blocks))

    def loaded(low: int):
        cells = np.zeros(min(group, blocks - low) * CELLS, np.uint64)
        for r in filled.where((F.col("block") >= low) & (F.col("block") < low + group)).toLocalIterator():
            at = (r["block"] - low) * CELLS
            cells[at : at + CELLS] = np.frombuffer(r["bits"], np.uint64)
        return sc.broadcast((cells, blocks, totals["tokens"], totals["distinct"], weight, prior, low))

    def probed(state: DataFrame, model) -> DataFrame:
        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(*model.value)
            for batch in batches:
                texts, seen, out = [words(t) for t in batch.column("text").to_pylist()], batch.column("seen").to_pylist(), []
                for some in parts_of(texts):
                    out += scorer.levels(texts[some], None if None in seen else seen[some])
                yield batch.set_column(batch.schema.get_field_index("seen"), "seen", pa.array(out, pa.binary()))

        return stash(state.mapInArrow(probe, "row long, doc_id long, text binary, held_out boolean, seen binary"))

    state = rows.withColumn("seen", F.lit(None).cast("binary"))
    *earlier, last = range(0, blocks, group)
    for low in earlier:
        some = loaded(low)
        new = probed(state, some)
        some.destroy()
        release(state)
        state = new
    model = loaded(last)
    release(filled)

    least, common = frequent(vocabulary, head)
    known = sc.broadcast({bytes(r["word"]): r["n"] for r in common.toLocalIterator()})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value, known=known.value)
        for batch in batches:
            texts, seen = [words(t) for t in batch.column("text").to_pylist()], batch.column("seen").to_pylist()
            for some in parts_of(texts):
                found, hits, base, rare = scorer.score(texts[some], None if None in seen else seen[some])
                part = batch.slice(some.start, some.stop - some.start)
                made = [part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array([len(t) + 1 for t in texts[some]], pa.int64()), pa.array(hits), pa.array(base), pa.array(found), pa.array(rare, pa.list_(pa.binary()))]
                yield pa.record_batch(made, ["row", "doc_id", "held_out", "n_tokens", "hits", "base", "score", "rare"])

    parts = stash(state.mapInArrow(score, "row long, doc_id long, held_out boolean, n_tokens long, hits long, base double, score double, rare array<binary>"))
    if earlier:
        release(state)
    rest = (
        parts.where("size(rare) > 0").select("row", F.explode("rare").alias("word"))
        .join(vocabulary.where(F.col("n") < F.lit(least)), "word")
        .groupBy("row")
        .agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("logs"))
    )
    scale = F.log10(F.lit(float(totals["tokens"] + totals["distinct"] + 1)))
    return parts.drop("rare").join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hits") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(totals["tokens"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * scale).alias("base_score"),
        "score",
    )
