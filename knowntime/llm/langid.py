"""Language identification by a byte convolutional network trained in numpy.

Bytes are embedded, filters of several widths slide over fixed windows, each
filter keeps its largest response (max pooling) and a softmax layer follows.
Training runs on a bounded sample of labelled texts (:data:`PER_LABEL` texts of a
label in expectation, :data:`WINDOWS_PER_TEXT` windows of each). Prediction reads
every window of every text; as embeddings and filters are linear before the
maximum, they are folded into tables over byte pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowntime.llm._shared import small_batches, training_part

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
PER_LABEL = 500
MOST_BROADCAST = 100_000  # labels whose counts are sent to every task
MOST_ROWS = 500_000  # texts that all labels together are learned from, in expectation
WINDOWS_PER_TEXT = 3
LETTER = regex.compile(r"\p{L}")


def windows(text: bytes) -> np.ndarray:
    """Rows of WINDOW bytes that cover the text, the last one filled with zeros."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


@dataclass
class ByteCnn:
    labels: list[str]
    embed: np.ndarray
    conv: list[np.ndarray]  # per width: (width, EMBED, FILTERS)
    bias: np.ndarray
    dense: np.ndarray
    shift: np.ndarray

    @staticmethod
    def train(x: np.ndarray, y: np.ndarray, labels: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteCnn:
        """Fit by Adam; ``x`` holds windows, ``y`` label numbers."""
        rng = np.random.default_rng(seed)
        p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "bias": np.zeros(len(WIDTHS) * FILTERS), "dense": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))), "shift": np.zeros(len(labels))}
        for w in WIDTHS:
            p[f"conv{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS))
        m = {k: np.zeros_like(v) for k, v in p.items()}
        s = {k: np.zeros_like(v) for k, v in p.items()}
        step = 0
        for _ in range(epochs if len(x) else 0):
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                step += 1
                some, n = x[order[at : at + batch]], len(order[at : at + batch])
                e, rows = p["embed"][some], np.arange(n)[:, None]
                tops, places = [], []
                for w in WIDTHS:
                    z = sum(e[:, o : WINDOW - w + 1 + o] @ p[f"conv{w}"][o] for o in range(w))
                    places.append(z.argmax(1))
                    tops.append(np.take_along_axis(z, places[-1][:, None], 1)[:, 0])
                raw = np.concatenate(tops, 1) + p["bias"]
                h = np.maximum(raw, 0)
                logit = h @ p["dense"] + p["shift"]
                prob = np.exp(logit - logit.max(1, keepdims=True))
                prob /= prob.sum(1, keepdims=True)
                d = prob
                d[np.arange(n), y[order[at : at + batch]]] -= 1
                d /= n
                g = {"dense": h.T @ d, "shift": d.sum(0), "embed": np.zeros_like(p["embed"])}
                dh = (d @ p["dense"].T) * (raw > 0)
                g["bias"] = dh.sum(0)
                for k, w in enumerate(WIDTHS):
                    dk, place = dh[:, k * FILTERS : (k + 1) * FILTERS], places[k]
                    g[f"conv{w}"] = np.zeros_like(p[f"conv{w}"])
                    for o in range(w):
                        g[f"conv{w}"][o] = np.einsum("nf,nfe->ef", dk, e[rows, place + o])
                        np.add.at(g["embed"], some[rows, place + o], dk[:, :, None] * p[f"conv{w}"][o].T[None])
                for k, v in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.999 * s[k] + 0.001 * v * v
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        return ByteCnn(labels, p["embed"], [p[f"conv{w}"] for w in WIDTHS], p["bias"], p["dense"], p["shift"])

    def tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """Per width: (offset, table over the byte pair or byte there), summing to the responses."""
        out = []
        for w, conv in zip(WIDTHS, self.conv):
            one = [(self.embed @ conv[o]).astype(np.float32) for o in range(w)]
            two = [(o, (one[o][:, None] + one[o + 1][None]).reshape(65536, FILTERS)) for o in range(0, w - 1, 2)]
            out.append(two + ([(w - 1, one[-1])] if w % 2 else []))
        return out

    def probabilities(self, x: np.ndarray, tables: list[list[tuple[int, np.ndarray]]], chunk: int = 512) -> np.ndarray:
        """Softmax of each window."""
        out = np.empty((len(x), len(self.labels)))
        for at in range(0, len(x), chunk):
            some = x[at : at + chunk]
            pair = (some[:, :-1].astype(np.int32) << 8) | some[:, 1:]
            tops = []
            for w, parts in zip(WIDTHS, tables):
                n = WINDOW - w + 1
                z = None
                for o, table in parts:
                    got = np.take(table, (pair if len(table) == 65536 else some)[:, o : o + n], axis=0)
                    z = got if z is None else np.add(z, got, out=z)
                tops.append(z.max(1))
            logit = np.maximum(np.concatenate(tops, 1) + self.bias, 0) @ self.dense + self.shift
            prob = np.exp(logit - logit.max(1, keepdims=True))
            out[at : at + chunk] = prob / prob.sum(1, keepdims=True)
        return out


def training_sample(docs: DataFrame, per_label: int, most_rows: int, folds: int, held_out: int) -> DataFrame:
    """(doc_id, label, part): windows' worth of text at hashed places of a hashed share of each
    label's texts. The share makes ``per_label`` texts of a label in expectation, repeated rows
    counted once, and fewer of each where that would be more than ``most_rows`` of all labels."""
    part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where(
        training_part(F.col("doc_id"), folds, held_out) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    sizes = part.groupBy("lang").agg(F.count("*").alias("n"))
    labels = sizes.count()

    def share(*of):
        return F.pmod(F.xxhash64(*of), F.lit(1 << 30)) / F.lit(float(1 << 30))

    each = min(float(per_label), most_rows / max(1, labels))
    small = labels <= MOST_BROADCAST  # else the texts of a label meet its count by a shuffle
    chosen = part.join(F.broadcast(sizes) if small else sizes, "lang").where(share("doc_id", "text") * F.col("n") < each)
    spots = F.transform(
        F.sequence(F.lit(1), F.lit(WINDOWS_PER_TEXT)),
        lambda k: F.substring(F.col("text"), (F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), k), F.greatest(F.length("text") - WINDOW, F.lit(1))) + 1).cast("int"), F.lit(WINDOW)),
    )
    return chosen.select("doc_id", F.col("lang").alias("label"), F.explode(spots).alias("part")).distinct()


def fit(docs: DataFrame, per_label: int = PER_LABEL, folds: int = 4, held_out: int = 2, most_rows: int = MOST_ROWS) -> ByteCnn:
    rows = sorted((r["label"], r["doc_id"] or 0, r["part"]) for r in training_sample(docs, per_label, most_rows, folds, held_out).collect())
    labels = sorted({label for label, _, _ in rows})
    x = np.concatenate([windows(part.encode("utf-8")[:WINDOW]) for _, _, part in rows]) if rows else np.zeros((0, WINDOW), np.uint8)
    return ByteCnn.train(x, np.array([labels.index(label) for label, _, _ in rows], np.int64), labels)


def _decide(cnn: ByteCnn, tables: list, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(labels, scores) of whole texts, some megabytes of windows at a time."""
    raw = [t.encode("utf-8") if t and cnn.labels and LETTER.search(t) else b"" for t in texts]
    label, score = np.full(len(raw), "und", object), np.zeros(len(raw))
    at = 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size < 1_000_000):
            size += len(raw[end])
            end += 1
        full = [k for k in range(at, end) if raw[k]]
        at = end
        if not full:
            continue
        x = [windows(raw[k]) for k in full]
        weight = np.concatenate([np.minimum(WINDOW, len(raw[k]) - WINDOW * np.arange(len(w))) for k, w in zip(full, x)])
        first = np.cumsum([0, *map(len, x)])[:-1]
        prob = np.add.reduceat(cnn.probabilities(np.concatenate(x), tables) * weight[:, None], first) / np.add.reduceat(weight, first)[:, None]
        label[full] = np.array(cnn.labels, object)[prob.argmax(1)]
        score[full] = np.minimum(prob.max(1), 1.0)
    return label, score


def identify(docs: DataFrame, per_label: int = PER_LABEL, folds: int = 4, held_out: int = 2, most_rows: int = MOST_ROWS) -> DataFrame:
    """documents with text and lang -> (doc_id, held_out, lang_pred, score), a row for each row.

    Learns from rows whose crc32(doc_id as text) modulo ``folds`` is not
    ``held_out`` and whose lang is not null. A text's probabilities are the mean
    over its windows, weighted by their bytes; ``score`` is the largest. A text
    that is null or holds no letter is ``und`` with score 0, and so is every
    text when there is nothing to learn from.
    """
    model = fit(docs, per_label, folds, held_out, most_rows)
    sent = docs.sparkSession.sparkContext.broadcast((model.labels, model.embed, model.conv, model.bias, model.dense, model.shift))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cnn = ByteCnn(*sent.value)
        tables = cnn.tables()
        for batch in batches:
            label, score = _decide(cnn, tables, batch["text"])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": label, "score": score})

    rows = small_batches(docs).select(F.col("doc_id").cast("long"), (~training_part(F.col("doc_id"), folds, held_out)).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInPandas(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def drop_unidentified(docs: DataFrame, least: float = 0.4, per_label: int = PER_LABEL, most_rows: int = MOST_ROWS) -> DataFrame:
    """documents whose language is found with a score of ``least`` or more; columns as given.

    Rows are filtered where they lie, so no text is shuffled.
    """
    model = fit(docs, per_label, most_rows=most_rows)
    sent = docs.sparkSession.sparkContext.broadcast((model.labels, model.embed, model.conv, model.bias, model.dense, model.shift))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cnn = ByteCnn(*sent.value)
        tables = cnn.tables()
        for batch in batches:
            label, score = _decide(cnn, tables, batch.column("text").to_pylist())
            yield batch.filter(pa.array((label != "und") & (score >= least)))

    return small_batches(docs).mapInArrow(keep, docs.schema)
