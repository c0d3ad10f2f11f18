"""Token counts without token ids: each distinct pre-token is counted once.

A byte-level BPE never merges across pre-tokens, so a text's count is the sum
over its pre-tokens of their own counts. One pass gathers how often each
pre-token occurs and counts its pieces once; a second pass joins these counts to
the frequencies of every document. The most frequent pre-tokens (a number with a
fixed bound) are joined by broadcast inside the second pass, which leaves no hot
key for the shuffle join of the rest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowntime.llm._shared import frequent, small_batches, stash
from knowntime.llm.pretokens import BytePretokens

#: Distinct pre-tokens that a task holds before it passes its counts on.
TASK_KEYS = 100_000


def pretoken_sizes(docs: DataFrame, path: str) -> DataFrame:
    """documents -> (piece, n, tokens): each distinct pre-token, its occurrences, its tokens."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut, held = BytePretokens(path), Counter()
        for batch in batches:
            for text in batch["text"]:
                if text:
                    held.update(cut(text)[0])
                    if len(held) > TASK_KEYS:
                        yield pd.DataFrame({"piece": list(held.keys()), "n": list(held.values())})
                        held = Counter()
        if held:
            yield pd.DataFrame({"piece": list(held.keys()), "n": list(held.values())})

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = BytePretokens(path)
        for batch in batches:
            yield batch.assign(tokens=cut.sizes(batch["piece"].tolist()))

    counted = small_batches(docs).select(F.col("text").cast("string")).mapInPandas(tally, "piece string, n long")
    return counted.groupBy("piece").agg(F.sum("n").alias("n")).mapInPandas(measure, "piece string, n long, tokens int")


def token_counts(docs: DataFrame, path: str, limit: int = 512, head: int = 100_000) -> DataFrame:
    """documents -> (doc_id, n_bytes, n_tokens, over_limit), a row for each row.

    ``path`` names the tokenizer's file, which every worker must be able to read.
    Special strings in a text count as one token each, as is the library's
    default. A null text counts as empty: 0 bytes and tokens. ``head`` bounds the
    broadcast pre-tokens.
    """
    sizes = stash(pretoken_sizes(docs, path))
    least, common = frequent(sizes, head)
    known = docs.sparkSession.sparkContext.broadcast({r["piece"]: r["tokens"] for r in common.select("piece", "tokens").toLocalIterator()})

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut, lookup = BytePretokens(path), known.value.get
        for batch in batches:
            sums, rare = [], []
            for text in batch["text"]:
                found, special = cut(text) if text else ([], 0)
                values = list(map(lookup, found))
                misses = [p for p, v in zip(found, values) if v is None] if None in values else []
                sums.append(special + (sum(v for v in values if v is not None) if misses else sum(values)))
                rare.append(misses)
            yield pd.DataFrame({"row": batch["row"], "doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "part": sums, "rare": rare})

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    )
    parts = stash(rows.mapInPandas(add_up, "row long, doc_id long, n_bytes long, part long, rare array<string>"))
    rest = (
        parts.where("size(rare) > 0").select("row", F.explode("rare").alias("piece"))
        .join(sizes.where(F.col("n") < F.lit(least)).select("piece", "tokens"), "piece")
        .groupBy("row")
        .agg(F.sum("tokens").alias("more"))
    )
    total = F.col("part") + F.coalesce("more", F.lit(0))
    return parts.select("row", "doc_id", "n_bytes", "part").join(rest, "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
