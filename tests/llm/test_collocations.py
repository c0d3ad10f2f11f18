"""SON mining against plain counting, in many shards and in one, odd texts included."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from knowntime.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, phrase string, n long, score string, range int"


def brute(docs, support=30, most=2000):
    f, n = Counter(), Counter()
    for text, lang in docs:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f["und" if lang is None else lang, tuple(words[i : i + size])] += 1
    f = {k: v for k, v in f.items() if v >= support}
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = [b for (other, q), b in f.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if all(100 * b < 80 * a for b in inside):
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:most])]


def texts(seed, count):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "delta", "epsilon", "zeta", "été", "naïve x", "\U0001f600", "ʼn", "x\x1cy", "z\x00"]
    marks = [" ", " ", " ", "\t", "  ", ", ", ". ", "\n", "\x0b", " ! ", ""]
    docs = []
    for i in range(count):
        parts = []
        for _ in range(rng.choice([0, 1, 5, 60])):
            parts.append(rng.choice(["new york city", "New York", rng.choice(words), rng.choice(words), f"w{rng.randrange(400)}"]) + rng.choice(marks))
        docs.append(("".join(parts), rng.choice(["en", "en", "fr", None, "und", ""])))
    return docs + [(None, "en"), ("", None), ("  \t. ,", "de"), ("the same line " * 3000, "en"), ("rare", "xx")]


def run(spark, docs, **more):
    df = spark.createDataFrame([(None, t, lang, "x", 1, "y", 2) for t, lang in docs], SCHEMA)
    return [tuple(r) for r in co.collocations(df, **more).collect()]


@pytest.mark.parametrize("size, distinct", [(3_000_000, 500_000), (300, 500_000), (4000, 90)])
def test_equals_plain_counts(spark, size, distinct):
    docs = texts(size, 500)
    got, want = run(spark, docs, support=6, shard=(size, distinct)), brute(docs, 6)
    assert sorted(got) == sorted(want) and len({g[0] for g in got}) > 3


def test_first_rows_and_ties(spark):
    docs = [(f"a{i} b{i}. " * 30, "en") for i in range(60)]  # all tie
    got = run(spark, docs, most=25)
    assert sorted(got) == sorted(brute(docs, most=25)) and len(got) == 25


def test_full_filter_is_exact(spark, monkeypatch):
    monkeypatch.setattr(co, "FILTER", 64 * 8)  # one cell a block lets nearly all pass
    docs = texts(9, 200)
    assert sorted(run(spark, docs, support=5)) == sorted(brute(docs, 5))


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(None, None)]) == []


def test_local_support_and_mining():
    rng = np.random.default_rng(1)
    shard = co.Shard()
    shard.add([" ".join(rng.choice(["a", "b", "c", "d"], 50)).encode() + b". a b" for _ in range(30)], ["en"] * 30)
    shard.close()
    one = shard.keys()
    keys, counts = co.mine(one, shard.word, 1)
    some, n = co.mine(one, shard.word, 7)  # pruning by parts loses nothing
    assert np.array_equal(some, keys[counts >= 7]) and np.array_equal(n, counts[counts >= 7]) and 0 < len(some) < len(keys)
    assert counts.sum() == sum(max(0, 50 - s + 1) + max(0, 2 - s + 1) for s in (2, 3, 4)) * 30
