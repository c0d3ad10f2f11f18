"""The pipeline on a small fixture, against what each stage must decide."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from knowntime.llm import jaccard
from knowntime.llm._shared import stash

WORDS = {"en": "the quick brown fox jumps over lazy dogs while rain falls".split(), "de": "über straße größe und der hund läuft schnell nach hause".split()}


def test_pipeline(spark, tmp_path):
    rng = random.Random(5)

    def text(lang, n):
        return " ".join(rng.choice(WORDS[lang]) + rng.choice(WORDS[lang])[:3] for _ in range(n))

    rows = [(i, text(k, rng.randrange(30, 300)), k) for i, k in enumerate(rng.choice(["en", "de"]) for _ in range(120))]
    item, secret = text("en", 25), hashlib.sha1(b"s").hexdigest()
    rows += [(200, rows[3][1], "en"), (201, rows[3][1], "en"), (202, text("en", 60) + " " + item + " " + text("en", 60), "en"), (203, text("en", 50) + f' token = "{secret}" ' + text("en", 50), "en"), (204, "12345 --", "en"), (205, None, "en"), (206, "", "de")]
    spark.createDataFrame([(*r, "src", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stash(stage(spark, docs, str(tmp_path)))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        seen.append({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    assert set(seen[0]) == {r[0] for r in rows} - {204, 205, 206}
    assert set(seen[1]) == set(seen[0]) - {200, 201}
    assert set(seen[2]) == set(seen[1]) - {202}
    assert set(seen[3]) == set(seen[2]) and secret not in seen[3][203] and "[SECRET]" in seen[3][203]
    assert all(seen[3][i] == dict((a, b) for a, b, _ in rows)[i] for i in seen[3] if i != 203)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(seen[3])
    assert zlib.crc32(b"") == 0 and sum(r.length for r in packed) <= 4096 * len({r.sequence_id for r in packed})


def _kept(spark, rows):
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, at int")
    return {r["at"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}


def closure(texts, ids):
    """(number of near pairs, {any member: smallest id of its group}) by comparing all pairs."""

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    near = 0
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                near += sets[i] != sets[j]
                up[find(i)] = find(j)
    best = {}
    for i in range(len(texts)):
        best[find(i)] = min(best.get(find(i), ids[i]), ids[i])
    return near, best


def template(seed, n):
    """``n`` texts on one template, most pairs at a similarity of 0.73 to 0.78, and one more at 0.805 of the first."""
    rng = random.Random(seed)
    base = [f"t{seed}w{i}" for i in range(328)]

    def edited(words, edits):
        words = list(words)
        for at in rng.sample(range(5, 320, 6), edits):
            words[at] = f"e{rng.random()}"
        return words

    texts = [edited(base, 5) for _ in range(n)]
    return [" ".join(t) for t in [*texts, edited(texts[0], 7)]]


def test_template_groups_lose_no_link(spark):
    groups = [template(seed, 100) for seed in range(10)]
    want = set()
    for g, texts in enumerate(groups):
        ids = list(range(1000 * g, 1000 * g + len(texts)))
        near, best = closure(texts, ids)
        assert near > 0 and len(best) > 50
        want |= set(best.values())
    rows = [(1000 * g + i, t) for g, texts in enumerate(groups) for i, t in enumerate(texts)]
    got = _kept(spark, rows)
    assert {rows[k][0] for k in got} == want


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 1 << 18)  # some dozen tiles
    texts = template(77, 500)
    near, best = closure(texts, list(range(len(texts))))
    assert near > 0 and {i for i in _kept(spark, list(enumerate(texts)))} == set(best.values())


def test_intersections_equal_set_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 30_000, rng.integers(0, 9000)).astype(np.uint64)) for _ in range(12)]
    got = jaccard.intersections(sets[:5], sets[5:])
    assert [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]] == got.tolist()


def test_clashing_columns(spark):
    rows = [(1, b"same text here", "a", 7), (2, b"same text here", "b", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text binary, __row string, node int")
    out = corpus_pipeline.near_dedup(spark, docs.select("doc_id", F.col("text").cast("string").alias("text"), "__row", F.col("node").alias("__ROW_")), "")
    assert [(r.doc_id, r["__row"]) for r in out.collect()] == [(1, "a")] and out.columns == ["doc_id", "text", "__row", "__ROW_"]


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randrange(len(base) // 30 + 1)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(5000)}"
            texts.append(" ".join(copy))
    base = [f"v{k}" for k in range(200)]
    for k in range(150):  # a chain whose ends differ, and everything in between
        texts.append(" ".join(f"z{i}" if i < k // 5 else w for i, w in enumerate(base)) + f" t{k}")
    texts += ["two words", "Two  WORDS", "other", None, "", " "]
    ids = list(range(len(texts)))
    rng.shuffle(ids)

    near, best = closure(texts, ids)
    assert near > 50
    assert {ids[k] for k in _kept(spark, list(zip(ids, texts)))} == set(best.values())


def test_null_and_repeated_ids_lose_no_text(spark):
    one, two, three = ("%s " * 30 % tuple(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [(None, one), (None, two), (7, two), (4, three), (4, "short other text"), (9, "short other text"), (4, "third text of one id"), (5, three)]
    assert _kept(spark, rows) == {0, 2, 3, 4, 6}
    assert len(_kept(spark, [(1, one), (1, one), (None, one)])) == 1 and _kept(spark, []) == set()


def test_near_dedup_uses_the_simhash_index(spark):
    """Fingerprints that links within three bits connect share the first key, whatever their bands."""
    fps = [0, 0b111, 0b111111, 1 << 40 | 0b1111 << 50, (1 << 63) - 1, -1]
    rows = jaccard.stash(spark.createDataFrame([(i, fp, [100 + i]) for i, fp in enumerate(fps)], "node long, fp long, keys array<long>"))
    got = {r.node: r["keys"] for r in jaccard.with_index_key(rows).collect()}
    assert [got[i][1:] for i in range(6)] == [[100 + i] for i in range(6)]
    first = [got[i][0] for i in range(6)]
    assert first[0] == first[1] == first[2] and first[4] == first[5] and len(set(first)) == 3


def test_near_dedup_signs_with_simhash(spark):
    """A long text with one word changed lies within the index's reach and is found by its key alone."""
    text = " ".join(f"w{i * i % 997}" for i in range(900))
    docs = spark.createDataFrame([(0, text), (1, text + " end"), (2, " ".join(f"v{i * i % 991}" for i in range(900)))], "row long, text string")
    signed = jaccard.stash(jaccard._signatures(docs, 5).select(F.col("row").alias("node"), "fp", "keys"))
    keyed = jaccard.stash(jaccard.with_index_key(signed).select("node", F.slice("keys", 1, 1).alias("keys")))
    links = jaccard.similar_links(docs, keyed, 5, 0.8)
    assert links is not None and [(r.a, r.b) for r in links.collect()] == [(0, 1)]
