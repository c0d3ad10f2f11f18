"""Secret scanning with built-in functions only: fixed patterns plus windowed entropy.

Candidate strings (long runs of token characters) are classed as hexadecimal or
mixed; a window slides over each candidate while counts per character, and with
them the sum behind Shannon's entropy, are updated for the one character that
enters and the one that leaves. A candidate with a window over its class's
threshold is a secret unless the allow-list explains it (plain words, numbers,
paths, identifiers, placeholders, UUIDs). Of a candidate that the fixed patterns' spans
touch, each part that they leave free is judged by itself, if it fills a window.

Positions are code points, end exclusive. Null texts are scanned as empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in their listed order, the pattern searched, the group that must have ``least`` characters.
BASE_KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
CHUNK = 128  # matches whose positions are summed at a time
#: Bits per character that a window must reach, for either class.
THRESHOLDS = {"hex": 3.0, "mixed": 3.6}
ALLOWED = (
    r"^[A-Za-z]+$",
    r"^[0-9_=-]+$",
    r"^[A-Za-z]*[0-9]{0,4}$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)(example|placeholder|changeme|your[_-]|xxxx|abcdef|012345)",
    r"^(.)\1+$",
)

#: Words with up to 4 digits after them and numbers of up to 8 digits, joined by separators, the
#: first one a word: a candidate with this start and none of these faults. A pattern that repeats
#: a group says the same, but Java's matcher takes a stack frame for each repetition.
JOINED = r"^/?[A-Za-z]"
NOT_JOINED = r"[0-9][A-Za-z]|[A-Za-z][0-9]{5}|[0-9]{9}"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, rank, end, kind, value>> of the leftmost matches that are long enough.

    The text between matches and the matches themselves come from the same
    matcher, so their lengths add up to positions: within chunks of ``CHUNK`` matches
    first, then over chunks, as each step of a sum copies what it has gathered.
    """
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        measured = F.length(F.regexp_extract(pair["hit"], pattern, group)) if group else F.length(pair["hit"])
        span = F.struct(begin.alias("start"), F.lit(order).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), pair["hit"].alias("value"))
        return F.struct(end.alias("at"), F.when(measured >= least, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    def chunked(pairs: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.transform(F.sequence(F.lit(0), (F.size(pairs) - 1).cast("int")), lambda c: F.aggregate(pairs[c], start, step))

    def placed(chunks: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        bases = F.aggregate(chunks, start, lambda s, c: F.struct((s["at"] + c["at"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

        def moved(span: Column, base: Column) -> Column:
            return F.struct((span["start"] + base).alias("start"), span["rank"].alias("rank"), (span["end"] + base).alias("end"), span["kind"].alias("kind"), span["value"].alias("value"))

        return _let(bases, lambda b: F.flatten(F.transform(chunks, lambda c, j: F.transform(c["out"], lambda span: moved(span, b[j])))))

    def grouped(pairs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), lambda c: F.slice(pairs, c * CHUNK + 1, F.lit(CHUNK)))

    pairs = _let(found, lambda hits: F.arrays_zip(F.slice(between, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit")))
    return F.when(text.rlike(pattern), _let(_let(_let(pairs, grouped), chunked), placed)).otherwise(none)


def max_window_entropy(value: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy (bits a character) of any ``window`` characters of an ASCII string.

    Keeps sum(c*log2 c) over the counts c of a window's characters. A step changes two of
    its terms: the character that enters and the one that leaves have their counts told by
    the ``window - 1`` characters that both windows share, so a step costs the same
    everywhere.
    """

    def term(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))

    def more(c: Column) -> Column:
        return term(c + 1) - term(c)

    def slide(chars: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            first = F.greatest(i - window + 1, F.lit(1))

            def shared(at: Column) -> Column:
                return i - first - F.size(F.array_remove(F.slice(chars, first, i - first), F.element_at(chars, at)))

            total = s["sum"] + more(shared(i)) - F.when(i > window, more(shared(i - window))).otherwise(F.lit(0.0))
            return _let(total, lambda t: F.struct(t.alias("sum"), F.greatest(s["best"], F.when(i >= window, F.log2(F.lit(float(window))) - t / window).otherwise(F.lit(0.0))).alias("best")))

        init = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(1), F.size(chars)), init, step, lambda s: s["best"])

    found = _let(F.transform(F.split(value, ""), F.ascii), slide)
    return F.when(F.length(value) > 0, found).otherwise(F.lit(0.0))


def _free(span: Column, base: Column) -> Column:
    """The parts of ``span``, of ``WINDOW`` characters at least, that no span of ``base`` covers."""

    def part(start: Column, end: Column) -> Column:
        value = F.substring(span["value"], start - span["start"] + 1, end - start)
        return F.array(F.struct(start.alias("start"), span["rank"].alias("rank"), end.alias("end"), span["kind"].alias("kind"), value.alias("value")))

    def grown(s: Column, end: Column) -> Column:
        return F.when(end - s["at"] >= WINDOW, F.concat(s["out"], part(s["at"], end))).otherwise(s["out"])

    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")
    hits = F.filter(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
    init = F.struct(span["start"].alias("at"), none.alias("out"))
    parts = F.aggregate(hits, init, lambda s, b: F.struct(F.greatest(s["at"], b["end"]).alias("at"), grown(s, b["start"]).alias("out")), lambda s: grown(s, span["end"]))
    return F.when(F.size(base) == 0, F.array(span)).otherwise(parts)


def _suspicious(span: Column) -> Column:
    value = span["value"]
    explained = value.rlike(JOINED) & ~value.rlike(NOT_JOINED)
    for pattern in ALLOWED:
        explained = explained | value.rlike(pattern)
    least = F.when(value.rlike("^[0-9a-fA-F]+$"), THRESHOLDS["hex"]).otherwise(THRESHOLDS["mixed"])
    return F.when(explained, F.lit(False)).otherwise(max_window_entropy(value) >= least)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, text, base, spans), one row per row.

    ``base`` holds the fixed kinds' spans and ``spans`` these and the entropy
    method's, each an array<struct<start, rank, end, kind, value>> ordered by
    start and kind. Input columns other than doc_id and text are not read.
    """
    text = F.col("text")
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(
        "doc_id",
        "text",
        F.array_sort(F.concat(*[_spans(text, kind, i, p, g, n) for i, (kind, p, g, n) in enumerate(BASE_KINDS)])).alias("base"),
        _spans(text, "entropy", len(BASE_KINDS), CANDIDATE, 0, WINDOW).alias("candidates"),
    )
    found = found.withColumn("free", F.flatten(F.transform("candidates", lambda c: _free(c, F.col("base")))))
    return found.select(
        "doc_id",
        "text",
        "base",
        F.array_sort(F.concat("base", F.filter("free", _suspicious))).alias("spans"),
    )


def listing(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each maximal run of overlapping spans replaced by ``mark``."""
    init = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, span: Column) -> Column:
        fresh = span["start"] >= s["at"]
        out = F.when(fresh, F.concat(s["out"], F.substring(text, s["at"] + 1, span["start"] - s["at"]), F.lit(mark))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], span["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, init, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def redact_documents(docs: DataFrame) -> DataFrame:
    """documents with secrets replaced in ``text``; ``n_chars`` follows where it exists.

    Every row stays; null texts stay null. Columns and their order are kept.
    """
    found = scan_secrets(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), "text"))
    text = F.when(F.col("doc_id.text").isNull(), F.lit(None).cast("string")).otherwise(F.col("clean"))
    out = found.select("doc_id", redacted(F.col("text"), F.col("spans")).alias("clean"))
    columns = {c: F.col("doc_id").getField(c).alias(c) for c in docs.columns}
    columns["text"] = text.alias("text")
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("doc_id.text").isNull(), F.col("doc_id.n_chars")).otherwise(F.length("clean").cast(docs.schema["n_chars"].dataType)).alias("n_chars")
    return out.select(*columns.values())
