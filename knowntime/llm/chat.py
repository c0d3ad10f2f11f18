"""Chat formatting by schema fingerprints, with built-in functions only.

A record's layout is known by a hash over its sorted nested field paths (a path
counts when the record has a value there). The hash selects a declarative
:class:`Layout`, whose expressions turn prompt, instruction and message records
into canonical turns (role, text). ``render`` writes turns as one string whose
control strings cannot occur inside a text, and ``read_back`` inverts it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Opens every control string; the rest of it follows. A tilde between both makes it plain text.
_CONTROL = r"(?=\||/?s>|/?INST\]|</?SYS>>)"
END = "<|end|>\n"


@dataclass(frozen=True)
class Layout:
    """How one family of records maps to turns.

    Either ``array`` (a list of messages with ``role`` and ``text`` fields) or
    ``turns`` ((role, path, ...): texts of several paths are joined by a blank
    line). ``optional`` paths may be missing in a record. ``roles`` renames roles; it is
    empty for conversation rows, whose roles stay as they are.
    """

    name: str
    turns: tuple[tuple[str, ...], ...] = ()
    array: str | None = None
    role: str = "role"
    text: str = "content"
    order: str | None = None
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=lambda: {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"})

    def paths(self) -> list[str]:
        if self.array:
            names = [self.role, self.text] + ([self.order] if self.order else [])
            return [f"{self.array}[].{n}" for n in names]
        return [p for _, *paths in self.turns for p in paths]


LAYOUTS = (
    Layout("messages", array="messages", optional=("messages[].role", "messages[].content")),
    Layout("rows", array="rows", text="text", order="turn", optional=("rows[].role", "rows[].text", "rows[].turn"), roles={}),
    Layout("from_value", array="conversations", role="from", text="value", optional=("conversations[].value",)),
    Layout("prompt_completion", turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", turns=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("instruction", turns=(("system", "system"), ("user", "instruction", "input"), ("assistant", "output")), optional=("system", "input")),
    Layout("question_answer", turns=(("user", "question"), ("assistant", "answer"))),
)


def _leaves(col: Column, kind: T.DataType, path: str) -> list[tuple[str, Column]]:
    """(path, has a value) for every leaf below ``col``."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _leaves(col.getField(f.name), f.dataType, f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        def some(name: str, inner: T.DataType) -> Column:
            return F.coalesce(F.exists(col, lambda e: _leaves(e.getField(name), inner, "")[0][1]), F.lit(False))

        return [(f"{path}[].{f.name}", some(f.name, f.dataType)) for f in kind.elementType.fields]
    return [(path, col.isNotNull())]


def fingerprint(paths: Sequence[str]) -> Column:
    return F.xxhash64(F.lit("\n".join(sorted(paths))))


def _record_fingerprint(df: DataFrame, keep: Sequence[str]) -> Column:
    leaves = [x for f in df.schema.fields if f.name not in keep for x in _leaves(F.col(f"`{f.name}`"), f.dataType, f.name)]
    return F.xxhash64(F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(has, F.lit(p)) for p, has in leaves]))), "\n"))


def _turns(layout: Layout) -> Column:
    def turn(role: Column, text: Column) -> Column:
        role = F.coalesce(role.cast("string"), F.lit(""))
        named = role
        for old, new in layout.roles.items():
            named = F.when(role == old, F.lit(new)).otherwise(named)
        return F.struct(named.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))

    if layout.array:
        items = F.array_sort(layout.array) if layout.order else F.col(layout.array)
        return F.transform(items, lambda m: turn(m[layout.role], m[layout.text]))
    made = [
        F.when(F.coalesce(*[F.col(p) for p in paths]).isNotNull(), turn(F.lit(role), F.array_join(F.array_compact(F.array(*[F.nullif(F.col(p), F.lit("")) for p in paths])), "\n\n")))
        for role, *paths in layout.turns
    ]
    return F.array_compact(F.array(*made))


def canonical_turns(records: DataFrame, keep: Sequence[str] = (), layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """records -> keep columns, layout, turns array<struct<role, text>>.

    A record that no layout fits has null ``layout`` and ``turns``; a null text
    or role becomes empty. Columns in ``keep`` take no part in the fingerprint.
    """
    columns = {f.name: f.dataType for f in records.schema.fields}
    there = {p for n, k in columns.items() if n not in keep for p, _ in _leaves(F.col(f"`{n}`"), k, n)}
    marked = records.withColumn("__fingerprint", _record_fingerprint(records, keep))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in reversed(layouts):
        needed = set(layout.paths())
        if not needed <= there | set(layout.optional) or (layout.array or "") not in {"", *columns}:
            continue
        if layout.array is None:
            have = needed & there
            layout = Layout(layout.name, turns=tuple(t for t in ((r, *[p for p in ps if p in have]) for r, *ps in layout.turns) if len(t) > 1), optional=layout.optional, roles=layout.roles)
            needed = have
        spare = sorted(needed & set(layout.optional))
        shapes = [needed - set(gone) for k in range(len(spare) + 1) for gone in combinations(spare, k)]
        fits = F.lit(False)
        for shape in shapes:
            if shape:
                fits = fits | (F.col("__fingerprint") == fingerprint(sorted(shape)))
        name = F.when(fits, F.lit(layout.name)).otherwise(name)
        turns = F.when(fits, _turns(layout)).otherwise(turns)
    return marked.select(*[F.col(f"`{c}`") for c in keep], name.alias("layout"), turns.alias("turns"))


def escaped(text: Column) -> Column:
    """No control string of the template is left in the result; ``unescaped`` inverts it."""
    return F.regexp_replace(text, r"([<\[])(~*)" + _CONTROL, "$1~$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])~(~*)" + _CONTROL, "$1$2")


def _segments(turn: Column) -> Column:
    role = F.replace(F.replace(turn["role"], F.lit("~"), F.lit("~0")), F.lit("|"), F.lit("~1"))
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), escaped(turn["text"]), F.lit(END))


def render(turns: Column) -> Column:
    """Turns as one string: ``<|role|>``, line feed, escaped text, ``<|end|>``, line feed, for each."""
    return F.array_join(F.transform(turns, _segments), "")


def read_back(formatted: Column) -> Column:
    """array<struct<role, body, loss>> of a rendered string: ``body`` is still escaped,
    ``loss`` marks the assistant's bodies, the only text under the loss mask."""

    def parse(piece: Column) -> Column:
        head = F.substring_index(piece, "|>\n", 1)
        role = F.replace(F.replace(F.substring(head, F.lit(3), F.length(head)), F.lit("~1"), F.lit("|")), F.lit("~0"), F.lit("~"))
        body = F.substring(piece, F.length(head) + 4, F.length(piece))
        return F.struct(role.alias("role"), body.alias("body"), (role == "assistant").alias("loss"))

    pieces = F.split(formatted, r"<\|end\|>\n", -1)
    return F.transform(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), parse)


def format_records(records: DataFrame, keep: Sequence[str] = (), layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """records -> keep columns, layout, formatted, segments (see :func:`read_back`)."""
    out = canonical_turns(records, keep, layouts).withColumn("formatted", render(F.col("turns")))
    return out.select(*[F.col(f"`{c}`") for c in keep], "layout", "formatted", read_back(F.col("formatted")).alias("segments"))


def conversations_as_records(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows -> one record per conversation, rows ordered by
    turn (null first), then role and text; repeated rows stay, extra columns are not read."""
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
