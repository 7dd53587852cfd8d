"""Chat formatting: heterogeneous records to canonical turns to one template. DataFrame functions only.

Which layout a record has is read off the record: the nested paths of its fields that hold a
value are sorted and hashed, and the hash selects a declarative mapping. A mapping names its
required and optional paths and says how they become turns. A table has a layout if it has the
required paths. A record that holds a value at some of a layout's paths only, and at none of
another's, has that layout, its other texts being null. Records whose fingerprint no mapping
knows, or several do, keep null turns (``canonical_turns``), so nothing is guessed; they are
returned as they are by ``unmatched`` and beside the formatted chats by ``format_table``.

The template writes each turn as ``<|role|>``, a line break, the text, ``<|end|>`` and a line
break. Inside role and text the characters ``~ < [ |`` are written ``~0 ~1 ~2 ~3``; no
control string can then occur in them, and undoing it in the order 3, 2, 1, 0 gives the
input back. The loss mask lists, per assistant turn, where its text lies: number of the turn,
start within the turn, length, and start in the whole (code points).

Defined cases: null role or text counts as empty; a null turn number sorts first; equal
numbers are ordered by role and text; a null conv_id is a conversation of its own; an empty
table gives an empty result; columns no mapping names are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("|", "~3"))
END = "<|end|>\n"
TURN = "struct<turn:bigint,role:string,text:string>"


@dataclass(frozen=True)
class Layout:
    """required, optional: field paths; turns: a column of TURN arrays made from the record."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: Callable[[], Column]

    def fingerprints(self) -> list[str]:
        """The path sets a record of this layout can show."""
        return [
            _canonical((*self.required, *some))
            for n in range(len(self.optional) + 1)
            for some in combinations(self.optional, n)
        ]

    def partial_fingerprints(self) -> list[str]:
        """The path sets of records of which some required text is null."""
        paths = (*self.required, *self.optional)
        every = [_canonical(some) for n in range(1, len(paths) + 1) for some in combinations(paths, n)]
        whole = set(self.fingerprints())
        return [p for p in every if p not in whole]


def _canonical(paths) -> str:
    return "\n".join(sorted(paths))


def _turns(*pairs: tuple[str, Column]) -> Column:
    made = [
        F.struct(F.lit(i).cast("bigint").alias("turn"), F.lit(role).alias("role"), text.alias("text"))
        for i, (role, text) in enumerate(pairs)
    ]
    return F.array(*made).cast(f"array<{TURN}>")


def _messages(column: str, role: str, text: str) -> Column:
    return F.transform(
        column, lambda m, i: F.struct(i.cast("bigint").alias("turn"), m[role].alias("role"), m[text].alias("text"))
    ).cast(f"array<{TURN}>")


PROMPT = Layout("prompt", ("prompt", "response"), (), lambda: _turns(("user", F.col("prompt")), ("assistant", F.col("response"))))
INSTRUCTION = Layout(
    "instruction",
    ("instruction", "output"),
    ("input",),
    lambda: _turns(("user", F.concat_ws("\n", "instruction", "input")), ("assistant", F.col("output"))),
)
MESSAGES = Layout("messages", ("messages[].role",), ("messages[].content",), lambda: _messages("messages", "role", "content"))
FROM_VALUE = Layout("conversations", ("conversations[].from",), ("conversations[].value",), lambda: _messages("conversations", "from", "value"))
TURN_ROW = Layout(
    "turn rows",
    (),
    ("turn", "role", "text"),
    lambda: F.array(F.struct(F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string"))).cast(f"array<{TURN}>"),
)
LAYOUTS = (PROMPT, INSTRUCTION, MESSAGES, FROM_VALUE)


def _somewhere(array: Column, field: str) -> Column:
    return F.coalesce(F.exists(array, lambda m: m[field].isNotNull()), F.lit(False))


def _leaves(kind: T.DataType, path: str, value: Column) -> list[tuple[str, Column]]:
    """Leaf paths under a column, each with the test that the record holds a value there."""
    if isinstance(kind, T.StructType):
        return [x for f in kind for x in _leaves(f.dataType, f"{path}.{f.name}" if path else f.name, value[f.name])]
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StructType):
            return [(f"{path}[].{f.name}", _somewhere(value, f.name)) for f in kind.elementType]
        return [(f"{path}[]", value.isNotNull())]
    return [(path, value.isNotNull())]


def fingerprint(df: DataFrame, layouts=LAYOUTS) -> Column:
    """Hash of the sorted paths at which the record holds a value, among those any layout names."""
    known = {p for x in layouts for p in (*x.required, *x.optional)}
    found = [x for f in df.schema for x in _leaves(f.dataType, f.name, F.col(f"`{f.name}`")) if x[0] in known]
    return F.xxhash64(F.concat_ws("\n", *[F.when(there, F.lit(p)) for p, there in sorted(found, key=lambda x: x[0])]))


def _paths(df: DataFrame) -> set[str]:
    return {p for f in df.schema for p, _ in _leaves(f.dataType, f.name, F.col(f"`{f.name}`"))}


def _with_nothing(field: str) -> Callable[[Column], Column]:
    return lambda m: m.withField(field, F.lit(None).cast("string"))


def _completed(df: DataFrame, layouts) -> DataFrame:
    """The table with nulls at the optional paths of its layouts that it does not have."""
    for path in dict.fromkeys(p for x in layouts for p in x.optional if p not in _paths(df)):
        column, _, field = path.partition("[].")
        if not field:
            df = df.withColumn(column, F.lit(None).cast("string"))
        elif column in df.columns:
            df = df.withColumn(column, F.transform(column, _with_nothing(field)))
    return df


def _matched(df: DataFrame, layouts) -> tuple[DataFrame, list[tuple[Layout, Column]]]:
    """The completed table, and its layouts with the test that a record has it."""
    there = _paths(df)
    usable = [x for x in layouts if there.issuperset(x.required) and there.intersection((*x.required, *x.optional))]
    full = _completed(df, usable)
    code = fingerprint(full, usable) if usable else None
    whole = {p for x in usable for p in x.fingerprints()}
    some = [p for x in usable for p in x.partial_fingerprints()]
    known = [[*x.fingerprints(), *(p for p in x.partial_fingerprints() if p not in whole and some.count(p) == 1)] for x in usable]
    return full, [(x, code.isin(*[F.xxhash64(F.lit(p)) for p in k])) for x, k in zip(usable, known, strict=True)]


def canonical_turns(df: DataFrame, layouts=LAYOUTS, key: str = "conv_id") -> DataFrame:
    """key, layout and turns of each record; both null where no layout fits."""
    df, hits = _matched(df, layouts)
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(f"array<{TURN}>")
    for x, hit in hits:
        name, turns = F.when(hit, F.lit(x.name)).otherwise(name), F.when(hit, x.turns()).otherwise(turns)
    return df.select(F.col(key), name.alias("layout"), turns.alias("turns"))


def unmatched(df: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """The records no layout fits, with all columns they came with."""
    columns = df.columns
    df, hits = _matched(df, layouts)
    for _, hit in hits:
        df = df.where(~hit)
    return df.select(*[F.col(f"`{c}`") for c in columns])


def format_table(df: DataFrame, layouts=LAYOUTS, key: str = "conv_id", loss_role: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """``format_chats`` of a table's records, and the records no layout fits."""
    return format_chats(canonical_turns(df, layouts, key), key, loss_role), unmatched(df, layouts)


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(records: DataFrame, key: str = "conv_id", loss_role: str = "assistant") -> DataFrame:
    """key, formatted, loss: canonical turns of all records of a key under the template.

    ``loss`` holds struct(turn, offset, length, start), in order. Records without turns have
    nothing to format; ``unmatched`` returns them.
    """
    from pyspark.sql import Window

    rows = records.where("turns IS NOT NULL").select(F.col(key).alias("key"), F.explode("turns").alias("t"))
    role, text = (F.coalesce(F.col(f"t.{x}"), F.lit("")) for x in ("role", "text"))
    head = F.concat(F.lit("<|"), escape(role), F.lit("|>\n"))
    body = escape(text)
    parts = rows.select("key", F.col("t.turn").alias("turn"), role.alias("role"), head.alias("head"), body.alias("body"))
    order = Window.partitionBy("key").orderBy("turn", "role", "body")
    piece = F.concat("head", "body", F.lit(END))
    numbered = parts.select(
        "key",
        (F.row_number().over(order) - 1).alias("n"),
        piece.alias("piece"),
        F.when(F.col("role") == loss_role, F.length("head")).alias("offset"),
        F.length("body").alias("length"),
        F.coalesce(F.sum(F.length(piece).cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    all_turns = numbered.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "piece", "offset", "length", "before"))).alias("p"))
    loss = F.transform(
        F.filter("p", lambda x: x["offset"].isNotNull()),
        lambda x: F.struct(
            x["n"].alias("turn"), x["offset"].alias("offset"), x["length"].alias("length"), (x["before"] + x["offset"]).alias("start")
        ),
    )
    return all_turns.select(F.col("key").alias(key), F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, formatted, turns (role, text) and loss_text, from the formatted text and its mask alone."""
    ends = F.split("formatted", "<\\|end\\|>\n")
    pieces = formatted.select(key, "formatted", "loss", F.slice(ends, F.lit(1), F.greatest(F.size(ends) - 1, F.lit(0))).alias("pieces"))

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "|>\n", 1)
        return F.struct(
            unescape(F.substring(head, 3, 1 << 30)).alias("role"),
            unescape(F.substr(p, F.length(head) + 4)).alias("text"),
        )

    masked = F.transform("loss", lambda s: unescape(F.substr(F.element_at("pieces", s["turn"] + 1), s["offset"] + 1, s["length"])))
    return pieces.select(key, "formatted", F.transform("pieces", turn).alias("turns"), F.array_join(masked, "").alias("loss_text"))
