"""Chat formatting by schema fingerprints, in DataFrame expressions only.

``canonical_turns`` takes records in any of the layouts of ``LAYOUTS``.  The
nested field paths that a record fills are hashed to a fingerprint; the
fingerprint selects the layout's declarative mapping, which turns the record
into rows (conversation, turn, role, text).  Fields that no layout knows do not
enter the fingerprint, so extra columns change nothing.  A record with a filled field of
turn rows (turn, role, text) is such a row, whatever other known fields are beside
them: these are extra columns too.  So are filled fields that would leave a record
without a layout: of the layouts whose fields it fills, the one with the most fields is
taken, ties by the order of ``LAYOUTS``.  Field names match in any case, as in Spark.

``format_chats`` renders each conversation with a template that marks turns and
escapes control strings inside texts, and gives the loss mask as spans over the
rendered string.  ``read_back`` recovers turns and masked text from that output.

Escaping: control strings start with ``<|``.  Inside a role or text every
``<``, k backslashes, ``|`` gets one more backslash (``<|`` becomes ``<\\|``), so
no ``<|`` is left and the step can be undone.  A role also has its backslashes
and line feeds written as ``\\b`` and ``\\n``, since a line feed ends it.

Defined results: null text or role counts as empty; rows with a null
conversation id form one conversation; turns are ordered by turn, then role,
then text (nulls first), so ties and repeated rows have one order; a record
that fills the fields of no layout is returned by ``unmatched`` and takes no part in
formatting; an empty table gives an empty result.  A conversation is one output string: its turns meet in
one row, whatever their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"

#: Other names of roles, applied where a layout asks for it.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """One known layout.  ``paths`` are the nested field paths it fills; ``turns``
    lists, in order, (role, path) for single fields; ``items`` is (array, role
    field, text field) for a list of messages; ``rows`` is (turn, role, text)
    where every record is a single turn."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None
    rows: tuple[str, str, str] | None = None
    rename: bool = False

    @property
    def fingerprint(self) -> str:
        return path_hash(self.paths)


def path_hash(paths: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


LAYOUTS = (
    Layout("turn_rows", ("turn", "role", "text"), rows=("turn", "role", "text")),
    Layout("messages", ("messages[].content", "messages[].role"), items=("messages", "role", "content")),
    Layout("messages_system", ("messages[].content", "messages[].role", "system"),
           turns=(("system", "system"),), items=("messages", "role", "content")),
    Layout("share", ("conversations[].from", "conversations[].value"),
           items=("conversations", "from", "value"), rename=True),
    Layout("share_system", ("conversations[].from", "conversations[].value", "system"),
           turns=(("system", "system"),), items=("conversations", "from", "value"), rename=True),
    Layout("prompt_completion", ("completion", "prompt"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
    Layout("system_prompt_response", ("prompt", "response", "system"),
           turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", ("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", ("input", "instruction", "output"),
           turns=(("user", "instruction+input"), ("assistant", "output"))),
    Layout("question_answer", ("answer", "question"), turns=(("user", "question"), ("assistant", "answer"))),
)


def known_fields(layouts: Sequence[Layout] = LAYOUTS) -> dict[str, list[str]]:
    """Field -> fields of its list items (none: a plain text field)."""
    out: dict[str, list[str]] = {}
    for lay in layouts:
        for p in lay.paths:
            field, _, item = p.partition("[].")
            have = out.setdefault(field, [])
            if item and item not in have:
                have.append(item)
    return out


def json_schema(layouts: Sequence[Layout] = LAYOUTS) -> T.StructType:
    """The schema that reads the known fields out of JSON records."""
    def kind(items: list[str]) -> T.DataType:
        if not items:
            return T.StringType()
        return T.ArrayType(T.StructType([T.StructField(i, T.StringType()) for i in items]))
    return T.StructType([T.StructField(f, kind(i)) for f, i in sorted(known_fields(layouts).items())])


def _columns(df: DataFrame) -> dict[str, T.DataType]:
    """Column types by lower-cased name."""
    return {f.name.lower(): f.dataType for f in df.schema.fields}


def _filled(df: DataFrame, layouts: Sequence[Layout]) -> dict[str, Column]:
    """Known nested field path -> whether a row fills it: single text fields count when
    not null, the fields of list items when the list is not null."""
    columns, out = _columns(df), {}
    for field, items in sorted(known_fields(layouts).items()):
        kind = columns.get(field)
        if kind is None:
            continue
        if items:
            if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
                have = {n.lower() for n in kind.elementType.names}
                out |= {f"{field}[].{i}": F.col(f"`{field}`").isNotNull() for i in items if i in have}
        elif not isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            out[field] = F.col(f"`{field}`").isNotNull()
    return out


def fingerprint(df: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """Hash of the known nested field paths that make a row's layout.

    The three fields of turn rows count as filled together and alone: in every row of a
    table that has the fields of no other layout, else where one of them is not null.
    Other rows have the hash of the paths they fill, or, where no layout has that one,
    of the largest layout among them."""
    filled = _filled(df, layouts)
    listed = F.array_compact(F.array(*[F.when(there, F.lit(p)) for p, there in sorted(filled.items())])
                             ) if filled else F.array().cast("array<string>")
    whole = F.substring(F.sha2(F.array_join(listed, "\n"), 256), 1, 16)
    fitting = [lay for lay in layouts if set(lay.paths) <= set(filled)]
    out = whole
    for lay in sorted((x for x in reversed(fitting) if not x.rows), key=lambda x: len(x.paths)):  # the last one is asked first
        every = F.lit(True)
        for p in lay.paths:
            every = every & filled[p]
        out = F.when(every, F.lit(lay.fingerprint)).otherwise(out)
    known = [lay.fingerprint for lay in fitting if not lay.rows]
    out = F.when(whole.isin(known), whole).otherwise(out) if known else out
    for lay in fitting:
        if lay.rows:
            some = F.lit(not known)
            for p in lay.rows:
                some = some | filled[p]
            out = F.when(some, F.lit(lay.fingerprint)).otherwise(out)
    return out


_TURN = "array<struct<turn: bigint, role: string, text: string>>"


def _text(df: DataFrame, path: str) -> Column:
    parts = [F.col(f"`{p}`").cast("string") for p in path.split("+")]
    return F.concat_ws("\n", *parts) if len(parts) > 1 else parts[0]


def _mapped(df: DataFrame, lay: Layout) -> Column | None:
    """The layout's mapping as an expression giving an array of turns."""
    if not set(lay.paths) <= set(_filled(df, [lay])):  # a field is missing, or of another type
        return None
    if lay.rows:
        turn, role, text = (F.col(f"`{c}`") for c in lay.rows)
        return F.array(F.struct(turn.cast("bigint").alias("turn"), role.cast("string").alias("role"),
                                text.cast("string").alias("text"))).cast(_TURN)
    single = F.array(*[F.struct(F.lit(i).cast("bigint").alias("turn"), F.lit(role).alias("role"),
                                _text(df, path).alias("text")) for i, (role, path) in enumerate(lay.turns)]
                     ).cast(_TURN) if lay.turns else None
    if not lay.items:
        return single
    array, role, text = lay.items

    def one(m: Column, i: Column) -> Column:
        name = m[role].cast("string")
        if lay.rename:
            for old, new in ROLE_NAMES.items():
                name = F.when(m[role] == old, F.lit(new)).otherwise(name)
        return F.struct((i + len(lay.turns)).cast("bigint").alias("turn"), name.alias("role"),
                        m[text].cast("string").alias("text"))

    listed = F.transform(F.col(f"`{array}`"), one).cast(_TURN)
    return listed if single is None else F.concat(single, listed)


def _with_turns(df: DataFrame, layouts: Sequence[Layout]) -> DataFrame:
    df = df.withColumn("_fingerprint", fingerprint(df, layouts))
    turns = F.lit(None).cast(_TURN)
    for lay in layouts:
        mapped = _mapped(df, lay)
        if mapped is not None:
            turns = F.when(F.col("_fingerprint") == lay.fingerprint, mapped).otherwise(turns)
    return df.withColumn("_turns", turns)


def canonical_turns(records: DataFrame, conversation: str = "conv_id",
                    layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """(conversation, turn, role, text) of all records whose layout is known."""
    found = _with_turns(records, layouts)
    return (found.select(F.col(f"`{conversation}`").alias(conversation), F.inline("_turns"))
            .select(conversation, "turn", F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text")))


def unmatched(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """The records whose fingerprint no layout has, with that fingerprint."""
    found = _with_turns(records, layouts)
    return found.filter(F.col("_turns").isNull()).drop("_turns")


def from_json(records: DataFrame, column: str, conversation: str = "conv_id",
              layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """JSON records as columns of the known fields, for ``canonical_turns``."""
    parsed = F.from_json(F.col(f"`{column}`"), json_schema(layouts))
    return records.select(F.col(f"`{conversation}`").alias(conversation), parsed.alias("_r")).select(
        conversation, "_r.*")


# --- rendering and reading back ---------------------------------------------

def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    return F.replace(F.replace(escape(c), F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\")))


def format_chats(turns: DataFrame, conversation: str = "conv_id", learn: str = "assistant") -> DataFrame:
    """One row per conversation: (conversation, formatted, loss_spans), where
    ``loss_spans`` are the (start from 0, length) code-point spans of the escaped
    texts of role ``learn`` in ``formatted``."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = turns.select(F.col(conversation), "turn", "role", "text", head.alias("_head"),
                        escape(F.col("text")).alias("_body"))
    rows = rows.withColumn("_part", F.concat("_head", "_body", F.lit(END + "\n")))
    order = Window.partitionBy(conversation).orderBy("turn", "role", "text").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_end", F.sum(F.length("_part").cast("long")).over(order))
    start = F.col("_end") - F.length("_part") + F.length("_head")
    span = F.when(F.col("role") == learn, F.struct(start.alias("start"), F.length("_body").cast("long").alias("length")))
    listed = F.array_sort(F.collect_list(F.struct("_end", "_part", span.alias("_span"))))
    return (rows.groupBy(conversation).agg(listed.alias("_l"))
            .select(conversation, F.array_join(F.col("_l._part"), "").alias("formatted"),
                    F.array_compact(F.col("_l._span")).alias("loss_spans")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``loss_texts``, recovered from ``formatted``
    and ``loss_spans`` alone."""
    whole = r"(?s)<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n"
    roles = F.regexp_extract_all("formatted", F.lit(whole), F.lit(1))
    texts = F.regexp_extract_all("formatted", F.lit(whole), F.lit(2))
    turns = F.zip_with(roles, texts, lambda r, t: F.struct(unescape_role(r).alias("role"), unescape(t).alias("text")))
    masked = F.transform("loss_spans", lambda s: unescape(
        F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumns({"turns": turns, "loss_texts": masked})
