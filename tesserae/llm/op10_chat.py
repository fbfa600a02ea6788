"""Chat formatting with schema fingerprints.

The nested field paths of a record (names and kinds, sorted) that any registered layout knows are hashed to a
fingerprint, which selects a declarative mapping; the mapping converts the layout into canonical turns (role, text).
Further fields (an id, a name, a score) say nothing of the layout. Layouts of the registry:
prompt and completion, instruction with optional input, message lists with role and content or from and value,
and tables with a row for each turn.

A conversation is written turn by turn, so a long one is never held as a whole: rows are dealt and sorted by
conversation and turn, and the output is a row for each part of at most `PART` characters or one turn.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = 1 << 20

# The template: <s>[ROLE] role [/ROLE] text</s>
START, OPEN, CLOSE, END = "<s>", "[ROLE] ", " [/ROLE] ", "</s>"
#: Control strings; inside roles and texts a backslash after the first character breaks them, and backslashes are doubled.
CONTROL = re.compile(r"([<\[])(?=/?s>|/?ROLE\]|/?INST\])")


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, tuple[int, int]]:
    """The turn, and where in it the text lies."""
    head = f"{START}{OPEN}{escape(role)}{CLOSE}"
    body = escape(text)
    return f"{head}{body}{END}", (len(head), len(head) + len(body))


def parse_turns(text: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of formatted turns."""
    at = 0
    while at < len(text):
        first = text.index(CLOSE, at)
        last = text.index(END, first)  # control strings occur nowhere else
        if not text.startswith(START + OPEN, at):
            raise ValueError("no turn starts here")
        yield unescape(text[at + len(START + OPEN) : first]), unescape(text[first + len(CLOSE) : last])
        at = last + len(END)


# ---------------------------------------------------------------- fingerprints and mappings


def paths_of(value, prefix: str = "") -> set[str]:
    """Nested field paths of a record; lists add [], values their kind; nulls say nothing."""
    if isinstance(value, dict):
        return set().union(*(paths_of(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items())) if value else {prefix + "{}"}
    if isinstance(value, list):
        return set().union(*(paths_of(v, prefix + "[]") for v in value)) if value else {prefix + "[]"}
    return set() if value is None else {f"{prefix}:{'text' if isinstance(value, str) else 'number'}"}


def paths_of_schema(kind: T.DataType, prefix: str = "") -> set[str]:
    if isinstance(kind, T.StructType):
        return set().union(*(paths_of_schema(f.dataType, f"{prefix}.{f.name}" if prefix else f.name) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return paths_of_schema(kind.elementType, prefix + "[]")
    return {f"{prefix}:{'text' if isinstance(kind, T.StringType) else 'number'}"}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


#: Each mapping: the paths of its layout, and its turns as (role or path of the role, path of the text).
#: A path with [] is taken for each element; an absent or empty part of several joined by + is left out.
MAPPINGS = [
    ({"prompt:text", "completion:text"}, [("user", "prompt"), ("assistant", "completion")]),
    ({"prompt:text", "response:text"}, [("user", "prompt"), ("assistant", "response")]),
    ({"question:text", "answer:text"}, [("user", "question"), ("assistant", "answer")]),
    ({"instruction:text", "output:text"}, [("user", "instruction"), ("assistant", "output")]),
    ({"instruction:text", "input:text", "output:text"}, [("user", "instruction+input"), ("assistant", "output")]),
    ({"system:text", "prompt:text", "completion:text"}, [("system", "system"), ("user", "prompt"), ("assistant", "completion")]),
    ({"messages[].role:text", "messages[].content:text"}, [("messages[].role", "messages[].content")]),
    ({"conversations[].from:text", "conversations[].value:text"}, [("conversations[].from", "conversations[].value")]),
    ({"conv_id:number", "turn:number", "role:text", "text:text"}, [("role", "text")]),
]
BY_FINGERPRINT = {fingerprint(paths): turns for paths, turns in MAPPINGS}
KNOWN = frozenset().union(*(paths for paths, _ in MAPPINGS))
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _walk(record, path: str) -> list[str]:
    values = [record]
    for name in path.split("."):
        many, name = name.endswith("[]"), name.removesuffix("[]")
        values = [v.get(name) for v in values if isinstance(v, dict)]
        if many:
            values = [x for v in values for x in (v or [])]
    return ["" if v is None else str(v) for v in values]


def turns_of(record: dict) -> list[tuple[str, str]] | None:
    """Canonical turns of one record, or None where no mapping has its fingerprint. Keys with nulls are absent; a record
    that has fields of several layouts is of none of them."""
    mapping = BY_FINGERPRINT.get(fingerprint(paths_of(record) & KNOWN))
    if mapping is None:
        return None
    out = []
    for role, path in mapping:
        if "[]" in path:
            out += [(ROLES.get(r, r), t) for r, t in zip(_walk(record, role), _walk(record, path), strict=True)]
        else:
            parts = [x for p in path.split("+") for x in _walk(record, p) if x]
            out.append((role, "\n\n".join(parts)))
    return out


def canonical_records(records: DataFrame, column: str = "record") -> DataFrame:
    """conv_id, fingerprint, turn, role, text from JSON texts of any registered layout (columns conv_id, record).

    A record that is null, no JSON object or of an unknown layout gives one row with a null turn, so none
    is lost unseen. fingerprint is that of the known paths, or of all paths where no layout has these.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for i, text in zip(batch.column("conv_id").to_pylist(), batch.column("record").to_pylist(), strict=True):
                try:
                    record = json.loads(text) if text is not None else None
                except ValueError:
                    record = None
                turns = turns_of(record) if isinstance(record, dict) else None
                paths = paths_of(record) if isinstance(record, dict) else None
                mark = None if paths is None else fingerprint(paths & KNOWN if turns else paths)
                rows += [(i, mark, n, r, t) for n, (r, t) in enumerate(turns)] if turns else [(i, mark, None, None, None)]
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "fingerprint", "turn", "role", "text"])

    return records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col(column).alias("record")).mapInArrow(run, "conv_id long, fingerprint string, turn long, role string, text string")


def canonical_rows(table: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a table with a row for each turn, whose schema's fingerprint names its mapping.

    Columns beyond those of the layout are no part of the fingerprint.
    """
    known = table.select("conv_id", "turn", "role", "text")
    (mapping,) = BY_FINGERPRINT[fingerprint(paths_of_schema(known.schema))]
    role, text = mapping
    return known.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))


# ---------------------------------------------------------------- formatting and reading back


_PARTS = "conv_id long, part long, n_turns long, formatted string, mask array<long>"


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, formatted, mask: the formatted conversations in parts.

    turns has conv_id, turn, role, text. Turns follow each other by turn (null first), then role and text; a null
    role or text is empty; rows with a null conv_id are left out. mask holds start and end of each assistant
    text in the part, in characters.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null")

    def run(batches):
        now, part, texts, mask, size = None, 0, [], [], 0

        def pack():
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((now, pa.int64()), (part, pa.int64()), (len(texts), pa.int64()), ("".join(texts), pa.string()), (mask, pa.list_(pa.int64())))], ["conv_id", "part", "n_turns", "formatted", "mask"])

        for batch in batches:
            for i, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                turn, (a, b) = format_turn(role, text)
                if texts and (i != now or size + len(turn) > PART):
                    yield pack()
                    part, texts, mask, size = (part + 1 if i == now else 0), [], [], 0
                now = i
                if role == "assistant":
                    mask += [size + a, size + b]
                texts.append(turn)
                size += len(turn)
        if texts:
            yield pack()

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, _PARTS)


def digests(parts: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted parts.

    parts are those of format_chats, in its order: all parts of a conversation follow each other in one partition.
    """

    def run(batches):
        now, rows, state = None, [], None

        def close():
            rows.append((now, state["n"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["formatted"]))

        def pack():
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for i, text, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "mask")), strict=True):
                if i != now:
                    if state:
                        close()
                    now, state = i, {"n": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "formatted": 0}
                state["formatted"] += len(text)
                for role, turn in parse_turns(text):
                    state["n"] += 1
                    state["all"].update(f"{role}\n{turn}\n".encode())
                for a, b in zip(mask[::2], mask[1::2], strict=True):
                    own = unescape(text[a:b])
                    state["chars"] += len(own)
                    state["loss"].update(own.encode())
            if len(rows) > 5000:
                yield pack()
                rows.clear()
        if state:
            close()
        if rows:
            yield pack()

    return parts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
