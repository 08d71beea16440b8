"""Chat formatting of typed content parts, with loss spans and attachment references.

A turn is a list of parts: text, image, audio or document. A visitor flattens them in order: text is
escaped, any other part becomes a placeholder and leaves a reference with the number of
tokens that it stands for. A conversation is a sequence of turns between marks:

    <turn ROLE>TEXT</turn>

Outside of marks ``<`` only occurs escaped: a backslash is written ``\\\\\\\\`` and ``<`` is written
``\\\\<``, so no text can end a turn or begin one, and reading back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtide.llm.batches import bound_batches

#: Roles whose texts are under the loss mask.
TRAINED = ("assistant",)
#: Tokens that a part stands for when it does not say: of an image tile, an audio second, a document page.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
PARTS_TYPE = "array<struct<type:string, text:string, ref:string, units:long>>"
#: Marks of a formatted turn: an escaped character, a begin, an end or a placeholder.
MARK = re.compile(r"\\(.)|<turn ((?:[^\\>]|\\.)*)>|</turn>|<(image|audio|document) (\d+)>", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<")


def _escape_role(role: str) -> str:
    return re.sub(r"[\\<>]", lambda m: "\\" + m[0], role)


@dataclass
class Flattener:
    """Visits the parts of one turn; one method for each type of part."""

    first_attachment: int = 0
    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"unknown content part {kind!r}")
        method(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def _attach(self, kind: str, part: dict) -> None:
        number = self.first_attachment + len(self.attachments)
        units = part.get("units")
        tokens = TOKENS_PER_UNIT[kind] * (1 if units is None else max(0, units))
        self.pieces.append(f"<{kind} {number}>")
        self.attachments.append({"number": number, "type": kind, "ref": part.get("ref"), "tokens": tokens})

    def visit_image(self, part: dict) -> None:
        self._attach("image", part)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part)


def format_turn(role: str | None, parts: list[dict] | None, first_attachment: int = 0) -> dict:
    """One turn's text, the span of its content, whether it is trained on, and its attachments."""
    seen = Flattener(first_attachment)
    for part in parts or []:
        seen.visit(part)
    head, body = f"<turn {_escape_role(role or '')}>", "".join(seen.pieces)
    return {
        "formatted": f"{head}{body}</turn>",
        "content_start": len(head),
        "content_end": len(head) + len(body),
        "in_loss": role in TRAINED,
        "attachments": seen.attachments,
        "attachment_tokens": sum(a["tokens"] for a in seen.attachments),
    }


def read_turns(formatted: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """Roles and parts ``(type, text or number)`` of formatted turns."""
    turns: list[tuple[str, list[tuple[str, str]]]] = []
    at, text, parts, role = 0, [], [], None
    for mark in MARK.finditer(formatted):
        text.append(formatted[at : mark.start()])
        at = mark.end()
        if mark[1] is not None:
            text.append(mark[1])
            continue
        before = "".join(text)
        text = []
        if mark[2] is not None:
            if role is not None or before:
                raise ValueError("a turn begins inside another")
            role = re.sub(r"\\(.)", r"\1", mark[2], flags=re.DOTALL)
            continue
        if role is None:
            raise ValueError("content outside of a turn")
        if before:
            parts.append(("text", before))
        if mark[3] is not None:
            parts.append((mark[3], mark[4]))
        else:
            turns.append((role, parts))
            parts, role = [], None
    if role is not None or at != len(formatted) or "".join(text):
        raise ValueError("an unfinished turn")
    return turns


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


TURN_TYPE = pa.struct(
    [
        ("formatted", pa.string()),
        ("content_start", pa.int64()),
        ("content_end", pa.int64()),
        ("in_loss", pa.bool_()),
        (
            "attachments",
            pa.list_(
                pa.struct(
                    [("number", pa.int64()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]
                )
            ),
        ),
        ("attachment_tokens", pa.int64()),
    ]
)
TURN_SCHEMA = (
    "formatted string, content_start long, content_end long, in_loss boolean, "
    "attachments array<struct<number:long, type:string, ref:string, tokens:long>>, attachment_tokens long"
)


def turn(role: Column, parts: Column, first_attachment: Column | None = None) -> Column:
    """A struct of the formatted turn; a function of one row, whatever the conversation's size."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            rows = zip(*(c.to_pylist() for c in columns), strict=True)
            yield pa.array([format_turn(r, p, f or 0) for r, p, f in rows], TURN_TYPE)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    first = F.lit(0).cast("long") if first_attachment is None else first_attachment
    return F.arrow_udf(run, TURN_SCHEMA)(role, parts, first)


def text_parts(text: Column) -> Column:
    """One text part; a null text is an empty one."""
    part = F.struct(
        F.lit("text").alias("type"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("long").alias("units"),
    )
    return F.array(part).cast(PARTS_TYPE)


def first_attachments(turns: DataFrame, id_col: str, turn_col: str, role_col: str, parts_col: str) -> DataFrame:
    """All rows and columns, with ``_first``: how many attachments the turns before have in their conversation.

    Rows of one turn number follow each other by role and content, rows that agree in all in any order.
    """
    number = F.size(F.filter(F.coalesce(parts_col, F.array().cast(PARTS_TYPE)), lambda p: F.coalesce(p["type"], F.lit("text")) != "text"))
    along = Window.partitionBy(id_col).orderBy(turn_col, role_col, F.xxhash64(F.to_json(F.col(parts_col)), F.lit(0)))
    before = F.sum(F.col("_number")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    return turns.withColumn("_number", number.cast("long")).withColumn("_first", F.coalesce(before, F.lit(0))).drop("_number")


def format_turns(
    turns: DataFrame,
    role_col: str = "role",
    parts_col: str = "parts",
    id_col: str | None = None,
    turn_col: str = "turn",
) -> DataFrame:
    """All rows and columns, with the formatted turn's columns in place of any of those names.

    With ``id_col`` attachments are numbered along the conversation, so that no two of it share a placeholder; else from
    the turn's start, as are spans. A null list of parts is an empty turn, a
    part without type is text, an unknown type raises. A null role is an empty one.
    """
    bound_batches(turns.sparkSession)
    first = None
    if id_col is not None:
        turns, first = first_attachments(turns, id_col, turn_col, role_col, parts_col), F.col("_first")
    found = turns.withColumn("_turn", turn(F.col(role_col), F.col(parts_col), first)).drop("_first")
    names = TURN_TYPE.names
    return found.withColumns({n: F.col(f"_turn.{n}") for n in names}).drop("_turn")


DIGEST_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, attachment_tokens long"
)


def conversation_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over ``conv_id, formatted, content_start, content_end, in_loss, attachment_tokens`` in order.

    What is counted is read back from the formatted turns. A conversation of any length takes
    the memory of one turn: only running hashes and counts are kept.
    """
    names = [part.split()[0] for part in DIGEST_SCHEMA.split(", ")]
    open_, all_text, loss_text, counts = None, None, None, None

    def row() -> list:
        return [open_[0], counts[0], all_text.hexdigest(), counts[1], loss_text.hexdigest(), counts[2], counts[3]]

    def batch(rows: list[list]) -> pa.RecordBatch:
        types = {"string": pa.string(), "long": pa.int64()}
        kinds = [types[part.split()[1]] for part in DIGEST_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names=names
        )

    for part in batches:
        done = []
        for conv, formatted, start, end, in_loss, tokens in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if open_ is None or open_[0] != conv:
                if open_ is not None:
                    done.append(row())
                open_, counts = (conv,), [0, 0, 0, 0]
                all_text, loss_text = hashlib.sha256(), hashlib.sha256()
            for role, parts in read_turns(formatted):
                text = "".join(t for kind, t in parts if kind == "text")
                all_text.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                counts[0] += 1
            if in_loss:
                masked = unescape(formatted[start:end])
                counts[1] += len(masked)
                loss_text.update(masked.encode("utf-8", "surrogatepass"))
            counts[2] += len(formatted)
            counts[3] += tokens
        if done:
            yield batch(done)
    if open_ is not None:
        yield batch([row()])


def digest_conversations(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts"
) -> DataFrame:
    """One row of counts and digests for each conversation, rows in the order of turns.

    Rows of one turn number are ordered by role and formatted text, null numbers come first. Rows
    without a conversation id are one conversation without an id.
    """
    formatted = format_turns(
        turns.select(
            F.col(id_col).cast("long").alias("conv_id"),
            F.col(turn_col).alias("turn"),
            F.col(role_col).alias("role"),
            F.col(parts_col).alias("parts"),
        ),
        id_col="conv_id",
    )
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return ordered.select(
        "conv_id", "formatted", "content_start", "content_end", "in_loss", "attachment_tokens"
    ).mapInArrow(conversation_digests, DIGEST_SCHEMA)
