"""Operator 12: chats as one marked text, from typed content parts, and back again."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A content part: its kind, the text of a text part, and reference and size of an attachment.
PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"

#: Control strings of widespread chat templates that texts must not be able to say.
CONTROLS = ("<|", "<s>", "</s>", "<SYS>", "</SYS>", "[INST]", "[/INST]", "<bos>", "<eos>", "<start_of_turn>", "<end_of_turn>")

FORMATTED = (
    "conv_id {id}, piece long, start long, formatted string, loss array<struct<start: long, end: long>>, "
    "attachments array<struct<number: long, kind: string, ref: string, tokens: long, start: long, end: long>>"
)
DIGESTS = "conv_id {id}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


@dataclass(frozen=True)
class ChatTemplate:
    """Marks around a turn, roles that are learnt, and sizes of attachments in tokens.

    A turn is ``<|turn|>role<|says|>content<|end|>`` and a line feed, where an attachment is
    ``<|kind:number|>``. Texts and roles get a backslash after the first character of each control
    string, with as many as stand there already kept behind it: no text can then say a mark, and
    taking one backslash away gives the text back. So that escapes cannot touch one another, the
    first character of a control string stands nowhere else in one, and none holds a backslash.
    """

    learnt: frozenset[str] = frozenset({"assistant"})
    controls: tuple[str, ...] = CONTROLS
    patch: int = 28
    audio_rate: float = 25.0
    page_tokens: int = 256
    _found: tuple[re.Pattern, re.Pattern] = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        first = {c[:1] for c in self.controls}
        if "<|" not in self.controls or any(len(c) < 2 or "\\" in c or set(c[1:]) & first for c in self.controls):
            raise ValueError("control strings hold '<|', no backslash, and their first characters at their first place only")
        ahead = "|".join(f"{re.escape(c[0])}(?={{}}{re.escape(c[1:])})" for c in self.controls)
        object.__setattr__(self, "_found", (re.compile(ahead.replace("{}", r"\\*")), re.compile(ahead.replace("(?={}", r"\\(?=\\*"))))

    def escape(self, text: str) -> str:
        return self._found[0].sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return self._found[1].sub(lambda m: m[0][0], text)


class Flattener:
    """Visits the parts of a conversation's turns in order; each kind has its own method.

    Places are code points from the start of the conversation, attachments are numbered from 1
    through it.
    """

    def __init__(self, template: ChatTemplate):
        self.template, self.at, self.attached = template, 0, 0

    def turn(self, role: str | None, parts: list[dict]) -> dict:
        """A turn's formatted text, the spans that are learnt, and its attachments."""
        role = role or ""
        start, self.out, self.loss, self.found, self.texts = self.at, [], [], [], []
        self.learnt = role in self.template.learnt
        self._say(f"<|turn|>{self.template.escape(role)}<|says|>")
        for part in parts:
            if part is not None:
                getattr(self, f"visit_{part['kind']}" if part["kind"] in KINDS else "visit_other")(part)
        self._end_text()
        self._say("<|end|>\n")
        return {"start": start, "formatted": "".join(self.out), "loss": self.loss, "attachments": self.found}

    def _say(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def visit_text(self, part: dict) -> None:
        self.texts.append(part["text"] or "")

    def _end_text(self) -> None:
        """Neighbouring text parts are escaped as one, since together they could say a mark."""
        if self.texts:
            begun = self.at
            self._say(self.template.escape("".join(self.texts)))
            if self.learnt:
                self.loss.append({"start": begun, "end": self.at})
            self.texts = []

    def visit_image(self, part: dict) -> None:
        wide, high = (math.ceil(max(part[s] or 0, 0) / self.template.patch) for s in ("width", "height"))
        self._attach(part, "image", wide * high)

    def visit_audio(self, part: dict) -> None:
        seconds = part["seconds"]
        self._attach(part, "audio", math.ceil(max(seconds, 0) * self.template.audio_rate) if seconds and math.isfinite(seconds) else 0)

    def visit_document(self, part: dict) -> None:
        self._attach(part, "document", max(part["pages"] or 0, 0) * self.template.page_tokens)

    def visit_other(self, part: dict) -> None:
        self._attach(part, "other", 0)

    def _attach(self, part: dict, kind: str, tokens: int) -> None:
        self._end_text()
        self.attached += 1
        begun = self.at
        self._say(f"<|{kind}:{self.attached}|>")
        self.found.append({"number": self.attached, "kind": kind, "ref": part["ref"], "tokens": tokens, "start": begun, "end": self.at})


KINDS = frozenset({"text", "image", "audio", "document"})
_TURN = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>\n", re.DOTALL)
_HOLDER = re.compile(r"<\|(?:image|audio|document|other):\d+\|>")


def read_turn(formatted: str, template: ChatTemplate) -> tuple[str, str]:
    """Role and text of a formatted turn, without its attachments."""
    marked = _TURN.fullmatch(formatted)
    if marked is None:
        raise ValueError("not a formatted turn")
    # Texts between attachments are unescaped one by one: joined they could look escaped.
    return template.unescape(marked[1]), "".join(map(template.unescape, _HOLDER.split(marked[2])))


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``most`` characters or 4096 rows."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("formatted") or "")
        if size >= most or len(held) >= 4096:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of batches, made a few at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            yield from batch.slice(low, 256).to_pylist()


def _arrow(ddl: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def format_chats(turns: DataFrame, template: ChatTemplate | None = None, parts: str | None = None) -> DataFrame:
    """A row per turn: ``piece`` numbers it in its conversation, ``formatted`` is its text, ``start``
    the place of that text in the conversation's, which is all pieces one after another.

    ``loss`` are the spans to learn from, the text parts of learnt roles; ``attachments`` say what each
    placeholder stands for and to how many tokens it expands. Contents come from the column ``parts``, an array
    of :data:`PART`, or, without it, ``text`` is one text part. Null texts and roles are empty, null
    parts are none, and an unknown kind is an attachment of kind ``other``.

    Turns come by ``turn``, null last, then by role and content; equal rows are turns of their own,
    and rows with a null ``conv_id`` are one conversation. Other columns are not read.

    Conversations are dealt out whole and stay in order within partitions, so a conversation is
    formatted in one task, as the places in it depend on all before; the task streams through it, so memory
    holds a batch of turns however long it is.
    """
    spark, template = turns.sparkSession, template or ChatTemplate()
    if parts is None:
        nothing = {f: F.lit(None).cast(t) for f, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))}
        content = F.array(F.struct(F.lit("text").alias("kind"), F.col("text"), *(c.alias(f) for f, c in nothing.items())))
    else:
        content = F.col(parts)
    rows = turns.select("conv_id", "turn", "role", content.cast(f"array<{PART}>").alias("parts"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "parts")
    ddl = FORMATTED.format(id=turns.schema["conv_id"].dataType.simpleString())
    schema = _arrow(ddl, spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def formatted() -> Iterator[dict]:
            last, flat, piece = object(), None, 0
            for row in _rows(batches):
                if row["conv_id"] != last:
                    last, flat, piece = row["conv_id"], Flattener(template), 0
                yield {"conv_id": last, "piece": piece, **flat.turn(row["role"], row["parts"] or [])}
                piece += 1

        return _batches(formatted(), schema)

    return rows.mapInArrow(run, ddl)


def chat_digests(formatted: DataFrame, template: ChatTemplate | None = None, in_order: bool = False) -> DataFrame:
    """What formatted chats say, read back: a row per conversation with digests of its turns and of
    all text under the loss mask.

    The pieces of a conversation are read one after another by a task that keeps two running hashes.
    ``in_order`` says that they come as :func:`format_chats` gives them; a table that was stored is
    dealt out and sorted again. Pieces that do not follow one another are refused.
    """
    spark, template = formatted.sparkSession, template or ChatTemplate()
    rows = formatted.select("conv_id", "piece", "start", "formatted", "loss")
    if not in_order:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    ddl = DIGESTS.format(id=formatted.schema["conv_id"].dataType.simpleString())
    schema = _arrow(ddl, spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests() -> Iterator[dict]:
            now = None
            for row in _rows(batches):
                if now is None or row["conv_id"] != now["conv_id"]:
                    if now is not None:
                        yield told(now)
                    now = {"conv_id": row["conv_id"], "n_turns": 0, "loss_chars": 0, "formatted_chars": 0}
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                    now |= {"turns_sha256": turns, "loss_sha256": loss}
                if (row["piece"], row["start"]) != (now["n_turns"], now["formatted_chars"]):
                    raise ValueError(f"conversation {row['conv_id']}: piece {row['piece']} does not follow what was read")
                role, text = read_turn(row["formatted"], template)
                turns.update(f"{role}\n{text}\n".encode())
                for span in row["loss"]:
                    learnt = template.unescape(row["formatted"][span["start"] - row["start"] : span["end"] - row["start"]])
                    loss.update(learnt.encode())
                    now["loss_chars"] += len(learnt)
                now["n_turns"] += 1
                now["formatted_chars"] += len(row["formatted"])
            if now is not None:
                yield told(now)

        def told(row: dict) -> dict:
            return {k: v.hexdigest() if k.endswith("sha256") else v for k, v in row.items()}

        return _batches(digests(), schema)

    return rows.mapInArrow(run, ddl)
