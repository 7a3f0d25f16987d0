"""Conversations as training text: typed content parts, turn marks, reversible escapes, loss spans.

A turn's content is a list of typed parts: text, image, audio or document. A
visitor walks the parts in order; text is escaped and written out, anything
else becomes a numbered placeholder that stands in its place, with the
attachment it refers to and the number of tokens it will expand to.

Template: ``### Role:`` and a space before, ``</turn>`` and a line break after
each turn. In texts, roles and references the characters of control strings
are written with an escape: backslash, number sign, less-than. So no control
string can appear inside content, and reading back is exact.

Loss lies on the text of the ``assistant`` turns, between the marks.

Scale: a conversation's turns are sorted, not gathered; a task formats them as
they stream by, and the digests of what is read back are running hashes. A
conversation with very many turns takes time but no memory; different conversations
are spread over all tasks by a hash.

Defined results: a null text or part list is an empty text, a null role an empty
role; turns that repeat a number are ordered by role, then text; null turns come
first; null conversation ids form one conversation; an empty table gives an empty
result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Fixed values of the template.
OPEN, NAMED, CLOSE = "### ", ": ", "</turn>\n"
ESCAPES = {"\\": "\\b", "#": "\\h", "<": "\\l"}
LOSS_ROLE = "assistant"

_ESCAPED = str.maketrans(ESCAPES)
_MEANING = {v: k for k, v in ESCAPES.items()} | {"\\c": ":"}
_ESCAPE = re.compile(r"\\[bhlc]")
# A title, then content in which a less-than sign only opens a placeholder.
_TURN = re.compile(r"### ([^#<:]*): ([^#<]*(?:<\|[^#<]*)*)</turn>\n")


def escape(text: str) -> str:
    return text.translate(_ESCAPED)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _MEANING[m[0]], text)


@dataclass(frozen=True)
class Attachment:
    """``place`` counts the code points of the turn's flattened content before the placeholder."""

    number: int
    kind: str
    ref: str
    tokens: int
    place: int


@dataclass
class FlatContent:
    text: str = ""
    attachments: list[Attachment] = field(default_factory=list)
    expanded_tokens: int = 0


class PartVisitor:
    """Flattens content parts; one ``visit_*`` method a type.

    A part is a mapping with ``type`` and, by type, ``text`` or ``ref``; sizes
    are ``width`` and ``height`` of images, ``seconds`` of audio, ``pages`` of documents.
    """

    def __init__(self, patch: int = 14, audio_tokens_per_second: int = 25, tokens_per_page: int = 512):
        self.patch, self.per_second, self.per_page = patch, audio_tokens_per_second, tokens_per_page

    def flatten(self, parts: Iterable[dict] | None, first_number: int = 0) -> FlatContent:
        self.out, self.pieces, self.length, self.first = FlatContent(), [], 0, first_number
        for part in parts or ():
            visit = getattr(self, f"visit_{part.get('type')}", None)
            if visit is None:
                raise ValueError(f"no such content part: {part.get('type')!r}")
            visit(part)
        self.out.text = "".join(self.pieces)
        return self.out

    def _write(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def _attach(self, part: dict, tokens: int) -> None:
        number = self.first + len(self.out.attachments)
        self.out.attachments.append(Attachment(number, part["type"], part.get("ref") or "", tokens, self.length))
        self.out.expanded_tokens += tokens
        self._write(f"<|{part['type']}:{number}|>")

    def visit_text(self, part: dict) -> None:
        self._write(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        across, down = (-(-int(part.get(side) or 0) // self.patch) for side in ("width", "height"))
        self._attach(part, across * down)

    def visit_audio(self, part: dict) -> None:
        self._attach(part, -int(-float(part.get("seconds") or 0) * self.per_second // 1))

    def visit_document(self, part: dict) -> None:
        self._attach(part, int(part.get("pages") or 0) * self.per_page)


@dataclass(frozen=True)
class FormattedTurn:
    """``loss`` is the span of the content under the loss mask, within ``text``; None if there is none."""

    text: str
    loss: tuple[int, int] | None
    content: FlatContent


def format_turn(role: str | None, parts: Iterable[dict] | None, visitor: PartVisitor, first_number: int = 0) -> FormattedTurn:
    content = visitor.flatten(parts, first_number)
    head = f"{OPEN}{_title(role or '')}{NAMED}"
    loss = (len(head), len(head) + len(content.text)) if role == LOSS_ROLE else None
    return FormattedTurn(f"{head}{content.text}{CLOSE}", loss, content)


def _title(role: str) -> str:
    """Lower-case names are written with a capital; any other role is marked, so that reading back is exact."""
    plain = role.isascii() and role.isalpha() and role.islower()
    return role.capitalize() if plain else "!" + escape(role).replace(":", "\\c")


def _role(title: str) -> str:
    return unescape(title[1:]) if title.startswith("!") else title.lower()


def parse_turns(text: str) -> Iterator[tuple[str, str]]:
    """Role and content (placeholders kept, texts unescaped) of each turn of a formatted text."""
    at = 0
    while at < len(text):
        found = _TURN.match(text, at)
        if not found:
            raise ValueError(f"no turn at {at}: {text[at : at + 40]!r}")
        yield _role(found[1]), unescape(found[2])
        at = found.end()


FORMATTED = (
    "turn bigint, start bigint, formatted string, loss_start bigint, loss_end bigint, expanded_tokens bigint, "
    "attachments array<struct<number:bigint,kind:string,ref:string,tokens:bigint,place:bigint>>"
)


def format_conversations(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    parts: str | None = None, visitor: PartVisitor | None = None,
) -> DataFrame:
    """One row a turn, a conversation's rows together and in order: where it starts, its formatted
    text, loss span and attachments.

    A conversation's formatted text is that of its turns, one after another; places count its code points. With ``parts`` the content is that column, an array of structs with
    the fields of a part; else it is ``text`` as one text part.
    """
    visitor = visitor or PartVisitor()
    content = df[parts] if parts else F.lit(None).cast("string")
    rows = df.select(df[conv].alias("c"), df[turn].cast("bigint").alias("t"), df[role].alias("r"), df[text].alias("x"), content.alias("p"))
    placed = rows.repartition("c").sortWithinPartitions("c", "t", "r", "x")
    kind = df.schema[conv].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, length, attached = object(), 0, 0
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for c, t, r, x, p in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if c != current:
                    current, length, attached = c, 0, 0
                done = format_turn(r, p if parts else [{"type": "text", "text": x}], visitor, attached)
                loss = (done.loss[0] + length, done.loss[1] + length) if done.loss else (None, None)
                row = (c, t, length, done.text, *loss, done.content.expanded_tokens, [vars(a) for a in done.content.attachments])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
                length += len(done.text)
                attached += len(done.content.attachments)
            attachment = pa.struct([("number", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64()), ("place", pa.int64())])
            kinds = [batch.column(0).type, pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 3, pa.list_(attachment)]
            arrays = [pa.array(column, kind) for column, kind in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[conv, *names])

    names = ["turn", "start", "formatted", "loss_start", "loss_end", "expanded_tokens", "attachments"]
    return placed.mapInArrow(run, f"`{conv}` {kind}, {FORMATTED}")


DIGEST = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


class _Digest:
    def __init__(self, key):
        self.key, self.turns, self.chars, self.loss_chars = key, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int | None, end: int | None) -> None:
        for role, text in parse_turns(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if start is not None:
            masked = unescape(formatted[start - self.chars : end - self.chars])
            self.loss_chars += len(masked)
            self.loss.update(masked.encode("utf-8", "surrogatepass"))
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.key, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the formatted text of each conversation says: digests of its turns and of the text under its loss mask."""
    kind = formatted.schema[conv].dataType.simpleString()
    names = [conv, *(x.strip().split()[0] for x in DIGEST.split(","))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, key_type = None, pa.int64()
        for batch in batches:
            done, key_type = [], batch.column(0).type
            for key, text, start, end in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if digest is None or digest.key != key:
                    if digest:
                        done.append(digest.row())
                    digest = _Digest(key)
                digest.add(text, start, end)
            if done:
                yield _rows(done, key_type)
        if digest:
            yield _rows([digest.row()], key_type)

    def _rows(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    placed = formatted.repartition(conv).sortWithinPartitions(conv, "start")
    return placed.select(conv, "formatted", "loss_start", "loss_end").mapInArrow(run, f"`{conv}` {kind}, {DIGEST}")
