"""Chat formatting with typed content parts.

A turn is a list of parts. A visitor flattens them in order: text is escaped,
other parts become placeholders whose attachments are recorded with the tokens
they expand to. The formatted conversation can be read back to its turns and to
the text under the loss mask.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's control strings; in a text, the first character of each is escaped.
HEAD, COLON, END = "### ", ": ", "</turn>\n"
_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)|<(?=\|)|:(?=[ ])")
_TEXT_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)|<(?=\|)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TOKEN = re.compile(r"\\.|</turn>|<\|(?:image|audio|document):\d+\|>", re.DOTALL)


@dataclass
class Visitor:
    """Flattens the parts of one conversation; attachments are numbered in order."""

    tile: int = 14  # pixels of an image patch's side
    tile_tokens: int = 1
    audio_tokens_a_second: int = 25
    page_tokens: int = 400
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> str:
        return getattr(self, f"visit_{part['type']}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        across, down = (-(-int(part.get(k) or self.tile) // self.tile) for k in ("width", "height"))
        return self._attach("image", part, across * down * self.tile_tokens)

    def visit_audio(self, part: dict) -> str:
        return self._attach("audio", part, -(-int(float(part.get("seconds") or 0) * 1000) * self.audio_tokens_a_second // 1000))

    def visit_document(self, part: dict) -> str:
        return self._attach("document", part, int(part.get("pages") or 1) * self.page_tokens)

    def visit_unknown(self, part: dict) -> str:
        raise ValueError(f"a part of unknown type {part['type']!r}")

    def _attach(self, kind: str, part: dict, tokens: int) -> str:
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "tokens": tokens})
        return f"<|{kind}:{len(self.attachments) - 1}|>"


def escape(text: str) -> str:
    """A backslash goes before each backslash and the first character of a control string."""
    return _TEXT_CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parts_of(content: str | None, typed: bool) -> list[dict]:
    """Parts of a turn's content; with ``typed``, a JSON list of objects with a type."""
    if typed and content and content.lstrip().startswith("["):
        try:
            found = json.loads(content)
        except ValueError:
            found = None
        if isinstance(found, list) and all(isinstance(p, dict) and "type" in p for p in found):
            return found
    return [{"type": "text", "text": content or ""}]


def format_turn(role: str | None, parts: list[dict], visitor: Visitor) -> str:
    """``### Role: body</turn>``; the role is escaped, its colon included."""
    name = _CONTROL.sub(r"\\\g<0>", role or "")
    return f"{HEAD}{name[:1].upper() + name[1:] if name[:1] in 'abcdefghijklmnopqrstuvwxyz' else chr(92) + 'n' + name}{COLON}{''.join(map(visitor.visit, parts))}{END}"


def read_turn(chunk: str) -> tuple[str, str]:
    """Role and still escaped body of a formatted turn."""
    if not chunk.startswith(HEAD) or not chunk.endswith(END):
        raise ValueError("not a formatted turn")
    at = next(m.start() for m in re.finditer(r"\\.|: ", chunk, re.DOTALL) if m[0] == COLON and m.start() >= len(HEAD))
    name = chunk[len(HEAD) : at]
    name = name[2:] if name.startswith("\\n") else name[:1].lower() + name[1:]
    body = chunk[at + len(COLON) : -len(END)]
    if any(m[0] == "</turn>" for m in _TOKEN.finditer(body)):
        raise ValueError("a turn ends within a turn")
    return unescape(name), body


class Reader:
    """Reads turns back from a conversation's text as it streams past, wherever the text is cut."""

    def __init__(self) -> None:
        self.text = ""

    def feed(self, part: str, last: bool = False) -> Iterator[str]:
        """The turns that are complete, each with its end mark; what may go on in the next part waits."""
        self.text += part
        start = 0
        for m in _TOKEN.finditer(self.text):
            if not last and m.end() + len(END) > len(self.text):
                break
            if m[0] == "</turn>":
                yield self.text[start : m.end() + 1]
                start = m.end() + 1
        self.text = self.text[start:]
        if last and self.text:
            raise ValueError("text after the last turn")


def split_turns(text: str) -> Iterator[str]:
    """The turns of a formatted conversation, each with its end mark."""
    return Reader().feed(text, last=True)


def plain(body: str) -> str:
    """A body without its placeholders, unescaped."""
    return unescape(re.sub(r"(\\.)|<\|(?:image|audio|document):\d+\|>", lambda m: m[1] or "", body, flags=re.DOTALL))


class Digest:
    """What is read back from the turns of one conversation, turn by turn."""

    def __init__(self, conv_id: int | None, trained: tuple[str, ...]):
        self.conv_id, self.trained, self.visitor, self.reader = conv_id, trained, Visitor(), Reader()
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, role: str | None, content: str | None, typed: bool) -> str:
        chunk = format_turn(role, parts_of(content, typed), self.visitor)
        self.chars += len(chunk)
        self.read(chunk)
        return chunk

    def read(self, part: str, last: bool = False) -> None:
        """Reads on in the joined text; the end of a turn is known once the next has begun."""
        for turn in self.reader.feed(part, last):
            name, body = read_turn(turn)
            text = plain(body)
            self.n += 1
            self.turns.update(f"{name}\n{text}\n".encode("utf-8", "surrogatepass"))
            if name in self.trained:
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        self.read("", last=True)
        a = self.visitor.attachments
        return (self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, len(a), sum(x["tokens"] for x in a))


_DIGEST = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_attachments", pa.int64()), ("attachment_tokens", pa.int64())]
_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long"


def _in_order(turns: DataFrame) -> DataFrame:
    """Each conversation in one partition, its rows in order of turn."""
    own = turns.select(*(F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))))
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def formatted(turns: DataFrame, typed: bool = True) -> DataFrame:
    """conv_id, turn, formatted chunk and its attachments (JSON), a row a turn.

    The chunks of a conversation in order are its formatted text.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("chunk", pa.string()), ("attachments", pa.string())])

    def run(batches):
        conv, visitor = object(), Visitor()
        for batch in batches:
            rows = []
            for c, t, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != conv:
                    conv, visitor = c, Visitor()
                before = len(visitor.attachments)
                rows.append((c, t, format_turn(role, parts_of(text, typed), visitor), json.dumps(visitor.attachments[before:])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return _in_order(turns).mapInArrow(run, "conv_id long, turn long, chunk string, attachments string")


def digests(turns: DataFrame, trained: tuple[str, ...] = ("assistant",), typed: bool = False) -> DataFrame:
    """Formats every conversation and digests what is read back from the output.

    Rows of a conversation are ordered by turn (nulls first), ties by role and
    text, so repeated rows are repeated turns. A null text is empty, a null
    role is an empty role, rows with a null conv_id form one conversation; an
    empty table gives an empty result; other columns are ignored. ``typed``:
    contents that are JSON lists of parts are read as such; otherwise every
    text is one text part.

    Scale: one shuffle by conversation with a sort in the partitions. A
    conversation streams through its task turn by turn, with running hashes,
    so even one with a third of all rows takes constant memory. A hash of a
    whole conversation is sequential, so its rows can't be split over tasks.
    """
    schema = pa.schema(_DIGEST)

    def run(batches):
        own: Digest | None = None
        done: list[tuple] = []

        def out():
            block = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
            done.clear()
            return block

        for batch in batches:
            for c, role, text in zip(*(batch.column(batch.schema.get_field_index(x)) for x in ("conv_id", "role", "text")), strict=True):
                c = c.as_py()
                if own is None or c != own.conv_id:
                    if own is not None:
                        done.append(own.row())
                    own = Digest(c, trained)
                own.add(role.as_py(), text.as_py(), typed)
            if len(done) > 1000:
                yield out()
        if own is not None:
            done.append(own.row())
            yield out()

    return _in_order(turns).mapInArrow(run, _DDL)
