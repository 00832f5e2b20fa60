"""Chat formatting with typed content parts.

A turn's content is a text or a list of typed parts (text, image, audio, document). A visitor flattens the parts in their
order: text is escaped and copied, every other part becomes a numbered placeholder such as ``<image_2>``, and its
reference, its place and the tokens that it will take once a model expands it are recorded as an attachment. The template
wraps the result in the markers of the turn's role.

Control strings inside texts are escaped reversibly: ``</s>`` becomes ``<\\/s>``, and a text that already holds
``<\\/s>`` becomes ``<\\\\/s>``: one backslash is added after the first character of everything that looks like a
control string with any number of backslashes there. No control string holds a second opening character, a
backslash or a space, so matches never overlap and no text can meet a marker to form a new one: the output of any
conversation can be read back turn by turn (``parse_turns``).

``format_turns`` gives one row per turn. Formatting needs nothing but the row, so it moves nothing, and a conversation that
holds a third of all rows is formatted by all tasks; the training text of a conversation is its turns' texts
joined in order. ``read_back`` parses that output again. It deals conversations to tasks, sorts turns within partitions and
streams them through running digests, so memory does not grow with a conversation; a digest over one conversation
is by its nature made in one task.

Rows: a null role is an empty one; a null or empty text, and a null or empty list of parts, is an empty turn. A role the
template does not name has its (escaped) name in its markers. Turns are ordered by turn number (null first), then role,
then formatted text, so ties and repeated rows have a fixed place; repeated rows are turns of their own. Rows with a
null conversation form one conversation of null. A null part is passed over; a part of unknown kind, or without one, counts
as text. Sizes that are null or negative count as 0. Other columns are ignored, whatever their names. Empty tables give empty
results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read
from .registry import query

MEDIA = ("image", "audio", "document")
#: role -> marker before and after its text; other roles are marked with their name.
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("", "</s>")}
NAMED = ("[ROLE] ", " [TEXT] ", " [/ROLE]")
_BODY = r"(/?s>|/?SYS\]|/?INST\]|/?ROLE\]|TEXT\]|(?:image|audio|document)_[0-9]+>)"
_ESCAPE = re.compile(r"([<\[])(\\*)" + _BODY)
_UNESCAPE = re.compile(r"([<\[])\\(\\*)" + _BODY)
_PLACE = re.compile(r"<(image|audio|document)_([0-9]+)>")

PART = "struct<kind string, text string, ref string, width long, height long, seconds double, pages long>"
ATTACHMENT = "struct<number int, kind string, ref string, at int, n_tokens long>"
FORMATTED = f"formatted string, loss array<struct<start int, end int>>, attachments array<{ATTACHMENT}>, n_tokens long"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


@dataclass(frozen=True)
class Sizes:
    """How many tokens an attachment takes once it is expanded."""

    #: pixels a side of an image patch
    patch: int = 28
    tokens_per_second: float = 25.0
    tokens_per_page: int = 256

    def image(self, part: dict) -> int:
        return ceil(_number(part, "width") / self.patch) * ceil(_number(part, "height") / self.patch)

    def audio(self, part: dict) -> int:
        return ceil(_number(part, "seconds") * self.tokens_per_second)

    def document(self, part: dict) -> int:
        return int(_number(part, "pages")) * self.tokens_per_page


def _number(part: dict, name: str) -> float:
    value = part.get(name)
    return value if value is not None and 0 < value < float("inf") else 0


@dataclass
class Flattener:
    """Visitor of a turn's parts; ``pieces`` is the text so far and ``at`` its length."""

    sizes: Sizes
    at: int = 0
    pieces: list[str] = field(default_factory=list)
    #: (start, end) of each text, in the formatted string
    texts: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[tuple[int, str, str | None, int, int]] = field(default_factory=list)

    def mark(self, text: str) -> None:
        self.pieces.append(text)
        self.at += len(text)

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part.get('kind')}" if part.get("kind") in MEDIA else "visit_text")(part)

    def visit_text(self, part: dict) -> None:
        start = self.at
        self.mark(escape(part.get("text") or ""))
        if self.at > start:
            # neighbouring texts are one: a control string across their border must be escaped as well
            if self.texts and self.texts[-1][1] == start:
                first = self.texts.pop()[0]
                whole = escape(unescape("".join(self.pieces)[first:start]) + (part.get("text") or ""))
                before = "".join(self.pieces)[:first]
                self.pieces, self.at, start = [before, whole], first + len(whole), first
            self.texts.append((start, self.at))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, self.sizes.image(part))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, self.sizes.audio(part))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, self.sizes.document(part))

    def _attach(self, kind: str, part: dict, n_tokens: int) -> None:
        number = len(self.attachments) + 1
        self.attachments.append((number, kind, part.get("ref"), self.at, n_tokens))
        self.mark(f"<{kind}_{number}>")


def format_turn(role: str | None, parts: list[dict | None], sizes: Sizes, learn: frozenset[str]) -> tuple:
    """(formatted, loss spans, attachments, expanded tokens) of one turn."""
    role = role or ""
    out = Flattener(sizes)
    before, after = MARKS.get(role) or (NAMED[0] + escape(role) + NAMED[1], NAMED[2])
    out.mark(before)
    for part in parts:
        out.visit(part)
    out.mark(after)
    return "".join(out.pieces), out.texts if role in learn else [], out.attachments, sum(a[4] for a in out.attachments)


def parse_turns(text: str) -> Iterator[tuple[str, str, list[tuple[str, int]]]]:
    """(role, unescaped text with its placeholders, attachments) of each turn of a formatted conversation."""
    at = 0
    while at < len(text):
        for role, (before, after) in MARKS.items():
            if before and text.startswith(before, at):
                begin = at + len(before)
                break
        else:
            if text.startswith(NAMED[0], at):
                cut = text.index(NAMED[1], at)
                role, begin, after = unescape(text[at + len(NAMED[0]):cut]), cut + len(NAMED[1]), NAMED[2]
            else:
                role, begin, after = "assistant", at, MARKS["assistant"][1]
        end = text.index(after, begin)
        body = text[begin:end]
        yield role, unescape(body), [(m[1], int(m[2])) for m in _PLACE.finditer(body)]
        at = end + len(after)


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 parts: str | None = None, sizes: Sizes = Sizes(), learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn: conv_id, turn, role, formatted, loss (spans of code points of ``formatted`` that are learned),
    attachments (``at`` likewise) and n_tokens (what the attachments expand to).

    ``parts`` names a column of ``array<PART>`` (any of PART's fields may lack); without it ``text`` is the one part."""
    content = F.col(parts) if parts else F.array(F.struct(F.lit("text").alias("kind"), F.col(text).alias("text")))
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), content.alias("parts"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    known = frozenset(learn)
    spans, files = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.struct(
        [("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("n_tokens", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [format_turn(r, p or [], sizes, known) for r, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([o[0] for o in out], pa.string()),
                 pa.array([[{"start": a, "end": b} for a, b in o[1]] for o in out], spans),
                 pa.array([[dict(zip(("number", "kind", "ref", "at", "n_tokens"), a)) for a in o[2]] for o in out], files),
                 pa.array([o[3] for o in out], pa.int64())],
                ["conv_id", "turn", "role", "formatted", "loss", "attachments", "n_tokens"])

    return rows.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, {FORMATTED}")


class _Digest:
    """Running digests of one conversation."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.n_attachments = 0

    def add(self, formatted: str, spans: list[dict]) -> None:
        self.chars += len(formatted)
        for role, text, attached in parse_turns(formatted):
            self.n_turns += 1
            self.n_attachments += len(attached)
            self.turns.update(f"{role}\n{text}\n".encode())
        for s in spans:
            learned = unescape(formatted[s["start"]:s["end"]])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode())

    def row(self) -> tuple:
        return (self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.n_attachments)


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse the output of ``format_turns`` again: one row of counts and digests per conversation."""
    rows = (formatted.select("conv_id", "turn", "role", "formatted", "loss").repartition("conv_id")
            .sortWithinPartitions("conv_id", "turn", "role", "formatted").select("conv_id", "formatted", "loss"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, conv_type = None, [], None

        def flush():
            columns = list(zip(*out))
            types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            conv_type = batch.schema.field(0).type
            for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.row())
                    now = _Digest(conv)
                now.add(text, spans)
            if len(out) >= 1000:
                yield flush()
                out.clear()
        if now is not None:
            out.append(now.row())
        if out:
            yield flush()

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                "formatted_chars long, n_attachments long")


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?SYS\]|/?INST\]|/?ROLE\]|TEXT\]|(?:image|audio|document)_[0-9]+>)', '\1\2\\\3', 'g') AS safe,
         regexp_replace(role, '([<\[])(\\*)(/?s>|/?SYS\]|/?INST\]|/?ROLE\]|TEXT\]|(?:image|audio|document)_[0-9]+>)', '\1\2\\\3', 'g') AS safe_role
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
       CAST(sum(length(safe) + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 4
                               ELSE 23 + length(safe_role) END) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


@query("op11_chat_formatting", SQL)
def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_turns(turns)).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
