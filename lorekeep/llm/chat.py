"""Chat formatting: typed content parts flattened by a visitor, and read back.

A turn's content is a list of typed parts (text, image, audio, document).  A
visitor flattens them in order: text is escaped, every other part becomes a
numbered placeholder, and its reference and the number of tokens that it will
expand to are recorded.  The template marks the turn, and the loss mask covers
the content of assistant turns.

A control string inside a text gets one more backslash after its first
character (``</s>`` becomes ``<\\/s>``, ``<\\/s>`` becomes ``<\\\\/s>``), so what has
none is the template's own, and taking one away restores the text.

The formatted conversation is kept as its turns in order, each one segment, so
a conversation of any length is never one value: its segments, put together,
are the formatted text.  Reading back streams over sorted segments and holds
one at a time.

Defined results: a null text is empty; a null role is the empty role; rows of a
conversation go by turn (nulls first), ties by role, then text; repeated rows
are turns of their own; a null conversation id is one conversation; unknown
roles are kept by name and are not under the loss mask; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's tags by role; other roles are named in a ROLE tag.
TAGS = {"user": "INST", "system": "SYS", "assistant": "OUT", "tool": "TOOL"}
ROLES = {tag: role for role, tag in TAGS.items()}
KINDS = ("image", "audio", "document")
LEARNED = "assistant"

_CONTROL = rf"(?:/?s>|/?(?:{'|'.join(ROLES)})\]|/?ROLE[ \]]|\|(?:{'|'.join(KINDS)}):)"
_PLAIN = re.compile(rf"([<\[])(\\*)(?={_CONTROL})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_CONTROL})")
_TURN = re.compile(
    rf"<s>\[(?P<tag>{'|'.join(ROLES)}|ROLE (?P<role>[\w.~%-]*))\](?P<body>.*?)\[/(?:{'|'.join(ROLES)}|ROLE)\]</s>", re.S
)
_PLACE = re.compile(rf"<\|({'|'.join(KINDS)}):(\d+)\|>")

PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


@dataclass
class Flatten:
    """Visits the parts of a turn in order; ``content()`` is what they are flattened to.

    Texts that meet are escaped together, so that no control string arises where two join.
    """

    patch: int = 28  # pixels to a side of an image token
    audio_rate: float = 12.5  # tokens a second
    page_tokens: int = 768
    body: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part.get("kind") or "text"
        if kind != "text" and kind not in KINDS:
            raise ValueError(f"unknown content part {kind!r}")
        getattr(self, f"visit_{kind}")(part)

    def visit_text(self, part: dict) -> None:
        self.texts.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        self._attach(part, ceil((part.get("width") or 0) / self.patch) * ceil((part.get("height") or 0) / self.patch))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, ceil((part.get("seconds") or 0.0) * self.audio_rate))

    def visit_document(self, part: dict) -> None:
        self._attach(part, (part.get("pages") or 0) * self.page_tokens)

    def _attach(self, part: dict, tokens: int) -> None:
        self._close()
        self.body.append(f"<|{part['kind']}:{len(self.attachments)}|>")
        self.attachments.append({"kind": part["kind"], "ref": part.get("ref"), "tokens": tokens})

    def _close(self) -> None:
        self.body.append(escape("".join(self.texts)))
        self.texts.clear()

    def content(self) -> str:
        self._close()
        return "".join(self.body)


def format_turn(role: str | None, parts: list[dict]) -> tuple[str, list[dict], tuple[int, int]]:
    """(segment, attachments, span of the segment that is the turn's content)."""
    seen = Flatten()
    for part in parts:
        seen.visit(part)
    body = seen.content()
    tag = TAGS.get(role or "")
    head = f"<s>[{tag}]" if tag else f"<s>[ROLE {quote(role or '', safe='')}]"
    return f"{head}{body}[/{tag or 'ROLE'}]</s>", seen.attachments, (len(head), len(head) + len(body))


def parse(formatted: str) -> Iterator[tuple[str, str, list[tuple[str, int]]]]:
    """(role, text, placeholders) of each turn of a formatted conversation or segment."""
    for turn in _TURN.finditer(formatted):
        role = unquote(turn["role"]) if turn["role"] is not None else ROLES[turn["tag"]]
        places = [(k, int(n)) for k, n in _PLACE.findall(turn["body"])]
        yield role, unescape(_PLACE.sub("", turn["body"])), places


def format_turns(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    parts_col: str | None = None,
) -> DataFrame:
    """One formatted segment for each row: ``(conv, turn, role, text, segment, loss_from, loss_to, attachments)``.

    With ``parts_col`` (of type PARTS) the parts are the content, else the text
    is the only part.  ``loss_from`` and ``loss_to`` bound the code points of
    the segment under the loss mask; both are 0 outside assistant turns.
    """
    attachment = pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            role, text = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            given = batch.column(4).to_pylist() if parts_col else [None] * batch.num_rows
            made = [
                format_turn(r, p if p is not None else [{"kind": "text", "text": t}])
                for r, t, p in zip(role, text, given, strict=True)
            ]
            mask = [span if r == LEARNED else (0, 0) for r, (_, _, span) in zip(role, made, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:4],
                    pa.array([s for s, _, _ in made], pa.string()),
                    pa.array([a for a, _ in mask], pa.int64()),
                    pa.array([b for _, b in mask], pa.int64()),
                    pa.array([a for _, a, _ in made], pa.list_(attachment)),
                ],
                ["conv", "turn", "role", "text", "segment", "loss_from", "loss_to", "attachments"],
            )

    source = rows.select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"),
        F.col(text_col).cast("string").alias("text"),
        *([F.col(parts_col).cast(PARTS).alias("parts")] if parts_col else []),
    )
    return source.mapInArrow(
        run,
        "conv long, turn long, role string, text string, segment string, loss_from long, loss_to long,"
        " attachments array<struct<kind:string,ref:string,tokens:bigint>>",
    )


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of each conversation, from the segments alone.

    Segments of a conversation meet in one task, as a digest over a sequence
    must be taken in order, but they only stream through it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "expanded_tokens"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        open_: list = []

        def closed(state: list) -> list:
            return [state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5], state[6]]

        for batch in batches:
            done = []
            for conv, segment, a, b, extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not open_ or open_[0] != conv:
                    if open_:
                        done.append(closed(open_))
                    open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text, _ in parse(segment):
                    open_[1] += 1
                    open_[2].update(f"{role}\n{text}\n".encode())
                learned = unescape(_PLACE.sub("", segment[a:b]))
                open_[3] += len(learned)
                open_[4].update(learned.encode())
                open_[5] += len(segment)
                open_[6] += extra
            if done:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names
                )
        if open_:
            yield pa.RecordBatch.from_arrays(
                [pa.array([c], k) for c, k in zip(closed(open_), kinds, strict=True)], names
            )

    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda total, x: total + x["tokens"])
    ordered = (
        segments.repartition("conv")
        .sortWithinPartitions("conv", "turn", "role", "text")
        .select("conv", "segment", "loss_from", "loss_to", tokens.alias("extra"))
    )
    return ordered.mapInArrow(
        run,
        "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long,"
        " expanded_tokens long",
    )
