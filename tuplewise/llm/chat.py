"""Chat formatting with typed content parts.

A conversation is one row per turn. A turn's content is a list of parts; a
visitor flattens them in order into text and placeholders and records
attachments with the tokens that each will expand to. The formatted
conversation is the concatenation of its turns' segments in order, so a
conversation of any length is formatted turn by turn and read back as a stream.

Template of a turn: ``<|turn|>role<|says|>content<|end|>`` and a line feed.
Placeholders: ``<|image:n|>`` and so on, n counting the turn's attachments.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tuplewise.llm.common import small_batches

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"
#: What a model's template may take as control: an opener, backslashes that an escape has put in, and the rest.
CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)"
_ESCAPE, _UNESCAPE = re.compile(CONTROL), re.compile(CONTROL.replace(r"(\\*)", r"(\\*)\\"))
PART = "struct<kind:string,text:string,ref:string,units:long>"
#: Tokens that an attachment expands to: a fixed number plus so many for each of its units (tiles, seconds, pages).
TOKENS = {"image": (2, 256), "audio": (2, 25), "document": (2, 512)}
SEGMENT = "segment string, loss_start int, loss_end int, attachments array<struct<kind:string,ref:string,offset:int,tokens:long>>, expanded_tokens long"


def escape(text: str) -> str:
    """Put one more backslash into each control string; unescape() takes it out."""
    return _ESCAPE.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


class Flatten:
    """Visits the parts of one turn in order.

    Text parts that follow each other are one run, escaped as a whole, so that no
    control string comes about where two of them meet.
    """

    def __init__(self, tokens=TOKENS):
        self.tokens, self.out, self.attachments, self.length, self.expanded = tokens, [], [], 0, 0
        self.run: list[str] = []

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part['kind'] or 'text'}", self.visit_text)(part)

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def _end_run(self) -> None:
        text, self.run = "".join(self.run), []
        self.expanded += len(text.split())
        self._put(escape(text))

    def visit_text(self, part: dict) -> None:
        self.run.append(part["text"] or "")

    def _attach(self, part: dict) -> None:
        self._end_run()
        kind = part["kind"]
        base, each = self.tokens[kind]
        tokens = base + each * max(0, part["units"] or 0)
        self.attachments.append({"kind": kind, "ref": part["ref"], "offset": self.length, "tokens": tokens})
        self.expanded += tokens
        self._put(f"<|{kind}:{len(self.attachments) - 1}|>")

    visit_image = visit_audio = visit_document = _attach

    def content(self) -> str:
        """The turn's formatted content, once all parts were visited."""
        self._end_run()
        return "".join(self.out)


def text_part(text: Column) -> Column:
    """A turn's plain text as its only part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))


def format_turns(df: DataFrame, role: str = "role", parts: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """``df`` with each turn's formatted segment, its loss span, attachments and expanded token count.

    ``parts`` is an array of (kind, text, ref, units); kind is text, image, audio
    or document; a part of a null or unknown kind counts as its text. loss_start and loss_end are code points within the
    segment, equal for turns of other roles; offsets of attachments count within
    the turn's content. Null parts, texts and roles are empty; repeated rows and
    ties stay as they are, since a row is formatted alone; an empty table gives
    none. Columns of the names it adds are replaced; all others are kept.
    """
    small_batches(df.sparkSession)
    added = ["segment", "loss_start", "loss_end", "attachments", "expanded_tokens"]
    keep = [c for c in df.columns if c not in added]
    kinds = df.select(*[f"`{c}`" for c in keep]).schema
    schema = StructType([*kinds.fields, *StructType.fromDDL(SEGMENT).fields])
    struct = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("offset", pa.int32()), ("tokens", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments, starts, ends, attached, tokens = [], [], [], [], []
            for name, content in zip(batch.column(keep.index(role)).to_pylist(), batch.column(keep.index(parts)).to_pylist()):
                visitor = Flatten()
                for part in content or ():
                    visitor.visit(part)
                head, content = f"{TURN}{escape(name or '')}{SAYS}", visitor.content()
                segments.append(f"{head}{content}{END}")
                starts.append(len(head))
                ends.append(len(head) + visitor.length * (name == loss_role))
                attached.append(visitor.attachments)
                tokens.append(visitor.expanded)
            new = [pa.array(segments, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(attached, struct), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*keep, *added])

    return df.select(*[f"`{c}`" for c in keep]).mapInArrow(run, schema)


def parse_segment(segment: str) -> tuple[str, str]:
    """Role and content, unescaped, of one formatted turn."""
    if not (segment.startswith(TURN) and segment.endswith(END)):
        raise ValueError("not a formatted turn")
    role, mark, content = segment[len(TURN) : -len(END)].partition(SAYS)
    if not mark:
        raise ValueError("a formatted turn has no content mark")
    return unescape(role), unescape(content)


def digest(turns: DataFrame, conv: str = "conv_id", order: tuple[str, ...] = ("turn", "role", "text")) -> DataFrame:
    """Per conversation, read back from its segments in order: counts and digests.

    Segments are sorted within partitions by conversation and order and read as a
    stream: hashes and counts are all that is held, however long a conversation
    is. Rows with a null conversation id form one conversation; null turns come
    first; rows that tie in turn are ordered by role and text.
    """
    parts = turns.select(F.col(conv).cast("long").alias("conv_id"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], "segment", "loss_start", "loss_end")
    dealt = parts.repartition("conv_id").sortWithinPartitions("conv_id", *[f"o{i}" for i in range(len(order))])
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row():
            return [now, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]]

        for batch in batches:
            done = []
            for conv_id, segment, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end"))):
                if state is None or conv_id != now:
                    if state is not None:
                        done.append(row())
                    now, state = conv_id, {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                role, content = parse_segment(segment)
                state["n"] += 1
                state["turns"].update(f"{role}\n{content}\n".encode())
                masked = unescape(segment[start:end])
                state["loss"].update(masked.encode())
                state["loss_chars"] += len(masked)
                state["chars"] += len(segment)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), types)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(), types)], names)

    return dealt.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
