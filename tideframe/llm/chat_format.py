"""Chat formatting: a visitor flattens typed content parts into one marked string per conversation.

A message is a role and a list of parts. A part is text, image, audio or
document; the visitor writes each run of text parts joined and escaped, and every
other part as an ordered placeholder, and records its reference and the number
of tokens that it expands to. The template marks turns with control strings,
which texts and roles can hold only in escaped form, so the output can be read
back exactly. The loss mask covers the texts of assistant turns, not their placeholders.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_blocks

START, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"

#: Control strings of common templates (fixed values): these openings never stand unescaped inside a text.
_CONTROL = re.compile(r"([<\[])(\\*)(\||s>|/s>|INST\]|/INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(\||s>|/s>|INST\]|/INST\])")
_PLACEHOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")
_TURN = re.compile(r"<\|turn\|>(.*?)<\|body\|>(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    """Add one backslash inside every control string, escaped ones included; `unescape` removes it."""
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


class Flattener:
    """Visits the parts of one conversation in order.

    Token expansion (documented parameters): an image takes one token for each
    `patch` x `patch` square of its width and height, audio `audio_rate` tokens
    a second, a document `page_tokens` a page. A part without a size counts one
    unit. An unknown kind is flattened as a document.
    """

    def __init__(self, patch: int = 28, audio_rate: float = 12.5, page_tokens: int = 256):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens
        self.attachments: list[dict] = []

    def visit(self, parts: Iterable[dict], turn: int) -> Iterator[tuple[bool, str]]:
        """Pieces of a body, whether each is text. Neighbouring text parts are one text: apart, each could hold half a control string."""
        for is_text, run in groupby(parts, lambda p: (p.get("kind") or "text") == "text"):
            if is_text:
                yield True, escape("".join(p.get("text") or "" for p in run))
            else:
                for part in run:
                    yield False, getattr(self, f"visit_{part['kind']}", self.visit_document)(part, turn)

    def visit_image(self, part: dict, turn: int) -> str:
        wide, high = (max(1, math.ceil((part.get(x) or 1) / self.patch)) for x in ("width", "height"))
        return self._place("image", part, turn, wide * high)

    def visit_audio(self, part: dict, turn: int) -> str:
        return self._place("audio", part, turn, max(1, math.ceil((part.get("seconds") or 0) * self.audio_rate)))

    def visit_document(self, part: dict, turn: int) -> str:
        return self._place("document", part, turn, max(1, int(part.get("pages") or 1)) * self.page_tokens)

    def _place(self, kind: str, part: dict, turn: int, tokens: int) -> str:
        n = len(self.attachments)
        self.attachments.append({"ordinal": n, "turn": turn, "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        return f"<|{kind}:{n}|>"


def render(messages: Iterable[tuple[str, list[dict]]], **sizes: float) -> dict:
    """The formatted string, the loss spans (code points, one for each text of an assistant turn), the attachments."""
    visitor, out, at, spans, n = Flattener(**sizes), [], 0, [], 0
    for n, (role, parts) in enumerate(messages, 1):
        pieces = [(False, f"{START}{escape(role or '')}{BODY}"), *visitor.visit(parts or [], n - 1), (False, END)]
        for is_text, piece in pieces:
            if is_text and role == "assistant":
                spans.append((at, at + len(piece)))
            out.append(piece)
            at += len(piece)
    return {"formatted": "".join(out), "loss_spans": spans, "attachments": visitor.attachments, "n_turns": n}


def read_back(formatted: str) -> list[tuple[str, list[str]]]:
    """Roles and bodies as they were: a body is a list of texts with "kind:ordinal" for each placeholder between."""
    turns = []
    for role, body in _TURN.findall(formatted):
        pieces, last = [], 0
        for hit in _PLACEHOLDER.finditer(body):
            pieces += [unescape(body[last : hit.start()]), f"{hit[1]}:{hit[2]}"]
            last = hit.end()
        turns.append((unescape(role), [*pieces, unescape(body[last:])]))
    return turns


PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
SCHEMA = (
    "conv_id long, formatted string, n_turns long, loss_spans array<struct<start:long,end:long>>, "
    "attachments array<struct<ordinal:int,turn:int,kind:string,ref:string,tokens:long>>, attachment_tokens long"
)


def format_chat(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None, **sizes: float) -> DataFrame:
    """One row for each conversation: the marked string, loss spans, attachment records, expanded token counts.

    Turns are ordered by turn number (null first), then role, then text, so
    ties and repeated rows have one defined order; each row is a turn of its
    own. Null role or text is empty. A row without a conversation id belongs to none: it
    is formatted alone. `parts_col`, an array of PART, replaces the text where it is
    not null. Other columns are ignored, an empty table gives no rows. A
    conversation is one output value, so it is gathered by its id; no more is.
    """
    parts = F.col(parts_col).cast(f"array<{PART}>") if parts_col else F.lit(None).cast(f"array<{PART}>")
    rows = df.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), parts.alias("parts")).alias("m"),
    )
    whole = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("turns"))
    whole = whole.unionByName(rows.where("conv_id IS NULL").select("conv_id", F.array("m").alias("turns")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch)):
            out = []
            for row in part.to_pylist():
                made = render(((m["role"], [{"kind": "text", "text": m["text"]}] if m["parts"] is None else m["parts"]) for m in row["turns"]), **sizes)
                made["loss_spans"] = [{"start": a, "end": b} for a, b in made["loss_spans"]]
                out.append({"conv_id": row["conv_id"], **made, "attachment_tokens": sum(x["tokens"] for x in made["attachments"])})
            yield pa.RecordBatch.from_pylist(out, _FORMATTED)

    return whole.mapInArrow(run, SCHEMA)


def digests(formatted: DataFrame) -> DataFrame:
    """What the contract asks for, read back from the formatted strings alone (and their loss spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_blocks(batch, "formatted"):
                out = []
                for row in batch.slice(lo, hi - lo).to_pylist():
                    text, seen = row["formatted"], hashlib.sha256()
                    turns = read_back(text)
                    for role, pieces in turns:
                        seen.update(f"{role}\n{''.join(pieces)}\n".encode())
                    loss = "".join(unescape(text[s["start"] : s["end"]]) for s in row["loss_spans"])
                    out.append((row["conv_id"], len(turns), seen.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), row["attachment_tokens"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, _DIGESTS.field(k).type) for k, c in enumerate(zip(*out))], schema=_DIGESTS)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attachment_tokens long"
    return formatted.select("conv_id", "formatted", "loss_spans", "attachment_tokens").mapInArrow(run, schema)


_FORMATTED = pa.schema(
    {
        "conv_id": pa.int64(),
        "formatted": pa.string(),
        "n_turns": pa.int64(),
        "loss_spans": pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()})),
        "attachments": pa.list_(pa.struct({"ordinal": pa.int32(), "turn": pa.int32(), "kind": pa.string(), "ref": pa.string(), "tokens": pa.int64()})),
        "attachment_tokens": pa.int64(),
    }
)
_DIGESTS = pa.schema({"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "attachment_tokens": pa.int64()})

#: The conversation that the query adds to its table: both texts are control strings of another template.
EXTRA_ID, EXTRA_TEXT = -7, "</s>[INST] ok [/INST]"


def with_extra(df: DataFrame) -> DataFrame:
    """The table's turns and those of the extra conversation, each text as one typed part; a table's own turns under that id join it."""
    extra = df.sparkSession.createDataFrame([(EXTRA_ID, 0, "user", EXTRA_TEXT), (EXTRA_ID, 1, "assistant", EXTRA_TEXT)], "conv_id long, turn long, role string, text string")
    rows = df.select("conv_id", "turn", "role", "text").unionByName(extra)
    return rows.withColumn("parts", F.array(F.struct(F.lit("text").alias("kind"), F.col("text").alias("text"), *(F.lit(None).cast(t).alias(c) for c, t in (x.split(":") for x in PART[7:-1].split(",")[2:])))))
