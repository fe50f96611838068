"""Chat formatting: typed content parts flattened by a visitor, turns marked by a template that can be read back.

A turn is ``<|turn|>role<|says|>content<|end|>`` and a line feed. Inside roles and texts every backslash and every ``<|``
gets a backslash in front, so no text can end a turn or fake a placeholder, and removing these backslashes gives the text
back. Image, audio and document parts become the placeholders ``<|image:0|>``, ``<|audio:1|>`` ... numbered through the
conversation; their references are recorded in that order with the tokens they stand for.
"""
from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"
KINDS = ("image", "audio", "document")
PARTS = "array<struct<kind:string,text:string,ref:string,tokens:int>>"  # the type of a column of content parts
TRAINED = "assistant"
_ESCAPED = re.compile(r"\\(\\|<\|)")
_CONTROL = re.compile(r"\\\\|\\<\||<\|(turn|says|end|(?:image|audio|document):\d+)\|>")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "\\<|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def count_words(text: str) -> int:
    """The default token count: words and single signs."""
    return len(re.findall(r"\w+|[^\w\s]", text))


class PartVisitor:
    """Flattens the parts of a conversation; one method for each kind of part."""

    def __init__(self, count: Callable[[str], int] = count_words):
        self.count, self.attachments, self.tokens = count, [], 0

    def visit(self, part: dict) -> str:
        kind = part.get("kind") or "text"
        return getattr(self, f"visit_{kind}", self.visit_other)(part)

    def visit_text(self, part: dict) -> str:
        text = part.get("text") or ""
        self.tokens += self.count(text)
        return escape(text)

    def _attach(self, part: dict) -> str:
        n, kind = len(self.attachments), part["kind"]
        tokens = part.get("tokens") or 0
        self.attachments.append({"index": n, "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        self.tokens += tokens
        return f"<|{kind}:{n}|>"

    visit_image = visit_audio = visit_document = _attach

    def visit_other(self, part: dict) -> str:
        """An unknown kind is kept as text."""
        return self.visit_text(part)


def format_turns(turns: list[tuple[str | None, list[dict]]], count: Callable[[str], int] = count_words) -> dict:
    """Formatted text, spans under the loss mask (code points of trained contents), attachments and expanded tokens."""
    visitor, out, at, spans = PartVisitor(count), [], 0, []
    for role, parts in turns:
        head = TURN + escape(role or "") + SAYS
        content = "".join(visitor.visit(p) for p in parts)
        if role == TRAINED:
            spans.append((at + len(head), at + len(head) + len(content)))
        out += [head, content, END]
        at += len(head) + len(content) + len(END)
    return {"formatted": "".join(out), "loss_start": [a for a, _ in spans], "loss_end": [b for _, b in spans], "attachments": visitor.attachments, "n_tokens": visitor.tokens}


def read_back(formatted: str) -> list[tuple[str, list[dict]]]:
    """Roles and parts of a formatted conversation; the inverse of ``format_turns`` up to references, which are numbers."""
    turns, role, parts, at = [], "", [], 0
    for m in _CONTROL.finditer(formatted):
        name = m.group(1)
        if name is None:  # an escaped sign
            continue
        text = unescape(formatted[at : m.start()])
        at = m.end()
        if name == "turn":
            parts = []
        elif name == "says":
            role = text
        else:
            if text:
                parts.append({"kind": "text", "text": text})
            if name == "end":
                turns.append((role, parts))
                at += 1  # the line feed
            else:
                kind, n = name.split(":")
                parts.append({"kind": kind, "ref": n})
    return turns


_FORMATTED = "formatted string, loss_start array<long>, loss_end array<long>, attachments array<struct<index:int,kind:string,ref:string,tokens:int>>, n_tokens long"


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text",
                         count: Callable[[str], int] = count_words) -> DataFrame:
    """One row for each conversation: ``<conv>, n_turns, formatted, loss_start, loss_end, attachments, n_tokens``.

    ``content`` is a string (one text part) or a column of type ``PARTS``. Turns are ordered by (turn, role, content), nulls
    first; a null text is empty, a null role is the empty role, a null conversation id is a conversation of its own, and
    repeated rows are turns of their own. A conversation is one row of the result and so fits one task. Other columns are
    ignored.
    """
    plain = rows.schema[content].dataType.simpleString() == "string"
    parts = F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(F.col(content), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
                             F.lit(None).cast("int").alias("tokens"))) if plain else F.coalesce(F.col(content), F.array().cast(PARTS))
    one = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), parts.alias("parts"))
    whole = rows.select(F.col(conv).alias("_conv"), one.alias("_t")).groupBy("_conv").agg(F.array_sort(F.collect_list("_t")).alias("_turns"))

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 64):
                part = b.slice(a, 64)
                told = [format_turns([(t["role"], t["parts"]) for t in turns], count) for turns in part.column(1).to_pylist()]
                sizes = [len(t) for t in part.column(1)]
                kinds = {"formatted": pa.string(), "loss_start": pa.list_(pa.int64()), "loss_end": pa.list_(pa.int64()),
                         "attachments": pa.list_(pa.struct([("index", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())])), "n_tokens": pa.int64()}
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), *(pa.array([t[k] for t in told], v) for k, v in kinds.items())],
                                                 names=["_conv", "n_turns", *kinds])
    return whole.mapInArrow(run, f"_conv {rows.schema[conv].dataType.simpleString()}, n_turns long, {_FORMATTED}").withColumnRenamed("_conv", conv)


def _unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(\\|<\|)", "$1")


def read_turns(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Turns read back from ``formatted``: ``<conv>, pos, role, text`` (placeholders stay in the text)."""
    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part, out = b.slice(a, 256), []
                for k, text in enumerate(part.column(1).to_pylist()):
                    for pos, (role, parts) in enumerate(read_back(text)):
                        out.append((k, pos, role, "".join(p["text"] if p["kind"] == "text" else f"<|{p['kind']}:{p['ref']}|>" for p in parts)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([x[0] for x in out], pa.int64())), pa.array([x[1] for x in out], pa.int32()),
                                                  pa.array([x[2] for x in out], pa.string()), pa.array([x[3] for x in out], pa.string())], names=["_conv", "pos", "role", "text"])
    return formatted.select(F.col(conv).alias("_conv"), "formatted").mapInArrow(
        run, f"_conv {formatted.schema[conv].dataType.simpleString()}, pos int, role string, text string").withColumnRenamed("_conv", conv)


def masked_text(formatted: Column, start: Column, end: Column) -> Column:
    """All text under the loss mask of a formatted conversation, unescaped."""
    return _unescaped(F.array_join(F.transform(F.arrays_zip(start.alias("a"), end.alias("b")), lambda s: F.substring(formatted, (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int"))), ""))
