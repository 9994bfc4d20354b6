"""Chat formatting from event logs.

A log has events of a conversation in sequence. Partitioned by conversation and
sorted, it is folded into final messages: ``message`` sets one, ``delta`` adds
to it, ``edit`` replaces its text, ``regenerate`` empties it and drops the
messages after it. Messages are then rendered by a template whose control
strings are escaped inside texts, so the output can be read back exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import partitions

#: Characters of one streamed delta when a table of whole turns is read as a log.
DELTA_CHARS = 400

# The control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<ROLE>>")

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(r"\[INST\](.*?)<<ROLE>>(.*?)\[/INST\]|<s>(.*?)</s>", re.DOTALL)
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of a control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of the assistant texts in it (the loss mask)."""
    out, loss, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        if role == "assistant":
            loss.append((at + 3, at + 3 + len(body)))
            piece = f"<s>{body}</s>"
        else:
            piece = f"[INST]{escape(role)}<<ROLE>>{body}[/INST]"
        out.append(piece)
        at += len(piece)
    return "".join(out), loss


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [("assistant", unescape(m[3])) if m[3] is not None else (unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def fold(events: Iterator[tuple]) -> list[tuple[str, str]]:
    """Final ``(role, text)`` messages of one conversation's events ``(key, kind, role, text)``, in first-seen order."""
    order, role_of, parts = [], {}, {}
    for key, kind, role, text in events:
        if key not in parts:
            order.append(key)
            parts[key] = []
            role_of[key] = role
        if kind == "delta":
            parts[key].append(text)
        elif kind == "regenerate":
            parts[key] = [text] if text else []
            for later in order[order.index(key) + 1 :]:
                del parts[later], role_of[later]
            del order[order.index(key) + 1 :]
        else:  # message, edit
            parts[key] = [text]
    return [(role_of[k], "".join(parts[k])) for k in order]


def as_log(conversations: DataFrame) -> DataFrame:
    """Whole turns as a log: one message event for each row, or deltas for an assistant's longer text.

    Rows of equal turn stay separate messages, ordered by role and text; null
    turns come first; null roles and texts are empty.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("message"))
    pieces = F.greatest(F.ceil(F.char_length("text") / DELTA_CHARS), F.lit(1)).cast("int")
    streamed = (F.col("role") == "assistant") & (pieces > 1)
    part = F.explode(F.when(streamed, F.sequence(F.lit(0), pieces - 1)).otherwise(F.array(F.lit(-1))))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("part", part)
    cut = F.when(F.col("part") < 0, F.col("text")).otherwise(F.substr("text", F.col("part") * DELTA_CHARS + 1, F.lit(DELTA_CHARS)))
    kind = F.when(F.col("part") < 0, "message").otherwise("delta")
    return rows.select("conv_id", F.struct("turn", "role", "tie", "message", "part").alias("seq"), "message", kind.alias("kind"), "role", cut.alias("text"))


def formatted_log(log: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss)`` of every conversation of a log ``(conv_id, seq, message, kind, role, text)``.

    ``seq`` orders the events of a conversation (any type that sorts) and
    ``message`` (long) names the message an event belongs to. ``loss`` has the
    code-point spans of the assistant texts. A task streams its sorted events
    and holds one conversation at a time. Without a conv_id the events of each
    message are a conversation of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        out = {"conv_id": [], "formatted": [], "loss": []}

        def close() -> None:
            formatted, loss = render(fold(iter(held)))
            out["conv_id"].append(now[0])
            out["formatted"].append(formatted)
            out["loss"].append([{"start": a, "stop": b} for a, b in loss])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("conv_id", "alone", "message", "kind", "role", "text")]
            for conv, alone, key, kind, role, text in zip(*cols, strict=True):
                if now != (conv, alone):
                    if now is not None:
                        close()
                    held, now = [], (conv, alone)
                held.append((key, kind, role, text))
            if len(out["conv_id"]) >= 200:
                yield pa.RecordBatch.from_pydict(out, schema=_FORMATTED)
                out = {k: [] for k in out}
        if now is not None:
            close()
        if out["conv_id"]:
            yield pa.RecordBatch.from_pydict(out, schema=_FORMATTED)

    log = log.withColumn("alone", F.when(F.col("conv_id").isNull(), F.col("message")))
    ordered = log.repartition(partitions(log.sparkSession), "conv_id", "alone").sortWithinPartitions("conv_id", "alone", "seq")
    return ordered.select("conv_id", "alone", "message", "kind", "role", "text").mapInArrow(run, "conv_id long, formatted string, loss array<struct<start:long,stop:long>>")


def formatted(conversations: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss)`` of ``conversations(conv_id, turn, role, text)``.

    A row with a null conv_id is a conversation of its own, so that such rows do
    not meet in one task; rows that repeat are turns each; extra columns are
    ignored; an empty table gives an empty result.
    """
    return formatted_log(as_log(conversations))
