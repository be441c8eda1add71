"""Chat formatting from event logs: conversations are rebuilt from their events, then rendered with a loss mask.

Events are (conv_id, message, kind, role, text) in an order of columns. `start` opens a message with a role and no text,
`delta` appends, `edit` puts a text in place of what there is, `regenerate` drops it for the deltas that follow. The log
is dealt by conversation and sorted within partitions; conversations pass one after the other in a stream, so a task
holds one conversation at a time, which is also what its output row holds.

A turn is rendered as `<s>[role]`, a new line, the text, `</s>`, a new line. Inside roles and texts a backslash is
doubled, and one is put after the first character of every control string, so none is left and the text can be read
back. The mask has the spans, in code points, of the assistant's texts.

A null text or role is empty. An event of another kind is refused; one for a message that was not started opens it. A
message without events has no turn, an empty log no rows. A null conv_id is a conversation of its own. Repeated events
apply again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of chat templates; none is left inside a text.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
#: What ends a role, besides.
ROLE_END = "]\n"
LEARNED = "assistant"
KINDS = ("start", "delta", "edit", "regenerate")

_IN_TEXT = re.compile("\\\\|" + "|".join(map(re.escape, CONTROL)))
_IN_ROLE = re.compile(_IN_TEXT.pattern + "|" + re.escape(ROLE_END))
_ESCAPED = re.compile(r"\\(\\?)", re.S)
_TURN = re.compile(r"<s>\[(.*?)\]\n(.*?)</s>\n", re.S)


def escape(text: str, pattern: re.Pattern = _IN_TEXT) -> str:
    return pattern.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def rendered(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of what is learned."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"<s>[{escape(role, _IN_ROLE)}{ROLE_END}", escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "</s>\n"]
        at += len(head) + len(body) + 5
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def folded(events: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, turns) of sorted events (conv_id, message, kind, role, text)."""
    here, messages, begun = None, {}, False
    for conversation, message, kind, role, text in events:
        if not begun or conversation != here:
            if begun:
                yield here, [(role, "".join(pieces)) for role, pieces in messages.values()]
            here, messages, begun = conversation, {}, True
        if kind not in KINDS:
            raise ValueError(f"unknown kind of event: {kind}")
        entry = messages.setdefault(message, [role or "", []])
        if kind == "start":
            entry[0] = role or ""
        elif kind == "delta":
            entry[1].append(text or "")
        elif kind == "edit":
            entry[1] = [text or ""]
        else:
            entry[1] = []
    if begun:
        yield here, [(role, "".join(pieces)) for role, pieces in messages.values()]


def formatted(events: DataFrame, *order: str) -> DataFrame:
    """Rows (conv_id, formatted, loss_spans), one a conversation; `order` sorts a conversation's events."""
    def function(batches):
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(5))))
        for conversation, turns in folded(rows):
            text, spans = rendered(turns)
            yield pa.RecordBatch.from_arrays([
                pa.array([conversation], pa.int64()), pa.array([text], pa.string()), pa.array([list(map(list, spans))], pa.list_(pa.list_(pa.int64())))],
                ["conv_id", "formatted", "loss_spans"])
    log = events.withColumn("conv_id", F.col("conv_id").cast("long")).repartition("conv_id").sortWithinPartitions("conv_id", *order)
    return log.select("conv_id", "message", "kind", "role", "text").mapInArrow(function, "conv_id long, formatted string, loss_spans array<array<long>>")


def digests(conversations: DataFrame) -> DataFrame:
    """What is read back of formatted conversations: turns, their digest, and the text under the mask."""
    def function(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
                turns, learned = read_back(text), [unescape(text[a:b]) for a, b in spans]
                every, loss = hashlib.sha256(), hashlib.sha256()
                for role, said in turns:
                    every.update(f"{role}\n{said}\n".encode())
                for said in learned:
                    loss.update(said.encode())
                out.append((len(turns), every.hexdigest(), sum(map(len, learned)), loss.hexdigest(), len(text)))
            columns = zip(*out) if out else [()] * 5
            kinds = pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, kind) for c, kind in zip(columns, kinds))],
                                             ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    return conversations.select("conv_id", "formatted", "loss_spans").mapInArrow(
        function, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def event(kind: str, text: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if text is None else text).alias("text"))


def logged(conversations: DataFrame) -> DataFrame:
    """The log of finished conversations (conv_id, turn, role, text), rows by turn, then role, then a hash of the text.

    An assistant's text comes in two pieces, after a first draft that is regenerated; any other is typed wrong and edited.
    """
    text, half = F.coalesce("text", F.lit("")), F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    first, second = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    answer = F.array(event("start"), event("delta", F.upper(first)), event("regenerate"), event("delta", first), event("delta", second))
    other = F.array(event("start"), event("delta", F.reverse(text)), event("edit", text))
    rows = conversations.withColumn("message", F.monotonically_increasing_id()).select(  # before a row becomes several
        "conv_id", "turn", "role", F.xxhash64("text").alias("tie"), "message",
        F.posexplode(F.when(F.col("role") == LEARNED, answer).otherwise(other)).alias("seq", "event"))
    return rows.select("conv_id", "turn", "role", "tie", "message", "seq", "event.kind", "event.text")


LOG_ORDER = ("turn", "role", "tie", "message", "seq")
