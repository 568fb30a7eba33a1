"""Chat formatting from event logs.

A conversation is what its log says: messages are opened, streamed in deltas, edited and
generated anew.  Events are partitioned by conversation and sorted by sequence; a fold
over the sorted stream keeps the messages of one conversation at a time and renders it
when the next begins.  The template marks turns with control strings, which are escaped
inside roles and texts so that the output can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"

#: Events: a message begins with a text, goes on, has its text replaced, or is dropped
#: with all after it so that it can be generated anew under the same number.
MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"

EVENTS = "conv_id long, seq long, kind string, message long, role string, text string"
FORMATTED = (
    "conv_id long, n_turns long, formatted string, loss array<struct<start: long, stop: long>>"
)
#: Formatted characters in one batch on the way to Spark, about.
BATCH_CHARS = 8_000_000


def escape(text: str) -> str:
    """No control string is left: ``<|`` has a backslash inside, ``<\\|`` one more, and so on."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def _role(role: str) -> str:
    """A role fills one line."""
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def _unrole(line: str) -> str:
    return unescape(line.replace("%0A", "\n").replace("%25", "%"))


@dataclass
class Conversation:
    """Messages of a conversation as its events have made them so far."""

    conv_id: int | None
    order: list = field(default_factory=list)
    roles: dict = field(default_factory=dict)
    texts: dict = field(default_factory=dict)

    def apply(self, kind: str | None, message, role: str | None, text: str | None) -> None:
        """Events for messages that aren't there are left out, as are unknown kinds."""
        if kind == MESSAGE:
            if message in self.texts:
                self._drop_from(message)
            self.order.append(message)
            self.roles[message] = role or ""
            self.texts[message] = [text or ""]
        elif message not in self.texts:
            return
        elif kind == DELTA:
            self.texts[message].append(text or "")
        elif kind == EDIT:
            self.texts[message] = [text or ""]
        elif kind == REGENERATE:
            role = self.roles[message]
            self._drop_from(message)
            self.apply(MESSAGE, message, role, text)

    def _drop_from(self, message) -> None:
        at = self.order.index(message)
        for gone in self.order[at:]:
            del self.texts[gone], self.roles[gone]
        del self.order[at:]

    def turns(self) -> list[tuple[str, str]]:
        return [(self.roles[m], "".join(self.texts[m])) for m in self.order]


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of assistant texts in it, in code points."""
    pieces, loss, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_role(role)}\n", escape(text)
        if role == ASSISTANT:
            loss.append((at + len(head), at + len(head) + len(body)))
        piece = f"{head}{body}{END}\n"
        pieces.append(piece)
        at += len(piece)
    return "".join(pieces), loss


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns that a formatted text was rendered from."""
    turns = []
    for piece in formatted.split(START)[1:]:
        role, _, body = piece.partition("\n")
        turns.append((_unrole(role), unescape(body[: body.rindex(END)])))
    return turns


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: Conversation | None = None
    done: list[dict] = []
    chars = 0
    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("n_turns", pa.int64()),
            ("formatted", pa.string()),
            ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
        ]
    )

    def close(conversation: Conversation) -> None:
        nonlocal chars
        turns = conversation.turns()
        formatted, loss = render(turns)
        spans = [{"start": a, "stop": b} for a, b in loss]
        done.append(
            {
                "conv_id": conversation.conv_id,
                "n_turns": len(turns),
                "formatted": formatted,
                "loss": spans,
            }
        )
        chars += len(formatted)

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for conv_id, _, kind, message, role, text in zip(*columns, strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    close(now)
                now = Conversation(conv_id)
            now.apply(kind, message, role, text)
            if chars > BATCH_CHARS:
                yield pa.RecordBatch.from_pylist(done, schema)
                done, chars = [], 0
    if now is not None:
        close(now)
    if done:
        yield pa.RecordBatch.from_pylist(done, schema)


def format_conversations(events: DataFrame) -> DataFrame:
    """One row for each conversation of a log (conv_id, seq, kind, message, role, text).

    Null texts and roles are empty.  Events with equal seq are taken in the order of
    message, kind, role and text; events without conv_id are one conversation, whose
    conv_id is null.  A conversation may be of any length that fits a row; the rows of a
    partition are streamed and sorted by Spark, which spills.
    """
    order = ["conv_id", "seq", "message", "kind", "role", "text"]
    columns = [F.col(f.split()[0]).cast(f.split()[1]) for f in EVENTS.split(", ")]
    return (
        events.select(*columns)
        .repartition("conv_id")
        .sortWithinPartitions(*order)
        .mapInArrow(_folded, FORMATTED)
    )


def events_of(turns: DataFrame) -> DataFrame:
    """A log that opens one message for each row (conv_id, turn, role, text).

    Rows of one turn stay separate messages: their number is their place in the log.
    """
    from pyspark.sql import Window

    place = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.col("role").cast("string"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.select(
        "conv_id",
        F.row_number().over(place).cast("long").alias("seq"),
        F.lit(MESSAGE).alias("kind"),
        F.row_number().over(place).cast("long").alias("message"),
        "role",
        "text",
    )


def fixed_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts consist of control strings."""
    said = f"{END}{START}{ASSISTANT} ok"
    return spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, ASSISTANT, said)],
        "conv_id long, turn long, role string, text string",
    )


def digest_of(formatted: DataFrame) -> DataFrame:
    """What the formatted texts hold, read back from them and from their loss spans."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                conv_id, text, loss = row
                turns = read_back(text)
                all_turns, learned, chars = hashlib.sha256(), hashlib.sha256(), 0
                for role, said in turns:
                    all_turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    said = unescape(text[span["start"] : span["stop"]])
                    learned.update(said.encode("utf-8", "surrogatepass"))
                    chars += len(said)
                rows.append(
                    (conv_id, len(turns), all_turns.hexdigest(), chars, learned.hexdigest(), len(text))
                )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(column, kind)
                    for column, kind in zip(
                        zip(*rows, strict=True) if rows else [[]] * 6,
                        [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()],
                        strict=True,
                    )
                ],
                names,
            )

    names = "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars".split()
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(
        digests,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long",
    )
