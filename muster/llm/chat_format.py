"""Chat training examples by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and
only its text under the loss mask. Turns after the last reply, or of a conversation without one,
make a last example without a target, so that no turn is lost.

A turn is written as ``<|im_start|>role``, a line end, the text, ``<|im_end|>`` and a line end. A
control string inside a text is broken by a backslash after its first character; one that is
broken already gets one backslash more, so taking one away gives the text back. In a role,
backslashes and line ends are escaped as well.

An example is one value that holds its conversation up to the reply, so the size of a conversation is
bounded by that of a value (2 GiB), and the examples of n turns hold about n²/4 of them. Nothing is
collected beyond that: examples leave in batches of some megabytes, and a conversation of more than
``PART_TURNS`` turns is dealt over tasks, each with the turns up to its last example.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type
from pyspark.sql.types import StructField, StructType

from muster.llm.common import batches, input_partitions, stage
from muster.operators.lookup import spread_lookup
from muster.operators.order import dense_position

# Control strings of public chat templates.
START, END = "<|im_start|>", "<|im_end|>"
CONTROLS = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
REPLIES = "assistant"

PART_TURNS = 256
BATCH_BYTES = 4 << 20

# Controls begin with < or [ and hold neither again, so no two of them overlap.
CONTROL_PATTERN = r"([<\[])(\\*)(" + "|".join(re.escape(c[1:]) for c in CONTROLS) + ")"
_PLAIN = re.compile(CONTROL_PATTERN)
_BROKEN = re.compile(CONTROL_PATTERN.replace(r"(\\*)", r"\\(\\*)", 1))


def escape(text: str) -> str:
    """``text`` without any control string; ``unescape`` gives it back."""
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _BROKEN.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    """A role on one line."""
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """``(role, text)`` of each turn of a formatted text."""
    at, size = 0, len(formatted)
    while at < size:
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        if not formatted.startswith(START, at) or not formatted.startswith("\n", end + len(END)):
            raise ValueError(f"no turn at {at}")
        yield unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])
        at = end + len(END) + 1


class _Conversation:
    """The examples of one part of a conversation, turn by turn."""

    def __init__(self, conv: object, part: int, parts: int, part_turns: int) -> None:
        self.key, self.parts = (conv, part), parts
        self.known = part * part_turns  # turns whose examples are another part's
        self.text, self.chars, self.turns = bytearray(), 0, 0
        self.open = False  # whether turns follow the last reply
        self.held: tuple | None = None

    def _example(self, span: tuple[int | None, int | None], whole: bool) -> tuple:
        return (*self.key, self.parts, self.turns, bytes(self.text), *span, whole)

    def add(self, role: str, said: str) -> Iterator[tuple]:
        """Take a turn up; gives the example before, which is not the last one then."""
        head, body = f"{START}{escape_role(role)}\n", escape(said)
        self.text += f"{head}{body}{END}\n".encode()
        begin = self.chars + len(head)
        self.chars = begin + len(body) + len(END) + 1
        self.turns += 1
        self.open = role != REPLIES or self.turns <= self.known
        if not self.open:
            if self.held:
                yield self.held
            self.held = self._example((begin, begin + len(body)), False)

    def close(self) -> Iterator[tuple]:
        """What is left; in the last part, its last example holds the whole conversation."""
        last = self.key[1] == self.parts - 1
        if self.held:
            yield (*self.held[:-1], last and not self.open)
        if last and self.open:
            yield self._example((None, None), True)


_EXAMPLE = pa.schema([
    ("conv_id", pa.null()), ("part", pa.int64()), ("parts", pa.int64()), ("n_turns", pa.int64()), ("text", pa.string()),
    ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("whole", pa.bool_()),
])
_DIGEST = pa.schema([
    ("conv_id", pa.null()), ("part", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
    ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("said", pa.string()), ("formatted_chars", pa.int64()),
])


def _turns(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches(source, 64):
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _examples_of(rows: Iterator[tuple], part_turns: int) -> Iterator[tuple]:
    """Rows sorted by conversation, part and turn become the examples of each part."""
    at: _Conversation | None = None
    for conv, part, parts, role, said in rows:
        if at is None or (conv, part) != at.key:
            if at:
                yield from at.close()
            at = _Conversation(conv, part, parts, part_turns)
        yield from at.add(role, said)
    if at:
        yield from at.close()


def _batched(rows: Iterator[tuple], schema: pa.Schema, kind: pa.DataType, text: str) -> Iterator[pa.RecordBatch]:
    """Some megabytes of rows at a time, by the size of their ``text``; ``kind`` is that of ``conv_id``."""
    typed = schema.set(0, pa.field("conv_id", kind))
    at = schema.get_field_index(text)

    def batch(held: list[tuple]) -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, typed, strict=True)], schema=typed)

    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[at] or "")
        if size > BATCH_BYTES:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def _map(rows: DataFrame, schema: pa.Schema, text: str, step: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """``step`` over the rows of each task, in their order."""
    kind = rows.schema["conv_id"].dataType

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(step(_turns(source)), schema, to_arrow_type(kind), text)

    fields = [StructField("conv_id", kind), *(StructField(f.name, from_arrow_type(f.type)) for f in list(schema)[1:])]
    return rows.mapInArrow(run, StructType(fields))


def expand(rows: DataFrame, *, part_turns: int = PART_TURNS) -> DataFrame:
    """The examples of all conversations of ``rows(conv_id, turn, role, text)``.

    ``(conv_id, part, parts, n_turns, text, loss_start, loss_end, whole)``: ``text`` holds the first
    ``n_turns`` turns, and the loss mask covers its code points from ``loss_start`` up to ``loss_end``
    (null: none of them). ``whole`` marks the example that holds every turn of its conversation.

    Turns are in order of ``turn``, null first, then of role and text. A null role or text is empty, and
    rows with a null ``conv_id`` are one conversation. Equal rows are turns of their own. Other columns play no part, and an
    empty table gives no examples.
    """
    filled = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    turns = rows.select("conv_id", key.alias("_key"), F.col("turn").alias("_turn"), *filled)
    order = ["_turn", "role", "text"]
    sizes = turns.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > part_turns)
    long = stage(sizes.select("_key", F.ceil(F.col("_n") / part_turns).cast("bigint").alias("parts")), "long")
    marked = spread_lookup(turns, long, ["_key"], order, how="left")
    short = marked.where(F.col("parts").isNull()).withColumns({"part": F.lit(0).cast("bigint"), "parts": F.lit(1).cast("bigint")})
    if not long.isEmpty():
        # a turn goes to the part in which it may be a target and to all after it
        placed = dense_position(marked.where(F.col("parts").isNotNull()), ["_key"], order)
        own = F.floor((F.col("position") - 1) / part_turns).cast("bigint")
        dealt = placed.withColumn("part", F.explode(F.sequence(own, F.col("parts") - 1))).drop("position")
        short = short.unionByName(dealt)
    # more tasks than the input has splits: examples are several times its size
    dealt = short.repartition(4 * input_partitions(rows), "_key", "part").sortWithinPartitions("_key", "part", *order)

    ordered = dealt.select("conv_id", "part", "parts", "role", "text")
    return _map(ordered, _EXAMPLE, "text", lambda turns: _examples_of(turns, part_turns))


def _read_back(examples: Iterator[tuple]) -> Iterator[tuple]:
    """One row a part: what its examples say, in the order in which they come."""
    for (conv, part, parts), run in groupby(examples, lambda example: example[:3]):
        said, chars, n_turns, turns_hash = [], 0, None, None
        for *_, text, start, end, whole in run:
            chars += len(text)
            if start is not None:
                said.append(unescape(text[start:end]))
            if whole:
                hashed, n_turns = hashlib.sha256(), 0
                for role, words in parse(text):
                    hashed.update(f"{role}\n{words}\n".encode())
                    n_turns += 1
                turns_hash = hashed.hexdigest()
        learned = "".join(said)
        digest = hashlib.sha256(learned.encode()).hexdigest()
        yield conv, part, n_turns, turns_hash, len(learned), *((digest, None) if parts == 1 else (None, learned)), chars


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of conversations, from the output of ``expand`` alone and in the order it gives.

    ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``. Turns are read from the
    example that holds all of them, and what is learned from each example's mask. The examples of a part
    follow each other in one task and are not sorted again. Only what the parts of a long conversation learn meets in
    a group, and an example that holds all of it bounds that.
    """
    parts = _map(examples, _DIGEST, "said", _read_back)
    learned = F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("part", "said"))))
    joined = F.sha2(F.array_join(F.transform(learned, lambda p: p["said"]), ""), 256)
    return parts.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.sum("loss_chars").alias("loss_chars"),
        F.coalesce(F.max("loss_sha256"), joined).alias("loss_sha256"),
        F.sum("formatted_chars").alias("formatted_chars"),
    )


def with_control_texts(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` and conversation -1, in which both sides say control strings."""
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    kinds = dict(conversations.dtypes)
    role = F.when(F.col("id") == 0, "user").otherwise(REPLIES).alias("role")
    more = conversations.sparkSession.range(2).select(
        F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), role, said
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(more)
