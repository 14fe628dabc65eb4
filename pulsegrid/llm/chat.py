r"""Chats as token ids with a loss mask, assembled from separately encoded segments.

Every text is encoded by itself as ordinary text and reserved ids, which no encoding yields, are
spliced around it, so no text can end its turn or begin another. The same holds for the formatted text: a control string
in a text gets a backslash after its bracket (one more, if it has some already), which reading back removes.
The mask is a prefix sum: +1 where an assistant's text begins, -1 after the id that ends it.

    system      [SYS]text[/SYS]
    user        <s>[INST]text[/INST]
    assistant   text</s>                      under the loss mask
    any other   [ROLE]role[/ROLE]text</s>

A conversation is one row, or several in order of ``block`` where it has over ``block_chars`` characters.
Conversations move once, by their id, and pass as sorted streams, so a task holds one block at a time. One with a
great part of all rows is dealt out by ranges of turns instead, so that no task formats it alone; at most
``HOT`` conversations can be that large.

Cases: a null text is empty, a null role too; turns are ordered by turn (null first), then role, then a hash of the text, so
repeated rows are all kept, in a defined order; rows with a null conversation are one conversation; a very long text is one
block; columns not named are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hot_keys import HOT

#: Control strings; each has its only bracket of this kind at its begin. The id of each is the vocabulary's size plus its place.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]")
BEGIN, END, INST, INST_END, SYS, SYS_END, ROLE, ROLE_END = range(len(CONTROL))
ESCAPE = re.compile(r"<(?=\\*/?s>)|\[(?=\\*/?(?:INST|SYS|ROLE)\])")
UNESCAPE = re.compile(r"(<(?=\\+/?s>)|\[(?=\\+/?(?:INST|SYS|ROLE)\]))\\")

#: How the vocabulary's own training cut texts into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

Batches = Iterator[pa.RecordBatch]
FORMATTED = "block long, n_turns long, text string, ids array<int>, loss array<boolean>"
READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(text: str) -> str:
    return ESCAPE.sub(r"\g<0>\\", text)


def unescaped(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


@dataclass(frozen=True)
class Vocabulary:
    """A lossless byte-level vocabulary; every executor reads it from ``path``."""

    path: str = VOCABULARY
    pattern: str = PATTERN

    @property
    def encoding(self) -> tiktoken.Encoding:
        return loaded(self.path, self.pattern)

    @property
    def size(self) -> int:
        return self.encoding.max_token_value + 1


@lru_cache(4)
def loaded(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def segments(role: str, text: str) -> list[int | str]:
    """The turn as control strings, by their place in ``CONTROL``, and escaped texts."""
    text = escaped(text)
    if role == "user":
        return [BEGIN, INST, text, INST_END]
    if role == "system":
        return [SYS, text, SYS_END]
    if role == "assistant":
        return [text, END]
    return [ROLE, escaped(role), ROLE_END, text, END]


class Block:
    """Turns of one conversation on their way into one row."""

    def __init__(self, conversation: object, number: int):
        self.conversation, self.number = conversation, number
        self.parts: list[str] = []
        self.ids: list[list[int]] = []
        self.taught: list[tuple[int, int]] = []  # first and last + 1 segment under the mask
        self.n_turns = self.chars = 0

    def add(self, role: str, text: str, vocabulary: Vocabulary, encoding: tiktoken.Encoding, size: int) -> None:
        first = len(self.ids)
        for piece in segments(role, text):
            known = isinstance(piece, int)
            self.ids.append([size + piece] if known else encoding.encode_ordinary(piece))
            self.parts.append(CONTROL[piece] if known else piece)
        if role == "assistant":
            self.taught.append((first, len(self.ids)))
        self.n_turns += 1
        self.chars += len(text)

    def row(self) -> tuple:
        starts = np.zeros(len(self.ids) + 1, np.int64)
        np.cumsum([len(x) for x in self.ids], out=starts[1:])
        flat = np.fromiter((i for x in self.ids for i in x), np.int32, int(starts[-1]))
        change = np.zeros(len(flat) + 1, np.int8)
        for first, last in self.taught:
            change[starts[first]] += 1
            change[starts[last]] -= 1
        return self.number, self.n_turns, "".join(self.parts), flat, np.cumsum(change[:-1]).astype(bool)


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays), kind))


def table(conversations: list, rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    number, n_turns, text, ids, loss = zip(*rows)
    columns = [pa.array(conversations, kind), pa.array(number, pa.int64()), pa.array(n_turns, pa.int64()), pa.array(text, pa.string()), lists(list(ids), pa.int32()), lists(list(loss), pa.bool_())]
    return pa.record_batch(columns, names=["conversation", "block", "n_turns", "text", "ids", "loss"])


def assembled(vocabulary: Vocabulary, block_chars: int, dealt_out: bool) -> Callable[[Batches], Batches]:
    """Blocks out of (conversation, role, text) in order; ``dealt_out``: the conversation goes on in later partitions."""

    def run(batches: Batches) -> Batches:
        encoding, size = vocabulary.encoding, vocabulary.size
        base = TaskContext.get().partitionId() << 32 if dealt_out else 0
        block, done, done_of, waiting, kind = None, [], [], 0, None
        for batch in batches:
            kind = batch.column(0).type
            for conversation, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                same = block is not None and block.conversation == conversation
                if block is not None and (not same or block.chars + len(text) > block_chars):
                    done.append(block.row())
                    done_of.append(block.conversation)
                    waiting += block.chars
                    if waiting >= block_chars:
                        yield table(done_of, done, kind)
                        done, done_of, waiting = [], [], 0
                    block = Block(conversation, block.number + 1 if same else base)
                block = block or Block(conversation, base)
                block.add(role, text, vocabulary, encoding, size)
        if block is not None:
            yield table([*done_of, block.conversation], [*done, block.row()], kind)

    return run


@dataclass
class Formatted:
    """``near``: conversations whose blocks follow each other in one partition; ``dealt``: those dealt out, or None."""

    near: DataFrame
    dealt: DataFrame | None
    vocabulary: Vocabulary

    @property
    def rows(self) -> DataFrame:
        """conversation, block, n_turns, text, ids, loss."""
        return self.near if self.dealt is None else self.near.unionByName(self.dealt)


def format_chats(
    chats: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    vocabulary: Vocabulary = Vocabulary(),
    block_chars: int = 1 << 22,
    least_hot: int = 10_000,
) -> Formatted:
    """All conversations of ``chats``; one of more than ``least_hot`` rows and a two-thousandth of all is dealt out."""
    empty = F.lit("")
    rows = chats.select(F.col(conv_col).alias("conversation"), F.col(turn_col).alias("turn"), F.coalesce(role_col, empty).alias("role"), F.coalesce(text_col, empty).alias("text"))
    order = ["conversation", "turn", "role", F.xxhash64("text")]
    sizes = rows.groupBy("conversation").count()
    n = sizes.agg(F.sum("count")).first()[0] or 0
    hot = [r["conversation"] for r in sizes.where(F.col("count") > max(least_hot, n // HOT)).collect()]  # at most HOT rows
    is_hot = F.coalesce(F.col("conversation").isin([c for c in hot if c is not None]), F.lit(None in hot))
    schema = f"conversation {rows.schema['conversation'].dataType.simpleString()}, {FORMATTED}"

    def blocks(some: DataFrame, dealt_out: bool) -> DataFrame:
        ordered = some.sortWithinPartitions(*order).select("conversation", "role", "text")
        return ordered.mapInArrow(assembled(vocabulary, block_chars, dealt_out), schema)

    near = blocks(rows.where(~is_hot).repartition("conversation") if hot else rows.repartition("conversation"), False)
    dealt = blocks(rows.where(is_hot).repartitionByRange(*order), True) if hot else None
    return Formatted(near, dealt, vocabulary)


def turns(ids: np.ndarray, loss: np.ndarray, encoding: tiktoken.Encoding, size: int) -> Iterator[tuple[str, str, str, int]]:
    """Role, text, text under the mask and formatted length of each turn of a block of ids."""
    marks = np.flatnonzero(ids >= size)
    kinds, at = ids[marks] - size, 0

    def text(first: int, last: int) -> tuple[str, str, int]:
        own, under = ids[first:last], loss[first:last]
        whole = encoding.decode_bytes(own.tolist()).decode()
        taught = whole if under.all() else encoding.decode_bytes(own[under].tolist()).decode(errors="replace")
        return unescaped(whole), unescaped(taught), len(whole)

    wide, i = [len(c) for c in CONTROL], 0
    while i < len(marks):
        kind = int(kinds[i]) if marks[i] == at else END
        spliced = 1 if kind == END else {BEGIN: 3, SYS: 2, ROLE: 3}[kind]
        role, length = {BEGIN: "user", SYS: "system", END: "assistant"}.get(kind, ""), sum(wide[k] for k in kinds[i : i + spliced])
        if kind == ROLE:
            role, _, more = text(marks[i] + 1, marks[i + 1])
            length += more
        first = at if kind == END else int(marks[i + spliced - 2]) + 1
        said, taught, more = text(first, int(marks[i + spliced - 1]))
        yield role, said, taught, length + more
        i, at = i + spliced, int(marks[i + spliced - 1]) + 1


def read_by(vocabulary: Vocabulary) -> Callable[[Batches], Batches]:
    """Digests of conversations out of (conversation, ids, loss), whose blocks follow each other in order."""

    def run(batches: Batches) -> Batches:
        encoding, size = vocabulary.encoding, vocabulary.size
        state, kind = None, None

        def closed() -> pa.RecordBatch:
            conversation, said, taught, (n, n_taught, chars) = state
            values = [[conversation], [n], [said.hexdigest()], [n_taught], [taught.hexdigest()], [chars]]
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds)], names=["conversation", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            kind, found = batch.column(0).type, []
            for row, conversation in enumerate(batch.column(0).to_pylist()):
                if state is None or state[0] != conversation:
                    if state is not None:
                        found.append(closed())
                    state = (conversation, hashlib.sha256(), hashlib.sha256(), [0, 0, 0])
                _, said, taught, counts = state
                ids = batch.column(1)[row].values.to_numpy(zero_copy_only=False)
                loss = batch.column(2)[row].values.to_numpy(zero_copy_only=False)
                for role, text, under, chars in turns(ids, loss, encoding, size):
                    said.update(f"{role}\n{text}\n".encode())
                    taught.update(under.encode())
                    counts[0] += 1
                    counts[1] += len(under)
                    counts[2] += chars
            if found:
                yield pa.Table.from_batches(found).combine_chunks().to_batches()[0]
        if state is not None:
            yield closed()

    return run


def read_back(formatted: Formatted) -> DataFrame:
    """One row per conversation, from its ids and mask alone.

    A SHA-256 of a whole conversation takes its bytes one after another, so the digest of one that is dealt out is
    a sorted stream through one task, though what it digests was formatted by many.
    """
    schema = f"conversation {formatted.near.schema['conversation'].dataType.simpleString()}, {READ}"
    found = formatted.near.select("conversation", "ids", "loss").mapInArrow(read_by(formatted.vocabulary), schema)
    if formatted.dealt is None:
        return found
    again = formatted.dealt.select("conversation", "block", "ids", "loss").repartition("conversation").sortWithinPartitions("conversation", "block")
    return found.unionByName(again.select("conversation", "ids", "loss").mapInArrow(read_by(formatted.vocabulary), schema))
