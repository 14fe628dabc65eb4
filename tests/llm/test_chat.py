"""Chat formatting: exact round trips of awkward texts, and every way a conversation can be cut into blocks."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, block string, ids int"
PIECES = [*chat.CONTROL, "<", "[", "\\", "/", "s>", "INST]", "é", "\n", " ", "a", "<|endoftext|>", "ROLE]", "\x00", "𝄞"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def awkward(rng, n=8):
    return "".join(rng.choice(PIECES) for _ in range(rng.randint(0, n)))


def plain(rows):
    """What reading back must give, from the rows alone."""
    chats = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        chats[conv].append((turn is not None, turn, role or "", text or ""))
    found = {}
    for conv, own in chats.items():
        own = [(r, t) for _, _, r, t in sorted(own, key=lambda x: (x[0], x[1] or 0, x[2]))]
        taught = "".join(t for r, t in own if r == "assistant")
        size = sum(sum(len(chat.CONTROL[p]) if isinstance(p, int) else len(p) for p in chat.segments(r, t)) for r, t in own)
        found[conv] = (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(taught), sha(taught), size)
    return found


def read(spark, rows, **how):
    formatted = chat.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(3), **how)
    got = {r["conversation"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in chat.read_back(formatted).collect()}
    return formatted, got


def test_escapes_are_reversible():
    rng = random.Random(1)
    for _ in range(20_000):
        text = awkward(rng)
        shown = chat.escaped(text)
        assert chat.unescaped(shown) == text and not any(c in shown for c in chat.CONTROL)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    roles = ["user", "assistant", "system", "tool", "User", "assistant", "[/ROLE]", "", None]
    out = [(conv, turn, rng.choice(roles), rng.choice([None, awkward(rng, 12)]) if turn else awkward(rng), "clash", 1) for conv in range(60) for turn in range(rng.randint(1, 9))]
    out += [(None, 1, "user", "no conversation", None, None), (None, None, "assistant", "nor turn", None, None), (70, 5, "assistant", "", None, None)]
    out += [(71, 1, "assistant", "x" * 300_000, None, None), (72, 3, "user", "again", None, None), (72, 3, "user", "again", None, None)]
    return out + [(80, turn, ("user", "assistant")[turn % 2], f"turn {turn} </s>", None, None) for turn in range(400)]


@pytest.mark.parametrize("how", [{}, {"block_chars": 20}, {"least_hot": 50}, {"least_hot": 50, "block_chars": 30}])
def test_reads_back(spark, rows, how):
    formatted, got = read(spark, rows, **how)
    assert got == plain(rows)
    assert (formatted.dealt is not None) == ("least_hot" in how)
    blocks = formatted.rows.groupBy("conversation").count().where("count > 1").count()
    assert (blocks > 0) == ("block_chars" in how)


def test_ids_and_mask(spark, rows):
    """The ids spell the text; the mask covers each assistant's text with the id that ends it, and nothing else."""
    vocabulary = chat.Vocabulary()
    encoding, size = vocabulary.encoding, vocabulary.size
    for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).rows.collect():
        ids, loss = np.array(r["ids"]), np.array(r["loss"])
        spelled = b"".join(chat.CONTROL[i - size].encode() if i >= size else encoding.decode_single_token_bytes(i) for i in r["ids"])
        assert spelled.decode() == r["text"] and len(ids) == len(loss)
        want, turn_begin, kinds = np.zeros(len(ids), bool), 0, []
        for at, i in enumerate(ids):
            if i >= size:
                kinds.append(int(i - size))
                if kinds[-1] in (chat.INST_END, chat.SYS_END, chat.END):
                    if kinds == [chat.END]:
                        want[turn_begin : at + 1] = True
                    turn_begin, kinds = at + 1, []
        assert (loss == want).all()


def test_null_conversation_and_empty(spark):
    _, got = read(spark, [(None, 1, "user", "x", None, None)] * 30 + [(1, 1, "user", "y", None, None)], least_hot=5)
    assert got == plain([(None, 1, "user", "x")] * 30 + [(1, 1, "user", "y")])
    assert read(spark, [])[1] == {}


def test_query_holds_the_probe(spark):
    from pulsegrid.llm.queries import PROBE, op12_chat_format

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in op12_chat_format(spark, "/root/testdata/sf0.001").collect()}
    assert got == plain(rows) and got[-1][2:4] == (len(PROBE), sha(PROBE))


def test_one_large_conversation_is_many_tasks(spark):
    """A conversation with nearly all rows is formatted by several tasks, in order."""
    df = spark.range(3_000).select(F.when(F.col("id") < 2_900, 1).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    small = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(small, "false")  # else the few rows of a test are one partition again
    formatted = chat.format_chats(df, least_hot=500)
    own = formatted.dealt.select(F.col("block"), "n_turns", "text").orderBy("block").collect()
    spark.conf.set(small, "true")
    assert len(own) > 1 and sum(r["n_turns"] for r in own) == 2_900
    assert "".join(r["text"] for r in own) == "".join(f"<s>[INST]t{i}[/INST]" for i in range(2_900))
