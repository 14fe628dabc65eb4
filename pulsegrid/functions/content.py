"""Message contents: parts and their plain text, hit lists, paths, bytes (scalar families)."""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

PARTS = "array<struct<type:string,text:string,path:string,start_line:int,end_line:int,width:int,height:int,blob_id:bigint,tool_name:string,arguments_json:string>>"
HITS = "array<struct<token:string,kind:string>>"
CUT_MARK = "\n…[truncated]"


def parts_of(json: Column) -> Column:
    """The content parts of a JSON array; bad JSON has none."""
    return F.filter(F.from_json(json, PARTS), lambda p: p["type"].isNotNull())


def block(text: Column) -> Column:
    """A text that ends with a line break; nothing for a blank one."""
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) == 0, "").otherwise(F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n"))))


def flattened(json: Column) -> Column:
    """All parts as one text, with markers for what is no text."""

    def one(p: Column) -> Column:
        lines = F.when(p["start_line"].isNotNull() & p["end_line"].isNotNull(), F.concat(F.lit(":"), p["start_line"], F.lit("-"), p["end_line"])).otherwise("")
        head = F.concat(F.coalesce(p["path"], F.lit("")), lines)
        size = F.when(p["width"].isNotNull() & p["height"].isNotNull(), F.concat(F.lit(" "), p["width"], F.lit("x"), p["height"])).otherwise("")
        blob = F.when(p["blob_id"].isNotNull(), F.concat(F.lit(" blob_id="), p["blob_id"])).otherwise("")
        system = F.when(block(p["text"]) != "", F.concat(F.lit("--- system ---\n"), block(p["text"]))).otherwise("")
        call = F.concat(F.lit("[tool_call "), F.coalesce(p["tool_name"], F.lit("")), F.lit("]\n"), block(p["arguments_json"]))
        return (
            F.when(p["type"] == "system_context", system)
            .when(p["type"].isin("file_ref", "file_snippet"), F.concat(block(head), block(p["text"])))
            .when(p["type"] == "image", F.concat(F.lit("[image"), size, blob, F.lit("]\n")))
            .when(p["type"] == "tool_call", call)
            .otherwise(block(p["text"]))
        )

    return F.coalesce(F.btrim(F.array_join(F.transform(parts_of(json), one), ""), F.lit(" \t\r\n")), F.lit(""))


def content_kind(json: Column) -> Column:
    """text_only, system_only or multipart."""
    parts = F.coalesce(parts_of(json), F.expr(f"cast(array() as {PARTS})"))
    own = F.filter(parts, lambda p: p["type"] != "system_context")
    rich = F.exists(own, lambda p: p["type"].isin("image", "file_snippet", "tool_call", "tool_result"))
    plain = F.exists(own, lambda p: p["type"].isin("text", "thinking", "file_ref"))
    given = F.size(F.coalesce(F.from_json(json, PARTS), F.expr(f"cast(array() as {PARTS})"))) > 0
    return F.when(~given, "text_only").when(F.size(own) == 0, "system_only").when(rich, "multipart").when(plain, "text_only").otherwise("multipart")


def audit_text(parts_json: Column, text: Column, version: Column, most: int) -> Column:
    """The flattened parts of messages stored with them, else the raw text; cut to ``most`` characters with a mark."""
    flat = F.when((version >= 1) & (flattened(parts_json) != ""), flattened(parts_json))
    whole = F.coalesce(flat, text, F.lit(""))
    return F.when(F.length(whole) > most, F.concat(F.substring(whole, 1, most), F.lit("...[截断]"))).otherwise(whole)


def reason_line(raw: Column, most: int = 80) -> Column:
    """A judge's reason on one line, without its marks."""
    line = F.regexp_replace(F.trim(F.replace(raw, F.lit("\n"), F.lit(" "))), r"\[[AB]:[^\]]+\]\s*", "")
    return F.coalesce(F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line), F.lit(""))


def merged_hits(json: Column, tokens: Column) -> Column:
    """A hit list with its nl_skill rows replaced by ``tokens`` (an array): kept rows first, a token once whatever its case; null if nothing is left."""
    known = F.filter(F.coalesce(F.from_json(json, HITS), F.expr(f"cast(array() as {HITS})")), lambda h: (F.coalesce(h["kind"], F.lit("")) != "nl_skill") & (F.coalesce(F.trim(h["token"]), F.lit("")) != ""))
    fresh = F.transform(F.filter(tokens, lambda t: F.coalesce(F.trim(t), F.lit("")) != ""), lambda t: F.struct(F.lower(t).alias("token"), F.lit("nl_skill").alias("kind")))
    every = F.concat(known, F.coalesce(fresh, F.expr(f"cast(array() as {HITS})")))
    first = F.filter(every, lambda h, i: ~F.exists(F.slice(every, F.lit(1), i), lambda g: F.lower(g["token"]) == F.lower(h["token"])))
    return F.when(F.size(first) > 0, F.to_json(first))


def hit_counts(json: Column) -> tuple[Column, Column]:
    """How many commands and skills (natural-language ones too) a hit list holds."""
    hits = F.coalesce(F.from_json(json, HITS), F.expr(f"cast(array() as {HITS})"))
    return F.size(F.filter(hits, lambda h: h["kind"] == "command")), F.size(F.filter(hits, lambda h: h["kind"].isin("skill", "nl_skill")))


#: The arguments that may name a tool's file, in order.
PATH_KEYS = ("path", "target_file", "file", "file_path", "targetFile", "relativeWorkspacePath")


def argument_path(arguments: Column) -> Column:
    """The first path that JSON arguments name, whatever text stands before their first brace."""
    json = F.substring(arguments, F.greatest(F.instr(arguments, "{"), F.lit(1)), F.length(arguments))
    return reduce(lambda a, b: F.coalesce(a, b), [F.when(F.trim(F.get_json_object(json, f"$.{k}")) != "", F.get_json_object(json, f"$.{k}")) for k in PATH_KEYS])


def skill_in_path(path: Column) -> Column:
    """The skill whose file a path names, as a token; null if none."""
    name = F.regexp_extract(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), r"(?:^|/)skills(?:-cursor)?/([a-z0-9][a-z0-9_-]*)/skill\.md", 1)
    return F.when(name != "", F.concat(F.lit("/skills/"), name))


def cut_bytes(text: Column, most: int) -> Column:
    """A text cut to ``most`` bytes of UTF-8, between characters, with a mark. Only longer texts are looked at byte by byte."""

    @F.pandas_udf(StringType())
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda s: s.encode()[:most].decode(errors="ignore") + CUT_MARK, na_action="ignore")

    return F.when(F.octet_length(text) <= most, text).otherwise(cut(F.when(F.octet_length(text) > most, text)))


@F.pandas_udf(StringType())
def git_path(paths: pd.Series) -> pd.Series:
    """A path as git prints it, without its quotes (two pairs at most), octal bytes read as UTF-8, and unescaped."""
    import re

    def plain(s: str) -> str:
        s = s.strip()
        for _ in range(2):
            if len(s) >= 2 and s[0] == s[-1] == '"':
                s = s[1:-1]
        raw = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m[1], 8) & 255]), s.encode())
        return raw.decode(errors="replace").replace('\\"', '"').replace("\\\\", "\\")

    return paths.map(plain, na_action="ignore").fillna("")


@F.pandas_udf(BinaryType())
def unzipped(data: pd.Series) -> pd.Series:
    """Bytes, unpacked if they are gzip."""
    return data.map(lambda b: gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b, na_action="ignore")


@F.pandas_udf(BinaryType())
def zipped(data: pd.Series) -> pd.Series:
    return data.map(lambda b: gzip.compress(b, mtime=0), na_action="ignore")


#: The first bytes of image formats, in hex, and at which byte they stand.
MAGIC = ((1, "89504E470D0A1A0A", "image/png"), (1, "FFD8FF", "image/jpeg"), (1, "47494638", "image/gif"), (9, "57454250", "image/webp"))


def mime(data: Column) -> Column:
    """What kind of image some bytes are; octet-stream if none that is known."""
    tests = [F.when(F.hex(F.substring(data, at, len(magic) // 2)) == magic, name) for at, magic, name in MAGIC]
    return F.coalesce(*tests, F.lit("application/octet-stream"))


def epoch_time(value: Column) -> Column:
    """A moment from seconds, with or without a fraction, or from milliseconds, if the number is too great for seconds."""
    seconds = F.when(F.abs(value) >= 100_000_000_000, value / 1000.0).otherwise(value)
    return F.timestamp_micros((seconds * 1_000_000).cast("long")).cast("timestamp_ntz")
