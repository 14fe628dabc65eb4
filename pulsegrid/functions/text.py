"""Scalar rules on names, URLs, tools and texts, as column expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Commit trailers of AI tools (kind, pattern, tool); the first that is found anywhere in a body decides.
TRAILERS = (
    ("claude_code", r"generated with \[?claude code\]?", "claude"),
    ("claude_code", r"claude-session:\s*\S+", "claude"),
    ("claude_coauthor", r"co-authored-by:\s*claude", "claude"),
    ("codex", r"co-authored-by:\s*(openai[- ])?codex", "codex"),
    ("codex", r"generated with (openai )?codex", "codex"),
    ("cursor", r"co-authored-by:\s*cursor", "cursor"),
    ("cursor", r"generated with cursor", "cursor"),
    ("copilot", r"co-authored-by:\s*(github[- ])?copilot", "copilot"),
    ("aider", r"co-authored-by:\s*aider", "aider"),
    ("gemini", r"co-authored-by:\s*gemini", "gemini"),
)


def norm_repo(url: Column) -> Column:
    """Trim, drop trailing ``.git`` and then ``/``, lower-case; blank is null."""
    short = F.lower(F.regexp_replace(F.regexp_replace(F.trim(url), r"(?i)(\.git)+$", ""), "/+$", ""))
    return F.when(short != "", short)


def first_token(text: Column) -> Column:
    found = F.regexp_extract(text, r"^\s*(\S+)", 1)
    return F.when(found != "", found)


def slash_kind(text: Column) -> Column:
    """command, skill or noise for a text that begins with a plausible slash word; else null."""
    token = first_token(text)
    plausible = token.rlike(r"^/\p{L}[\p{L}\p{N}_:.-]*$")
    return F.when(plausible & F.lower(token).isin("/usage", "/exit"), "noise").when(plausible & F.lower(token).contains("skill"), "skill").when(plausible, "command")


#: The names under which tools are known, by what other products call them (in lower case).
TOOL_NAMES = {
    "Read": ("read", "read_file", "read_file_v2", "view", "view_file"),
    "Write": ("write", "write_file", "write_to_file", "write_file_v2", "write_to_file_v2"),
    "Edit": ("edit", "edit_file", "edit_file_v2", "apply_patch", "applypatch", "notebookedit", "notebook_edit"),
    "Bash": ("bash", "shell", "run_terminal_command", "run_terminal_command_v2", "exec"),
    "Glob": ("glob", "glob_file_search", "list_dir", "list_dir_v2", "find"),
    "Grep": ("grep", "grep_search", "codebase_search", "ripgrep", "ripgrep_raw_search", "search"),
    "WebSearch": ("websearch", "web_search"),
    "WebFetch": ("webfetch", "web_fetch", "fetch"),
    "Agent": ("agent", "subagent", "task", "spawn_subagent"),
}
#: Tools that carry out what a skill says, by name and by what their names hold.
EXECUTING = ("bash", "shell", "edit", "write", "apply_patch", "strreplace", "delete", "agent", "task", "subagent", "notebookedit", "mcp")
EXECUTING_PARTS = ("edit", "write", "terminal", "bash", "shell", "agent", "patch", "delete")


def normal_tool(name: Column) -> Column:
    """A tool's name as the states know it; others begin with a capital."""
    known = F.create_map(*[F.lit(x) for to, names in TOOL_NAMES.items() for n in names for x in (n, to)])
    other = F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))
    return F.coalesce(F.get(F.array(known), F.lit(0))[F.lower(name)], other)


def executes(tool: Column) -> Column:
    """Whether a tool carries out a skill that was read; reading tools never do."""
    name = F.lower(F.trim(tool))
    held = name.rlike("|".join(EXECUTING_PARTS)) | name.isin(*EXECUTING)
    return F.coalesce(held & ~name.isin(*TOOL_NAMES["Read"]), F.lit(False))


def skill_envelope(text: Column) -> Column:
    """The skill that a message wraps (``<skill><name>..</name>`` at its very begin); null if none, or if the name holds blanks."""
    name = F.lower(F.trim(F.regexp_extract(F.trim(text), r"\A<skill>\s*<name>([^<>]{1,120})</name>", 1)))
    return F.when((name != "") & ~name.rlike(r"\s"), name)


def invocation(text: Column, target_type: Column) -> Column:
    """token and kind of what a user's message calls, by the tool it was written in: an envelope, nothing, or the first word.

    One tool wraps skills in envelopes, one reports its commands elsewhere, all others begin a message with a slash word.
    """
    kind = F.lower(F.trim(F.coalesce(target_type, F.lit(""))))
    wrapped = F.when(skill_envelope(text).isNotNull(), F.struct(skill_envelope(text).alias("token"), F.lit("skill").alias("kind")))
    typed = F.when(slash_kind(text).isNotNull(), F.struct(F.lower(first_token(text)).alias("token"), slash_kind(text).alias("kind")))
    return F.when(kind == "codex", wrapped).when(kind == "claude", F.lit(None)).otherwise(typed)


LONGEST = (1 << 63) - 1


def saturating_add(a: Column, b: Column) -> Column:
    """The sum of two longs, or the end of their range where it would pass it."""
    return F.coalesce(F.try_add(a, b), F.when(a.isNotNull() & b.isNotNull(), F.when(a < 0, F.lit(-LONGEST - 1)).otherwise(F.lit(LONGEST))))


def mcp_server(tool: Column) -> Column:
    """The server of ``mcp__server__tool``; null if any part is blank or holds blanks."""
    return _part(tool, 1)


def mcp_tool(tool: Column) -> Column:
    return _part(tool, 2)


def _part(tool: Column, n: int) -> Column:
    found = F.regexp_extract(F.lower(F.trim(tool)), r"^mcp__(?!__)(\S+?)__(\S+)$", n)
    return F.when(found != "", found)


def skill_item(token: Column) -> Column:
    """The skill's name without a leading slash or dollar and ``skills/``; blank is null."""
    short = F.lower(F.regexp_replace(F.regexp_replace(F.trim(token), r"^[/$]+", ""), r"^skills/", ""))
    return F.when(short != "", short)


def namespace(item: Column) -> Column:
    """``ns`` of ``ns:skill``, if both are there."""
    found = F.regexp_extract(item, r"^([^\s:]+):[^\s:]+$", 1)
    return F.when(found != "", found)


def trailer_rules(configured: str | None = None) -> tuple[tuple[str, str, str | None], ...]:
    """The fixed rules, and after them those of a JSON array of {kind, pattern, target_type}; what is no rule is left out."""
    try:
        found = json.loads(configured or "[]")
    except ValueError:
        found = []
    more = []
    for rule in found if isinstance(found, list) else []:
        kind, pattern, tool = (str(rule.get(k) or "").strip() for k in ("kind", "pattern", "target_type")) if isinstance(rule, dict) else ("", "", "")
        try:
            re.compile(pattern)
        except re.error:
            continue
        if kind and pattern:
            more.append((kind, pattern, tool or None))
    return (*TRAILERS, *more)


def trailer(body: Column, what: str = "kind", rules: Sequence[tuple[str, str, str | None]] = TRAILERS) -> Column:
    """The kind or tool of the first trailer rule that is found in a commit body, in any case; null if none."""
    at, known = (0 if what == "kind" else 2), F.coalesce(body, F.lit(""))
    out = None
    for rule in rules:
        test = known.rlike(f"(?i){rule[1]}")
        out = F.when(test, F.lit(rule[at])) if out is None else out.when(test, F.lit(rule[at]))
    return out


def is_revert(subject: Column) -> Column:
    return F.coalesce(subject, F.lit("")).rlike(r'(?i)^\s*revert(\s|:|")')


def synthetic_id(session: Column, discriminator: Column, role: Column, text: Column) -> Column:
    """session:discriminator:role:hash8 for sources without message ids."""
    return F.concat_ws(":", session, discriminator, role, F.substring(F.sha1(text), 1, 8))


def short_model(name: Column) -> Column:
    """A model's name without vendor prefix, date and common suffixes."""
    out = F.regexp_replace(F.lower(F.trim(name)), r"^.*/", "")
    return F.regexp_replace(F.regexp_replace(out, r"[-@]\d{8}$", ""), r"-(latest|preview|exp)$", "")


def java_round(x: Column, digits: int = 0) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: halves go up, also below zero."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
