"""Commits from git repositories as Spark data sources (SRC-14..16).

``spark.dataSource.register(GitLog)``; ``spark.read.format("gitlog").option("root", folder).load()``.
``GitDetail`` ("gitlog_detail") adds the changed files of each commit with their patches. Either can be read as a
stream: its offset is the head of every repository, so each commit comes once; a history that was rewritten
is read again from the last days.
Every repository found below the root is a partition; the reader's tasks run git, and the driver asks for heads.
"""

from __future__ import annotations

import base64
import gzip
import io
import os
import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from tempfile import TemporaryFile
from typing import NamedTuple
from uuid import uuid4

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FIELD, RECORD = "\x1f", "\x1e"
FORMAT = FIELD.join(["%H", "%cI", "%an", "%ae", "%P", "%D", "%s", "%b"]) + RECORD
SKIPPED = frozenset(["node_modules", "vendor"])


FileRow = tuple[str, str | None, int, int]


def file_row(added: str, deleted: str, path: str) -> FileRow:
    """(path, old path, added, deleted) of a numstat line; a rename is ``a => b`` or ``x/{a => b}/y``; binary files count no lines."""
    old = None
    if " => " in path:
        head, _, rest = path.partition("{")
        inner, brace, tail = rest.partition("}")
        was, _, now = (inner if brace else path).partition(" => ")
        old, path = ((head + was + tail).replace("//", "/"), (head + now + tail).replace("//", "/")) if brace else (was, now)
    return path, old, int(added) if added.isdigit() else 0, int(deleted) if deleted.isdigit() else 0


def parse_log(blob: str) -> Iterator[tuple]:
    """(hash, time, name, email, parents, branch, subject, body, files, added, deleted, rows) of ``git log --numstat`` with FORMAT."""
    head, files = None, []

    def commit() -> tuple:
        commit_hash, at, name, email, parents, refs, subject, body = head
        time = datetime.fromisoformat(at).astimezone(timezone.utc).replace(tzinfo=None)
        named = [r.removeprefix("HEAD -> ") for r in refs.split(", ") if r and not r.startswith("tag: ") and r != "HEAD"]
        return (commit_hash, time, name, email, parents.split(), named[0] if named else None, subject, body.strip(), len(files), sum(f[2] for f in files), sum(f[3] for f in files), files)

    for block in blob.split(RECORD):
        start = block.rfind("\n", 0, block.find(FIELD)) + 1 if FIELD in block else len(block)
        for line in block[:start].splitlines():
            parts = line.split("\t")
            if len(parts) == 3:
                files.append(file_row(*parts))
        if FIELD in block:
            if head:
                yield commit()
            head, files = block[start:].split(FIELD, 7), []
    if head:
        yield commit()


def repositories(root: str, depth: int = 6) -> list[str]:
    """Folders with a repository, at most ``depth`` below the root; hidden and dependency folders are skipped."""
    found = []
    base = root.rstrip("/").count("/")
    for folder, names, _ in os.walk(root):
        if ".git" in names:
            found.append(folder)
            names.clear()
            continue
        deep = folder.rstrip("/").count("/") - base >= depth
        names[:] = [] if deep else sorted(n for n in names if not n.startswith(".") and n not in SKIPPED)
    return sorted(found)


class Patch(NamedTuple):
    """One file of a unified diff."""

    path: str
    binary: bool
    text: str


ESCAPED = re.compile(rb"\\([0-7]{3}|.)")
LETTERS = {b"t": b"\t", b"n": b"\n", b"r": b"\r", b"a": b"\a", b"b": b"\b", b"f": b"\f", b"v": b"\v"}


def unquoted(path: str) -> str:
    """A path as git shows it, without the quotes and escapes that it puts around odd characters."""
    if not (path.startswith('"') and path.endswith('"') and len(path) > 1):
        return path
    plain = lambda m: bytes([int(m[1], 8)]) if len(m[1]) == 3 else LETTERS.get(m[1], m[1])
    return ESCAPED.sub(plain, path[1:-1].encode()).decode(errors="replace")


def patched_path(block: str) -> str:
    """The path a file of a diff has afterwards, or had if it is gone."""
    header = block.split("\n@@", 1)[0].split("\n")
    marks = {}
    for line in header[1:]:
        for mark in ("rename to ", "copy to ", "+++ ", "--- "):
            if line.startswith(mark):
                marks.setdefault(mark, unquoted(line[len(mark) :].rstrip("\t")))
    for mark in ("rename to ", "copy to "):
        if mark in marks:
            return marks[mark]
    for mark in ("+++ ", "--- "):
        if marks.get(mark, "/dev/null") != "/dev/null":
            return marks[mark][2:]
    both = header[0].removeprefix("diff --git ")  # neither: a new empty file, a changed mode, a binary file
    if both.endswith('"'):
        return unquoted(both[both.rindex(' "') + 1 :])[2:]
    return both[len(both) // 2 + 1 :][2:]


def split_patch(diff: str) -> list[Patch]:
    """The files of a unified diff, in order."""
    found = []
    for block in re.split(r"(?m)^(?=diff --git )", diff):
        if block.startswith("diff --git "):
            head = block.split("\n@@", 1)[0]
            binary = re.search(r"(?m)^(Binary files .* differ|GIT binary patch)$", head) is not None
            found.append(Patch(patched_path(block), binary, block.rstrip("\n")))
    return found


@dataclass(frozen=True)
class Limits:
    """How much of a commit's patches is kept."""

    files: int = 1_000
    file_bytes: int = 1 << 20
    commit_bytes: int = 10 << 20
    patches: bool = True


def allotted(sizes: list[int], limits: Limits) -> list[tuple[int, str | None]]:
    """Bytes kept of each patch and why not all: first each file is cut, then what the commit has left is dealt out in order."""
    left, out = limits.commit_bytes, []
    for size in sizes:
        kept, why = min(size, limits.file_bytes), "file_too_large" if size > limits.file_bytes else None
        if kept > left:
            kept, why = left, "commit_budget"
        left -= kept
        out.append((kept, why))
    return out


FILE = "path: string, old_path: string, change_type: string, lines_added: int, lines_deleted: int, is_binary: boolean, has_patch: boolean, patch_gzip_b64: string, patch_bytes: int, patch_truncated: boolean, truncate_reason: string, sort_order: int"
#: Folders whose files are listed without a patch.
WITHOUT_PATCH = ("/node_modules/", "/vendor/", "/.git/")


def detailed(changes: list[tuple], lines: dict[str, tuple[int, int]], patches: dict[str, Patch], limits: Limits) -> tuple[list[tuple], str, str | None]:
    """Rows of ``FILE`` of a commit's changes (kind, path, old path), how complete they are, and why not."""
    kept = changes[: limits.files]
    texts, binary = [], []
    for _, path, _ in kept:
        patch = patches.get(path) if limits.patches and not any(part in path for part in WITHOUT_PATCH) else None
        binary.append(bool(patch and patch.binary))
        texts.append(b"" if patch is None or patch.binary else patch.text.encode())
    shares = allotted([len(t) for t in texts], limits)
    rows, whole = [], True
    for i, ((kind, path, old), raw, (size, why)) in enumerate(zip(kept, texts, shares)):
        whole &= size == len(raw) and bool(raw or binary[i] or kind == "D" or any(part in path for part in WITHOUT_PATCH))
        packed = base64.b64encode(gzip.compress(raw[:size], mtime=0)).decode() if size else None
        rows.append((path, old, kind, *lines.get(path, (0, 0)), binary[i], size > 0, packed, size, size < len(raw), why if size < len(raw) else None, i))
    if len(changes) > limits.files:
        return rows, "partial", "too_many_files"
    if not rows:
        return rows, "none", None
    if not limits.patches:
        return rows, "skipped", "collect_patch_disabled"
    return rows, "full" if whole and any(r[6] for r in rows) else "partial", None


def parse_detail(lines: Iterator[str], mark: str, limits: Limits) -> Iterator[tuple]:
    """Commits of ``git log --raw --numstat --patch`` whose headers stand between two ``mark``; one commit is held at a time."""

    def commit(text: str) -> tuple:
        head, _, rest = text.partition(mark)
        commit_hash, at, name, email, parents, refs, subject, body = head.split(FIELD, 7)
        time = datetime.fromisoformat(at).astimezone(timezone.utc).replace(tzinfo=None)
        named = [r.removeprefix("HEAD -> ") for r in refs.split(", ") if r and not r.startswith("tag: ") and r != "HEAD"]
        listed, found, diff = rest.partition("\ndiff --git ")
        changes, counts = [], []  # git lists files in one order in both
        for line in listed.split("\n"):
            cells = line.split("\t")
            if line.startswith(":") and len(cells) > 1:
                paths = [unquoted(p) for p in cells[1:]]
                changes.append((cells[0].rsplit(" ", 1)[1][0], paths[-1], paths[0] if len(paths) > 1 else None))
            elif len(cells) == 3:
                counts.append(tuple(int(c) if c.isdigit() else 0 for c in cells[:2]))
        patches = {p.path: p for p in split_patch("diff --git " + diff if found else "")}
        files, status, reason = detailed(changes, {c[1]: n for c, n in zip(changes, counts)}, patches, limits)
        return (commit_hash, time, name, email, parents.split(), named[0] if named else None, subject, body.strip(), len(changes), sum(c[0] for c in counts), sum(c[1] for c in counts), files, status, reason)

    own: list[str] = []
    for line in lines:
        if line.startswith(mark) and line != mark + "\n":
            if own:
                yield commit("".join(own))
            own = [line.removeprefix(mark)]
        elif own:
            own.append(line)
    if own:
        yield commit("".join(own))


class Repository(InputPartition):
    """Commits of a folder after ``since`` (none: of the last days) up to ``until``."""

    def __init__(self, folder: str, since: str | None = None, until: str = "HEAD"):
        self.folder, self.since, self.until = folder, since, until


class Git:
    """What reading at once and as a stream share."""

    def __init__(self, options: dict[str, str], detail: bool):
        self.root, self.limit, self.detail = options["root"], int(options.get("limit", "200")), detail
        self.since, self.days = options.get("since"), int(options.get("days", "30"))
        self.blocked = [b for b in options.get("blacklist", "").split(",") if b]
        known = {k: int(options[k]) for k in ("files", "file_bytes", "commit_bytes") if k in options}
        self.limits, self.context = Limits(**known, patches=options.get("patches", "true") == "true"), int(options.get("context", "3"))

    def folders(self) -> list[str]:
        return [f for f in repositories(self.root) if not any(b in f for b in self.blocked)]

    def git(self, folder: str, *words: str) -> subprocess.CompletedProcess:
        return subprocess.run(["git", "-C", folder, *words], capture_output=True, text=True, errors="replace")

    def heads(self) -> dict[str, str]:
        """The newest commit of every repository that has any."""
        found = {f: self.git(f, "rev-parse", "--verify", "-q", "HEAD").stdout.strip() for f in self.folders()}
        return {f: head for f, head in found.items() if head}

    def rows(self, part: Repository) -> Iterator[tuple]:
        known = part.since is not None and self.git(part.folder, "merge-base", "--is-ancestor", part.since, part.until).returncode == 0
        span = [f"{part.since}..{part.until}"] if known else [f"--since={self.days} days ago", "-n", str(self.limit), part.until]
        words = ["-c", "core.quotepath=false", "log", "--no-merges", "--numstat", *span]
        if self.detail:
            mark = f"{RECORD}{uuid4().hex}"
            form = mark + FORMAT.removesuffix(RECORD) + mark
            command = ["git", "-C", part.folder, *words[:3], "--raw", "-M", "--patch", f"-U{self.context}", f"--format={form}", *words[3:]]
            with TemporaryFile() as said:
                run = subprocess.Popen(command, stdout=subprocess.PIPE, stderr=said)
                lines = io.TextIOWrapper(run.stdout, encoding="utf-8", errors="replace", newline="\n")
                yield from ((part.folder, *c) for c in parse_detail(lines, mark, self.limits))
                code = run.wait()
                said.seek(0)
                error = said.read().decode(errors="replace")
        else:
            run = self.git(part.folder, *words, f"--format={FORMAT}")
            yield from ((part.folder, *c) for c in parse_log(run.stdout))
            error, code = run.stderr, run.returncode
        if code and "does not have any commits yet" not in error and "unknown revision" not in error:
            raise RuntimeError(f"git log in {part.folder}: {error.strip()}")


class GitReader(Git, DataSourceReader):
    def partitions(self) -> list[Repository]:
        return [Repository(f, self.since) for f in self.folders()]

    def read(self, partition: Repository) -> Iterator[tuple]:
        return self.rows(partition)


class GitStream(Git, DataSourceStreamReader):
    """Offsets are heads by folder. What was read up to one head is not read again unless the history was rewritten."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.heads()

    def partitions(self, start: dict, end: dict) -> list[Repository]:
        return [Repository(f, start.get(f), head) for f, head in sorted(end.items()) if start.get(f) != head]

    def read(self, partition: Repository) -> Iterator[tuple]:
        return self.rows(partition)


COMMIT = "repo string, commit_hash string, commit_time timestamp_ntz, author_name string, author_email string, parents array<string>, branch string, subject string, body string, files_changed int, lines_added int, lines_deleted int"


class GitLog(DataSource):
    """Options: root, limit (commits of a repository that is read for the first time), since (a hash) or days, blacklist (parts of paths to leave out, comma-separated)."""

    detail = False

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return f"{COMMIT}, files array<struct<path:string,old_path:string,lines_added:int,lines_deleted:int>>"

    def reader(self, schema) -> GitReader:
        return GitReader(dict(self.options), self.detail)

    def streamReader(self, schema) -> GitStream:
        return GitStream(dict(self.options), self.detail)


class GitDetail(GitLog):
    """Also: files (most of a commit), file_bytes and commit_bytes (most of their patches), context (lines), patches (true or false)."""

    detail = True

    @classmethod
    def name(cls) -> str:
        return "gitlog_detail"

    def schema(self) -> str:
        return f"{COMMIT}, files array<struct<{FILE}>>, detail_status string, detail_skip_reason string"
