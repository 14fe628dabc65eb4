"""Commit details and commit streams over repositories that the tests build."""

import base64
import gzip
import subprocess

import pytest

from pulsegrid.sources import gitlog


class Repo:
    def __init__(self, folder):
        self.folder = folder
        folder.mkdir(parents=True)
        self.git("init", "-q")

    def git(self, *args):
        names = ["-c", "user.name=a", "-c", "user.email=a@x.y", "-c", "core.autocrlf=false"]
        return subprocess.run(["git", "-C", str(self.folder), *names, *args], check=True, capture_output=True, text=True).stdout.strip()

    def commit(self, subject, **files):
        for name, content in files.items():
            path = self.folder / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(content) if isinstance(content, bytes) else path.write_text(content)
        self.git("add", "-A")
        self.git("commit", "-q", "--allow-empty", "-m", subject)
        return self.git("rev-parse", "HEAD")


def unpacked(file):
    return gzip.decompress(base64.b64decode(file["patch_gzip_b64"])).decode() if file["patch_gzip_b64"] else None


def details(spark, root, **options):
    spark.dataSource.register(gitlog.GitDetail)
    reader = spark.read.format("gitlog_detail").option("root", str(root))
    for name, value in options.items():
        reader = reader.option(name, value)
    return {r["subject"]: r for r in reader.load().collect()}


def test_files_of_commits(spark, tmp_path):
    repo = Repo(tmp_path / "p")
    repo.commit("first\n\nwith a body\nof lines", **{"a.txt": "1\n2\n3\n", "dir/old name.txt": "x\n" * 20, "gone.txt": "g\n", "bin.dat": b"\x00\x01", "odd\tname\"é.txt": "q\n", "lib/vendor/v.txt": "v\n", "empty.txt": ""})
    (repo.folder / "gone.txt").unlink()
    repo.git("mv", "dir/old name.txt", "dir/new name.txt")
    repo.git("mv", "odd\tname\"é.txt", "odd\tother\"é.txt")
    (repo.folder / "empty.txt").chmod(0o755)
    repo.commit("second diff --git a/x b/y", **{"a.txt": "1\n2 changed\n3\n", "bin.dat": b"\x00\x02"})
    rows = details(spark, tmp_path)
    assert (rows["first"]["body"], rows["first"]["files_changed"], rows["first"]["detail_status"]) == ("with a body\nof lines", 7, "full")
    second = rows["second diff --git a/x b/y"]
    files = {f["path"]: f for f in second["files"]}
    assert {p: (f["change_type"], f["old_path"]) for p, f in files.items()} == {
        "a.txt": ("M", None), "bin.dat": ("M", None), "gone.txt": ("D", None), "empty.txt": ("M", None),
        "dir/new name.txt": ("R", "dir/old name.txt"), "odd\tother\"é.txt": ("R", "odd\tname\"é.txt"),
    }
    assert (files["a.txt"]["lines_added"], files["a.txt"]["lines_deleted"], files["bin.dat"]["is_binary"], files["bin.dat"]["has_patch"]) == (1, 1, True, False)
    assert "-2\n+2 changed" in unpacked(files["a.txt"]) and unpacked(files["a.txt"]).startswith("diff --git a/a.txt")
    assert "rename to dir/new name.txt" in unpacked(files["dir/new name.txt"]) and "new mode 100755" in unpacked(files["empty.txt"]) and "-g" in unpacked(files["gone.txt"])
    assert second["detail_status"] == "full" and [f["sort_order"] for f in second["files"]] == list(range(6))
    vendored = {f["path"]: f for f in rows["first"]["files"]}["lib/vendor/v.txt"]
    assert (vendored["has_patch"], vendored["lines_added"]) == (False, 1)


def test_limits(spark, tmp_path):
    Repo(tmp_path / "p").commit("big", **{f"f{i}.txt": f"{i}" * 400 + "\n" for i in range(5)})
    whole = [len(unpacked(f)) for f in details(spark, tmp_path)["big"]["files"]]
    got = details(spark, tmp_path, file_bytes=300, commit_bytes=700, files=4)["big"]
    assert (got["detail_status"], got["detail_skip_reason"], len(got["files"]), got["files_changed"]) == ("partial", "too_many_files", 4, 5)
    assert [(f["patch_bytes"], f["patch_truncated"], f["truncate_reason"]) for f in got["files"]] == [(300, True, "file_too_large"), (300, True, "file_too_large"), (100, True, "commit_budget"), (0, True, "commit_budget")]
    assert min(whole) > 300 and len(unpacked(got["files"][0])) == 300
    off = details(spark, tmp_path, patches="false")["big"]
    assert (off["detail_status"], off["detail_skip_reason"]) == ("skipped", "collect_patch_disabled") and not any(f["has_patch"] for f in off["files"])


@pytest.mark.parametrize("path", ["plain", "two words", "tab\there", 'quote"', "ü", "back\\slash", "new\nline"])
def test_quoted_paths(path, tmp_path):
    repo = Repo(tmp_path / "p")
    repo.commit("c", **{path: "x\n"})
    shown = repo.git("-c", "core.quotepath=true", "diff-tree", "--root", "--no-commit-id", "--name-only", "-r", "HEAD")
    assert gitlog.unquoted(shown) == path
    assert [p.path for p in gitlog.split_patch(repo.git("show", "--format=", "HEAD"))] == [path]


def test_shares():
    limits = gitlog.Limits(file_bytes=10, commit_bytes=25)
    assert gitlog.allotted([4, 30, 10, 8, 0], limits) == [(4, None), (10, "file_too_large"), (10, None), (1, "commit_budget"), (0, None)]


def test_a_stream_brings_each_commit_once(spark, tmp_path):
    one, two = Repo(tmp_path / "repos" / "one"), Repo(tmp_path / "repos" / "two")
    one.commit("a1")
    spark.dataSource.register(gitlog.GitLog)

    def run():
        before = spark.read.parquet(out).count() if (tmp_path / "out").exists() else 0
        stream = spark.readStream.format("gitlog").option("root", str(tmp_path / "repos")).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        rows = [r["subject"] for r in spark.read.parquet(out).collect()]
        return len(rows) - before, sorted(rows)

    out = str(tmp_path / "out")
    assert run() == (1, ["a1"])
    one.commit("a2", f="1")
    one.commit("a3", f="2")
    two.commit("b1")
    assert run() == (3, ["a1", "a2", "a3", "b1"])
    assert run() == (0, ["a1", "a2", "a3", "b1"])
    one.git("commit", "-q", "--amend", "-m", "a3 again")
    assert run() == (3, ["a1", "a1", "a2", "a2", "a3", "a3 again", "b1"])  # a history that was rewritten is read anew
    one.commit("a4")
    assert run()[0] == 1
