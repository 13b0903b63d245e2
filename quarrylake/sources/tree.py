"""A data source of file trees, and what git knows of them.

Spark's own binary source drops files whose names start with a dot or an
underscore; this one returns every file, or the reason why it is skipped.
"""

from __future__ import annotations

import os
import stat
import subprocess
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarrylake.functions.paths import PRUNED_DIRS

MAX_BYTES = 2_000_000
BINARY_HEAD = 8192
FILES_PER_TASK = 500
SCHEMA = "path string, content binary, skipped string"


def git(root: str, *args: str, timeout: int = 60) -> str | None:
    """The output of a git command in a folder, or None if it fails."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=timeout, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout.decode("utf-8", "replace")


def listing(root: str) -> list[tuple[str, bool]]:
    """(path, pruned) of the files of a tree in order: those that git tracks, or all outside of pruned directories."""
    tracked = git(root, "ls-files", "-z") if (Path(root) / ".git").exists() else None
    if tracked is not None:
        names = sorted(n for n in tracked.split("\0") if n)
        return [(n, bool(set(n.split("/")[:-1]) & set(PRUNED_DIRS))) for n in names]
    out = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in PRUNED_DIRS and not d.startswith(".git"))
        rel = os.path.relpath(folder, root)
        out += [(n if rel == "." else f"{rel}/{n}".replace(os.sep, "/"), False) for n in names]
    return sorted(out)


def read_file(root: str, name: str, max_bytes: int, binary: bool) -> tuple[str, bytes | None, str | None]:
    """A file's bytes, or the reason for which they are left out."""
    full = os.path.join(root, name)
    try:
        told = os.lstat(full)
    except (OSError, ValueError):
        told = None
    if told is None or not stat.S_ISREG(told.st_mode):
        return name, None, "not-a-regular-file"
    try:
        if told.st_size > max_bytes:
            return name, None, f"too-large ({told.st_size} bytes)"
        with open(full, "rb") as f:
            data = f.read()
    except OSError as error:
        return name, None, f"read-error: {error}"
    if not binary and b"\0" in data[:BINARY_HEAD]:
        return name, None, "binary"
    return name, data, None


class _Slice(InputPartition):
    def __init__(self, names: list[tuple[str, bool]]) -> None:
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.max_bytes = int(options.get("maxbytes", MAX_BYTES))
        self.binary = options.get("binary", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        found = listing(self.root)
        return [_Slice(found[k : k + FILES_PER_TASK]) for k in range(0, len(found), FILES_PER_TASK)] or [_Slice([])]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for name, pruned in partition.names:
            yield (name, None, "vendored/generated dir") if pruned else read_file(self.root, name, self.max_bytes, self.binary)


class TreeSource(DataSource):
    """``spark.read.format("quarrylake_tree").load(root)``; options maxbytes and binary."""

    @classmethod
    def name(cls) -> str:
        return "quarrylake_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_tree(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, binary: bool = False) -> DataFrame:
    """(path, content, skipped) of every file of a tree that all executors see."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("quarrylake_tree").option("maxbytes", max_bytes).option("binary", str(binary).lower()).load(root)


def looks_like_git_url(source: str) -> bool:
    """True for what git can clone."""
    return source.startswith(("http://", "https://", "git://", "ssh://", "git@"))


def clone(url: str, into: str) -> None:
    """A shallow clone of one branch."""
    subprocess.run(["git", "clone", "--depth", "50", "--single-branch", url, into], check=True, capture_output=True, timeout=600)


def head_sha(root: str) -> str | None:
    """The commit that is checked out."""
    told = git(root, "rev-parse", "HEAD")
    return told.strip() if told else None


def recent_subjects(root: str, most: int = 40) -> list[str]:
    """Subjects of the latest commits that are no merges."""
    told = git(root, "log", f"-n{most}", "--no-merges", "--pretty=%s") or ""
    return [x for x in told.split("\n") if x.strip()]


def history(spark: SparkSession, root: str, path: str | None = None, most: int = 25) -> DataFrame:
    """(sha, date, author, subject) of commits, of a path if one is given."""
    args = ["log", f"-n{most}", "--date=short", "--pretty=%h%x1f%ad%x1f%an%x1f%s", *(["--follow", "--", path] if path else ["--no-merges"])]
    rows = [tuple(x.split("\x1f", 3)) for x in (git(root, *args) or "").split("\n") if x.count("\x1f") >= 3]
    return spark.createDataFrame(rows, "sha string, date string, author string, subject string")
