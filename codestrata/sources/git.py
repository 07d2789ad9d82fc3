"""Version control as data sources: the files of a working tree and the lines of its log.

``spark.dataSource.register(GitFiles)`` and ``GitLog`` make ``spark.read.format("git_files").load(root)`` and ``format("git_log")`` available. The listing and the log
come from one local process each; everything after that is ordinary Spark.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codestrata.operators.files import SKIP_DIRS

LOG_FORMAT = "COMMIT %H %ad %an"
BASE_BRANCHES = ("main", "master", "trunk", "develop")


def run_git(root: str, *args: str) -> str | None:
    """The output of a git command, or None if it fails."""
    got = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace")
    return got.stdout if got.returncode == 0 else None


class _Reader(DataSourceReader):
    def __init__(self, options: dict, lines):
        self.options, self.lines = options, lines

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        yield from self.lines(self.options)


def _files(options: dict) -> Iterator[tuple]:
    out = run_git(options["path"], "ls-files", "--cached", "--others", "--exclude-standard", "-z")
    for path in sorted(set((out or "").split("\0"))):
        if path and not set(path.split("/")[:-1]) & set(SKIP_DIRS):
            yield (path,)


def _log(options: dict) -> Iterator[tuple]:
    out = run_git(options["path"], "log", f"--since={options.get('days', '180')} days ago", f"--pretty={LOG_FORMAT}", "--date=short", "--numstat")
    for n, line in enumerate((out or "").split("\n")):
        yield (n, line)


class GitFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_files"

    def schema(self) -> str:
        return "path string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), _files)


class GitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "n long, line string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), _log)


def parse_log(text: str) -> list[tuple[str, str, str, str | None, int, int]]:
    """(sha, date, author, path, add, del) of a log in LOG_FORMAT with numstat lines; a commit without files has one row without path. '-' counts 0; other lines are passed over."""
    out: list[tuple] = []
    head: tuple[str, str, str] | None = None
    empty = False
    for line in text.splitlines():
        if line.startswith("COMMIT "):
            if head and empty:
                out.append((*head, None, 0, 0))
            parts = line.split(" ", 3)
            head, empty = ((parts[1], parts[2], parts[3] if len(parts) > 3 else ""), True) if len(parts) >= 3 else (None, False)
        elif head and len(f := line.split("\t")) == 3:
            number = lambda x: int(x) if x.isdigit() else 0
            out.append((*head, f[2], number(f[0]), number(f[1])))
            empty = False
    if head and empty:
        out.append((*head, None, 0, 0))
    return out


def log_rows(logs: DataFrame) -> DataFrame:
    """Commits and files of exported logs(project, text), one text a log."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *r) for p, t in zip(b["project"], b["text"]) for r in parse_log(t or "")], columns=["project", "sha", "date", "author", "path", "add", "del"])

    return logs.select("project", "text").mapInPandas(run, "project string, sha string, date string, author string, path string, add long, del long").withColumn("date", F.col("date").cast("date"))


def base_branch(names: list[str]) -> str:
    return next((b for b in BASE_BRANCHES if b in names), "main")


def branches(root: str, top: int = 30) -> list[dict]:
    """The latest ``top`` branches of a repository with their distance from the base branch (a top-k report)."""
    out = run_git(root, "for-each-ref", "--sort=-committerdate", "--format=%(refname:short)%09%(objectname)%09%(authorname)%09%(committerdate:short)", "refs/heads") or ""
    rows = [dict(zip(("name", "sha", "author", "date"), line.split("\t"))) for line in out.splitlines()]
    base = base_branch([r["name"] for r in rows])
    for r in rows[:top]:
        counts = (run_git(root, "rev-list", "--left-right", "--count", f"{base}...{r['name']}") or "0\t0").split()
        stat = run_git(root, "diff", "--shortstat", f"{base}...{r['name']}") or ""
        r |= {"base": base, "behind": int(counts[0]), "ahead": int(counts[1]), "files_changed": int((re.search(r"(\d+) files? changed", stat) or [0, 0])[1])}
    return rows[:top]


def clone(source: str, to: str) -> str | None:
    """A shallow clone of a repository, local or not; the folder, or None if it fails. Names that git would take for options are refused."""
    if source.startswith("-"):
        raise ValueError(source)
    got = subprocess.run(["git", "clone", "-q", "--depth", "1", "--", f"file://{source}" if source.startswith("/") else source, to], capture_output=True)
    return to if got.returncode == 0 else None


def branch_changes(root: str, base: str, branch: str) -> list[tuple[str, int, int]]:
    """(path, additions, deletions) of each file a branch touched since it left the base; '-' counts 0."""
    out = run_git(root, "diff", "--numstat", f"{base}...{branch}") or ""
    number = lambda x: int(x) if x.isdigit() else 0
    return [(f[2], number(f[0]), number(f[1])) for line in out.splitlines() if len(f := line.split("\t")) == 3]


def ignored(root: str, paths: list[str]) -> set[str]:
    """Those of ``paths`` that the repository's ignore rules exclude; none outside a repository."""
    got = subprocess.run(["git", "-C", root, "check-ignore", "-z", "--stdin"], input="\0".join(paths), capture_output=True, text=True)
    return set(got.stdout.split("\0")) - {""} if got.returncode in (0, 1) else set()
