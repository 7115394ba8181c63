"""Commits, branches and files of git repositories.  Git runs on the driver; its output becomes DataFrames."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD, FIELD = "\x00", "\x1f"
FORMAT = "%x1f".join(("%H", "%P", "%an", "%at", "%s", "%b"))
COMMITS = "sha string, parents array<string>, author string, time_secs long, subject string, body string"


def run(repo: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, check=True)
    return done.stdout.decode("utf-8", "replace")


def parse_records(raw: DataFrame) -> DataFrame:
    """Commits from rows (value): six fields a record, the body last; a record of another shape is an error."""
    value = F.regexp_replace("value", r"^\n+", "")
    parts = F.split(value, FIELD, 6)
    ok = (F.size(parts) == 6) & parts[0].rlike("^[0-9a-f]{40}([0-9a-f]{24})?$") & parts[3].rlike("^[0-9]+$")
    checked = F.when(ok, parts).otherwise(F.raise_error(F.concat(F.lit("bad commit record: "), F.substring(value, 1, 80))).cast("array<string>"))
    rows = raw.where(value != "").select(checked.alias("p"))
    parents = F.filter(F.split(F.col("p")[1], " "), lambda x: x != "")
    return rows.select(F.col("p")[0].alias("sha"), parents.alias("parents"), F.col("p")[2].alias("author"), F.col("p")[3].cast("long").alias("time_secs"), F.col("p")[4].alias("subject"), F.col("p")[5].alias("body"))


def read_commits(spark: SparkSession, repo: str, include: str = "HEAD", exclude: str | None = None) -> DataFrame:
    """Commits reachable from include and not from exclude."""
    span = f"{exclude}..{include}" if exclude else include
    out = run(repo, "log", "-z", "--reverse", f"--format={FORMAT}", span, "--")
    return parse_records(spark.createDataFrame([(x,) for x in out.split(RECORD)], "value string"))


def read_log_files(spark: SparkSession, path: str) -> DataFrame:
    """Commits from files with the log's output, read by the executors."""
    return parse_records(spark.read.text(path, lineSep=RECORD))


def default_branch(repo: str) -> str:
    try:
        return run(repo, "symbolic-ref", "--short", "refs/remotes/origin/HEAD").strip()
    except subprocess.CalledProcessError:
        return run(repo, "symbolic-ref", "--short", "HEAD").strip()


def branches(spark: SparkSession, repo: str) -> DataFrame:
    """(name, tip) of all branches but the default one, remote ones by their full name."""
    own = default_branch(repo)
    lines = run(repo, "for-each-ref", "--format=%(refname)\x1f%(refname:short)\x1f%(objectname)", "refs/heads", "refs/remotes").splitlines()
    rows = [(full if full.startswith("refs/remotes/") else short, tip) for full, short, tip in (x.split(FIELD) for x in lines) if short != own and not full.endswith("/HEAD")]
    return spark.createDataFrame(rows, "name string, tip string")


def head(repo: str) -> str:
    return run(repo, "rev-parse", "HEAD").strip()


def commit_count(repo: str, rev: str = "HEAD") -> int:
    return int(run(repo, "rev-list", "--count", rev))


def is_ancestor(repo: str, ancestor: str, rev: str) -> bool:
    return subprocess.run(["git", "-C", repo, "merge-base", "--is-ancestor", ancestor, rev], check=False).returncode == 0


def markdown_files(spark: SparkSession, repo: str) -> DataFrame:
    """(path, blob) of tracked markdown files."""
    rows = []
    for line in run(repo, "ls-files", "-s", "-z", "--", "*.md").split(RECORD):
        if line:
            meta, path = line.split("\t", 1)
            rows.append((path, meta.split()[1]))
    return spark.createDataFrame(rows, "path string, blob string")


def read_document(repo: str, rel: str, most: int = 4 << 20) -> bytes | None:
    """A regular file inside the repository, no link on the way, of at most so many bytes; else None."""
    root = Path(repo).resolve()
    path = root / rel
    if any(p.is_symlink() for p in (path, *path.parents) if p != root and root in p.parents):
        return None
    if not path.is_file() or root not in path.resolve().parents or path.stat().st_size > most:
        return None
    return path.read_bytes()


def pin(repo: str, paths: list[str]) -> str:
    """HEAD's id, `-dirty` if what is read differs from it, or `unpinned` outside git."""
    try:
        own = head(repo)
        return own + ("-dirty" if run(repo, "status", "--porcelain", "--", *paths).strip() else "")
    except (subprocess.CalledProcessError, FileNotFoundError):
        return "unpinned"
