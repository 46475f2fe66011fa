"""What a version-controlled tree says: its commit, and its differences."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession


def _git(root: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.decode(errors="replace") if done.returncode == 0 else None


def head(root: str) -> str | None:
    """The commit checked out; None outside a repository or before the first commit."""
    return (_git(root, "rev-parse", "HEAD") or "").strip() or None


def diff_text(root: str, spec: str = "unstaged", ref: str | None = None) -> str:
    """A diff without context: unstaged, staged, or against ``ref``."""
    extra = {"unstaged": [], "staged": ["--cached"], "ref": [ref or "HEAD"]}[spec]
    out = _git(root, "diff", "--unified=0", *extra)
    if out is None:
        raise ValueError(f"no diff can be made in {root}")
    return out


def diff_lines(spark: SparkSession, text: str) -> DataFrame:
    """(ord, line) of a diff."""
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "ord long, line string")
