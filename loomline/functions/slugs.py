"""Project names out of working directories: one rule for loading, another for inference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.config import DEFAULT, UNKNOWN_SLUG, WORKSPACES, WORKTREE, Settings


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def project_slug(cwd: Column, s: Settings = DEFAULT) -> Column:
    """The first segment below the git root or home (as prefixes), without a worktree suffix; below the workspaces folder the next segment, as it is."""
    rest = reduce(lambda other, p: F.when(cwd.startswith(p + "/"), F.substr(cwd, F.lit(len(p) + 2))).otherwise(other), (s.home, s.git_root), cwd)
    parts = _segments(rest)
    first = F.regexp_replace(F.get(parts, 0), f"(?U){WORKTREE}$", "")
    return (
        F.when(F.coalesce(cwd, F.lit("")) == "", UNKNOWN_SLUG)
        .when(F.size(parts) == 0, UNKNOWN_SLUG)
        .when((F.get(parts, 0) == WORKSPACES) & (F.size(parts) >= 2), F.get(parts, 1))
        .when((first == "") | first.startswith("."), UNKNOWN_SLUG)
        .otherwise(first)
    )


def inference_slug(cwd: Column, s: Settings = DEFAULT) -> Column:
    """The first segment after the git root wherever it stands, else of the whole path; a worktree suffix goes from a workspace too."""
    root = s.git_root + "/"
    at = F.instr(cwd, root)
    parts = _segments(F.when(at > 0, F.substr(cwd, at + len(root))).otherwise(cwd))
    first = F.when((F.get(parts, 0) == WORKSPACES) & (F.size(parts) >= 2), F.get(parts, 1)).otherwise(F.get(parts, 0))
    first = F.regexp_replace(first, f"(?U){WORKTREE}$", "")
    return F.when((F.coalesce(cwd, F.lit("")) == "") | (F.size(parts) == 0) | (first == ""), UNKNOWN_SLUG).otherwise(first)
