"""Paths as text: folded, relative to a repository, and the tree of it that they lie in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: where a repository keeps its worktrees
WORKTREES = ".claude/worktrees/"


def normalize(path: Column) -> Column:
    """An absolute path without empty, `.` and `..` parts; `..` at the root stays there."""
    none = F.array().cast("array<string>")
    fold = lambda parts, x: F.when(x.isin("", "."), parts).when(x == "..", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(F.concat(parts, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), none, fold), "/"))


def tree_of(path: Column, root: str) -> Column:
    """`main` or `worktree:<name>` of a path at or below the root; null outside, also in folders whose names only begin alike."""
    rest = F.substring(path, F.lit(len(root) + 2), F.length(path))
    name = F.substring_index(F.substring(rest, F.lit(len(WORKTREES) + 1), F.length(rest)), "/", 1)
    inside = F.when(rest.startswith(WORKTREES), F.when(name != "", F.concat(F.lit("worktree:"), name))).otherwise("main")
    return F.when(path == root, "main").when(path.startswith(root + "/"), inside)


def relative(path: Column, cwd: Column, root: str) -> Column:
    """struct(tree, rel) of a file's path, which is taken from cwd (else the root) if it is not absolute; null outside the repository.

    The tree is that in which the folded path lies, whatever cwd is.
    """
    whole = normalize(F.when(path.startswith("/"), path).otherwise(F.concat(F.coalesce(cwd, F.lit(root)), F.lit("/"), path)))

    def told(p: Column) -> Column:
        tree = tree_of(p, root)
        top = F.when(tree == "main", F.lit(root)).otherwise(F.concat(F.lit(f"{root}/{WORKTREES}"), F.substring_index(tree, ":", -1)))
        rel = F.substring(p, F.length(top) + 2, F.length(p))
        return F.when(tree.isNotNull() & F.startswith(p, F.concat(top, F.lit("/"))), F.struct(tree.alias("tree"), rel.alias("rel")))

    return F.element_at(F.transform(F.array(whole), told), 1)
