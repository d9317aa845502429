"""Changed paths, as a version-control system reports them."""

from __future__ import annotations

from pyspark.sql import DataFrame


def changed_paths(staged: DataFrame, unstaged: DataFrame | None = None) -> DataFrame:
    """``path``, each once: what differs between the last commit and the index, and between the index and the tree."""
    both = staged.select("path") if unstaged is None else staged.select("path").unionByName(unstaged.select("path"))
    return both.where("path IS NOT NULL").distinct()
