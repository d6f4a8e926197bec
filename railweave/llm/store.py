"""Shared-folder tables and connected components, as the rest of the library has them, and names for helper columns."""

from pyspark.sql import DataFrame

from railweave.operators.graph import Scratch, components, drop, keep, shared_dir

__all__ = ["Scratch", "components", "drop", "fresh", "keep", "shared_dir"]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that ``df`` has already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
