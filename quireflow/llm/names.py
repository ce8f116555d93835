"""Helper columns that clash with none of the input's."""

from __future__ import annotations

from collections.abc import Iterable


def free(columns: Iterable[str], *wanted: str) -> list[str]:
    """``wanted`` names, each with as many underscores before it as keep it apart from ``columns``; letter case does not count."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
