"""Changes of tables' columns: of one table's header in plain Python, of many tables' headers as an expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def header_changes(left: Column, right: Column) -> Column:
    """Array of (name, kind), as column_changes gives, of two columns of distinct names (array<string>)."""
    a, b = lambda x: F.array_position(left, x), lambda x: F.array_position(right, x)
    kind = lambda x: F.when(b(x) == 0, "removed").when(a(x) == 0, "added").when(a(x) == b(x), "same").otherwise("moved")
    return F.transform(F.array_union(left, right), lambda x: F.struct(x.alias("name"), kind(x).alias("kind")))


def column_changes(left: list[str], right: list[str]) -> list[tuple[str, str]]:
    """(name, kind): added, removed, moved (its place differs) or same."""
    out = []
    for name in [*left, *(c for c in right if c not in left)]:
        if name not in right:
            kind = "removed"
        elif name not in left:
            kind = "added"
        else:
            kind = "same" if left.index(name) == right.index(name) else "moved"
        out.append((name, kind))
    return out


def reordered(left: list[str], right: list[str]) -> list[str] | None:
    """Common columns in the right order, if two or more of them changed their relative order and some place moved; else None."""
    a, b = [c for c in left if c in right], [c for c in right if c in left]
    if len(a) < 2 or a == b or all(left.index(c) == right.index(c) for c in a):
        return None
    return b


def complete_headers(names: list[str | None], width: int) -> list[str]:
    """Names for all columns: blanks become column_i, repeated ones get _2, _3 and so on."""
    out: list[str] = []
    for i in range(width):
        name = (names[i] if i < len(names) else None) or ""
        name = name if name.strip() else f"column_{i + 1}"
        unique, n = name, 2
        while unique in out:
            unique, n = f"{name}_{n}", n + 1
        out.append(unique)
    return out
