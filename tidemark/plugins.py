"""What other packages can add: renderers, parsers, pair rules, edit writers and annotators, by hand or as entry points of `tidemark.plugins`.

An entry point is a function that takes this module and registers what it has.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points

from pyspark.sql import DataFrame

#: By name: changesets to text.
RENDERERS: dict[str, Callable] = {}
#: By extension: bytes to a list of (name, columns, rows of texts). They run on executors.
PARSERS: dict[str, Callable[[bytes], list[tuple[str, list[str], list[list[str | None]]]]]] = {}
#: (left items, right items, links so far) to new links (left, right, evidence).
PAIR_RULES: list[Callable[[DataFrame, DataFrame, DataFrame], DataFrame]] = []
#: By extension: (left bytes, right bytes) to edits, or None to decline.
WRITERS: dict[str, Callable[[bytes, bytes], list[dict] | None]] = {}
#: Node to tags to add.
ANNOTATORS: list[Callable[[object], set[str]]] = []


def discover() -> list[str]:
    """Loads the entry points; the names of those that were found."""
    import tidemark.plugins as registry

    found = list(entry_points(group="tidemark.plugins"))
    for point in found:
        point.load()(registry)
    return [p.name for p in found]
