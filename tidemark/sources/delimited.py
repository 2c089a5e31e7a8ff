"""Delimited text: what separates, quotes and ends its cells, where the header is, and whether several tables are stacked in it."""

from __future__ import annotations

import csv
import io
import re
from collections import Counter
from dataclasses import dataclass

from tidemark.config import PathConfig
from tidemark.operators.regions import FEWEST, LEAST_ROWS, MOST
from tidemark.operators.schema import complete_headers

SAMPLE = 16 << 10
DELIMITERS = [",", "\t", "|", ";", ":"]
_NUMBER = re.compile(r"^\s*[+-]?\d+([.,]\d+)?\s*$")


@dataclass
class Dialect:
    delimiter: str = ","
    quote: str = '"'
    escape: str | None = None
    bom: bool = False
    inferred: bool = False


def default_delimiter(path: str) -> str:
    return "\t" if path.lower().endswith((".tsv", ".tab")) else ","


def rows_of(text: str, dialect: Dialect) -> list[list[str]]:
    csv.field_size_limit(1 << 30)
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=dialect.delimiter, quotechar=dialect.quote, escapechar=dialect.escape, doublequote=dialect.escape is None, strict=False)
    return list(reader)


def sniff(data: bytes, path: str, declared: dict | None = None) -> Dialect:
    """The dialect of a file's first SAMPLE bytes; what is declared holds."""
    declared = declared or {}
    bom = data.startswith(b"\xef\xbb\xbf")
    text = data[:SAMPLE].decode("utf-8-sig", "replace")
    if len(data) > SAMPLE and "\n" in text:
        text = text[: text.rindex("\n") + 1]
    usual = default_delimiter(path)
    quote = declared.get("quote") or ("'" if text.count("'") > 2 * text.count('"') and re.search(r"(^|[,;|\t])'", text) else '"')
    escape = declared.get("escape") or ("\\" if f"\\{quote}" in text else None)
    if declared.get("delimiter"):
        return Dialect(declared["delimiter"], quote, escape, bom)

    def score(delimiter: str) -> tuple:
        try:
            rows = [r for r in rows_of(text, Dialect(delimiter, quote, escape)) if r and any(c.strip() for c in r)]
        except csv.Error:
            return (0, 0, 0, 0)
        widths = Counter(len(r) for r in rows)
        width, at_width = max(widths.items(), key=lambda x: (x[1] if x[0] > 1 else 0, x[0]), default=(1, 0))
        if width < 2:
            return (0, 0, 0, delimiter == usual)
        # a comma between digits only is a decimal comma, not a separator
        split = sum(1 for r in rows for a, b in zip(r, r[1:], strict=False) if not (delimiter == "," and _NUMBER.match(a) and re.match(r"^\d+$", b)))
        return (at_width if split else 0, len(rows), split, delimiter == usual)

    best = max(DELIMITERS, key=score)
    if score(best)[0] == 0:
        best = usual
    return Dialect(best, quote, escape, bom, inferred=best != usual)


def with_header(rows: list[list[str]], config: PathConfig) -> tuple[list[str], list[list[str]]]:
    """(names, rows) by the header policy."""
    rows = rows[config.skip_lines :]
    if config.header_line:
        names, rows = (rows[config.header_line - 1] if len(rows) >= config.header_line else []), rows[config.header_line :]
    elif config.has_header:
        names, rows = (rows[0] if rows else []), rows[1:]
    else:
        names = []
    rows = [r for r in rows if r]
    width = max([len(names), *map(len, rows)], default=0)
    return complete_headers(list(names), width), rows


def stacked(rows: list[list[str]]) -> list[tuple[int, int]]:
    """(first, end) of each of FEWEST to MOST regions of rows of one width, each of more than LEAST_ROWS rows; else none. Blank rows end nothing."""

    def width(r: list[str]) -> int:
        n = len(r)
        while n and not r[n - 1].strip():
            n -= 1
        return n

    regions: list[list[int]] = []
    for i, r in enumerate(rows):
        w = width(r)
        if not w:
            continue
        if regions and regions[-1][2] == w:
            regions[-1][1] = i + 1
            regions[-1][3] += 1
        else:
            regions.append([i, i + 1, w, 1])
    if not FEWEST <= len(regions) <= MOST or any(n <= LEAST_ROWS for *_, n in regions):
        return []
    return [(a, b) for a, b, _, _ in regions]
