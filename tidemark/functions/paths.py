"""Logical paths: `/` joins a container and its member, `/>` a file and what was found inside it. Column functions and globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape_segment(name: str) -> str:
    """A name that starts with > gets a backslash, so that it can't be taken for the inside of a file."""
    return "\\" + name if name.startswith((">", "\\>")) else name


def member(parent: str, name: str) -> str:
    return f"{parent}/{escape_segment(name)}" if parent else escape_segment(name)


def inside(parent: str, name: str) -> str:
    return f"{parent}/>{name}"


def file_name(path: Column) -> Column:
    """The last segment, without the mark of a file's inside."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"^\\?>", "")


def extension(path: Column) -> Column:
    """Lower case, with the dot; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]+)$", 1))


def parent_path(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def segments(path: Column) -> Column:
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(path, "/"), lambda s: F.regexp_replace(s, r"^\\?>", "")))


def depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: `**/` any folders or none, `**` anything, `*` and `?` within a segment."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(glob[i]) or re.escape(glob[i]))
            i += 1
    return "^" + "".join(out) + "$"


def matches_glob(path: Column, glob: str) -> Column:
    """The path itself or, inside files, the path with `/>` read as `/`."""
    pattern = F.lit(glob_pattern(glob))
    return F.regexp_like(path, pattern) | F.regexp_like(F.replace(path, F.lit("/>"), F.lit("/")), pattern)


def glob_matches(path: str, glob: str) -> bool:
    pattern = glob_pattern(glob)
    return bool(re.match(pattern, path) or re.match(pattern, path.replace("/>", "/")))


def captured_key(path: Column, pattern: str, template: str) -> Column:
    """A key from a pattern's named groups: ${name} in the template stands for the group. Null if the path doesn't match."""
    java = re.sub(r"\(\?P<", "(?<", pattern)
    names = list(re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", java)).groupindex.items())
    out: Column = F.lit(template)
    for name, i in names:
        out = F.replace(out, F.lit("${" + name + "}"), F.regexp_extract(path, java, i))
    return F.when(F.regexp_like(path, F.lit(java)), out)
