"""Dataset configuration: a YAML file with renderers, output and dataset; what is wrong in it becomes diagnostics, not failures."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tidemark.functions.cells import SENTINELS
from tidemark.functions.paths import glob_matches

TOP = {"renderers", "output", "dataset"}
DATASET = {"defaults", "paths", "files", "correspondence", "reduced_precision", "exclude"}
PATH = {"match", "content_type", "rule", "shape", "dialect", "records_path", "row_identity", "node_identity"}
DIALECT = {"delimiter", "quote", "escape", "bom", "newline"}
SHAPE = {"has_header", "header_line", "skip_lines"}
ROW_IDENTITY = {"columns", "by_position", "on_null_key", "on_duplicate_key"}
#: What rows without a usable key are: a warning, an error, or nothing to be told.
POLICIES = {"diagnostic": "warning", "error": "error", "ignore": None}

Diagnostic = dict


def diagnostic(severity: str, code: str, message: str, location: str = "") -> Diagnostic:
    return {"severity": severity, "code": f"tidemark.{code}", "message": message, "location": location}


@dataclass
class PathConfig:
    match: str = "**"
    content_type: str | None = None
    rule: str | None = None
    has_header: bool = True
    header_line: int | None = None
    skip_lines: int = 0
    dialect: dict = field(default_factory=dict)
    records_path: str | None = None
    key_columns: list[str] = field(default_factory=list)
    key_positions: list[int] = field(default_factory=list)
    on_null_key: str = "diagnostic"
    on_duplicate_key: str = "diagnostic"
    node_key: str | None = None


@dataclass
class Config:
    paths: list[PathConfig] = field(default_factory=list)
    defaults: PathConfig = field(default_factory=PathConfig)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    rules: list[dict] = field(default_factory=list)
    #: Look inside archives that were renamed but not changed, so that what was copied out of them is found.
    expand_renamed: bool = True
    large_table_bytes: int = 32 << 20
    entry_bytes: int = 4 << 30
    total_bytes: int = 8 << 30
    sentinels: tuple[str, ...] = SENTINELS
    exclude: list[str] = field(default_factory=list)
    renderers: dict = field(default_factory=dict)
    diagnostics: list[Diagnostic] = field(default_factory=list)

    def of(self, path: str) -> PathConfig:
        """The first entry whose glob matches; what it leaves open comes from the defaults."""
        return next((p for p in self.paths if glob_matches(path, p.match)), self.defaults)

    def has_errors(self) -> bool:
        return any(d["severity"] == "error" for d in self.diagnostics)


def _path_config(raw: dict, base: PathConfig, where: str, out: list[Diagnostic]) -> PathConfig:
    bad = lambda code, text: out.append(diagnostic("error", f"dataset_config.{code}", text, where))
    for name in raw.keys() - PATH:
        bad("unknown_field", f"unknown field {name!r}")
    shape, dialect, identity = (raw.get(k) or {} for k in ("shape", "dialect", "row_identity"))
    for part, known in ((shape, SHAPE), (dialect, DIALECT), (identity, ROW_IDENTITY)):
        for name in part.keys() - known:
            bad("unknown_field", f"unknown field {name!r}")
    if shape.get("header_line") is not None and shape["header_line"] < 1:
        bad("invalid_header_line", "header_line counts from 1")
    if shape.get("skip_lines", 0) < 0:
        bad("invalid_skip_lines", "skip_lines is negative")
    if len(str(dialect.get("delimiter", ","))) != 1:
        bad("invalid_delimiter", "a delimiter is one character")
    columns, positions = identity.get("columns") or [], identity.get("by_position") or []
    if columns and positions:
        bad("ambiguous_row_identity", "columns and by_position exclude each other")
    if any(not isinstance(i, int) or i < 1 for i in positions):
        bad("invalid_key_position", "positions count from 1")
    policy = {name: identity.get(name, getattr(base, name)) for name in ("on_null_key", "on_duplicate_key")}
    for name, value in policy.items():
        if value not in POLICIES:
            bad(f"invalid_{name}", f"{value!r} is none of {', '.join(POLICIES)}")
            policy[name] = "diagnostic"
    records = raw.get("records_path")
    if records is not None and not re.match(r"^\$(\.[A-Za-z_][A-Za-z0-9_-]*)*$", records):
        bad("invalid_records_path", f"{records!r} is not of the form $.a.b")
    return PathConfig(
        match=raw.get("match", base.match),
        content_type=raw.get("content_type", base.content_type),
        rule=raw.get("rule", base.rule),
        has_header=shape.get("has_header", base.has_header),
        header_line=shape.get("header_line", base.header_line),
        skip_lines=shape.get("skip_lines", base.skip_lines),
        dialect=base.dialect | dialect,
        records_path=records or base.records_path,
        key_columns=columns or ([] if positions else base.key_columns),
        key_positions=positions or ([] if columns else base.key_positions),
        **policy,
        node_key=(raw.get("node_identity") or {}).get("key_attribute", base.node_key),
    )


def load(raw: dict | str | None) -> Config:
    """From a dict or YAML text."""
    if isinstance(raw, str):
        import yaml

        raw = yaml.safe_load(raw)
    raw = raw or {}
    out = Config(renderers=raw.get("renderers") or {})
    bad = lambda code, text, where="": out.diagnostics.append(diagnostic("error", f"dataset_config.{code}", text, where))
    for name in raw.keys() - TOP:
        bad("unknown_field", f"unknown field {name!r}")
    data = raw.get("dataset") or {}
    for name in data.keys() - DATASET:
        bad("unknown_field", f"unknown field {name!r}", "dataset")
    out.defaults = _path_config(data.get("defaults") or {}, PathConfig(), "dataset.defaults", out.diagnostics)
    for i, entry in enumerate(data.get("paths") or []):
        if not entry.get("match"):
            bad("missing_match", "a path entry needs match", f"dataset.paths[{i}]")
            continue
        out.paths.append(_path_config(entry, out.defaults, f"dataset.paths[{i}]", out.diagnostics))
    for i, entry in enumerate((data.get("files") or {}).get("correspondences") or []):
        where = f"dataset.files.correspondences[{i}]"
        if "key" not in entry:
            out.pairs.append((entry["left"], entry["right"]))
            continue
        for side in ("left", "right"):
            try:
                re.compile(entry[side])
            except re.error as e:
                bad(f"invalid_{side}_regex", str(e), where)
                break
        else:
            out.rules.append(entry)
    more = data.get("correspondence") or {}
    out.expand_renamed = more.get("expand_renamed_unchanged_collections", out.expand_renamed)
    out.large_table_bytes = more.get("large_table_bytes", out.large_table_bytes)
    out.entry_bytes, out.total_bytes = more.get("entry_bytes", out.entry_bytes), more.get("total_bytes", out.total_bytes)
    out.sentinels = tuple((data.get("reduced_precision") or {}).get("suppression_sentinels", out.sentinels))
    out.exclude = list(data.get("exclude") or [])
    return out
