"""python -m tidemark.cli diff|changelog|extract|report. Exit: 0 nothing changed, 1 something changed, 2 an error."""

from __future__ import annotations

import argparse
import json
import shutil
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from tidemark import api


#: Bytes of snapshots that a report copies at most; larger ones are named only.
COPIED = 512 << 20


def _listed(x):
    return x if isinstance(x, list) else [x]


def report(folder: Path, snapshots: list[str], config: str | None, changesets: list[api.Changeset]) -> None:
    folder.mkdir(parents=True, exist_ok=True)
    for kind, suffix in (("json", "json"), ("markdown", "md"), ("html", "html")):
        (folder / f"changes.{suffix}").write_text(api.RENDERERS[kind](changesets))
    (folder / "trace.json").write_text(json.dumps([x.trace for x in changesets], indent=2))
    if config:
        shutil.copy(config, folder / "config.yaml")
    sizes = {s: sum(p.stat().st_size for p in ([Path(s)] if Path(s).is_file() else Path(s).rglob("*")) if p.is_file()) for s in snapshots if Path(s).exists()}
    kept = sum(sizes.values()) <= COPIED
    (folder / "snapshots.json").write_text(json.dumps([{"path": s, "bytes": sizes.get(s), "copied": kept and s in sizes} for s in snapshots], indent=2))
    for i, s in enumerate(sizes if kept else []):
        target = folder / "snapshots" / str(i)
        target.parent.mkdir(exist_ok=True)
        (shutil.copytree if Path(s).is_dir() else shutil.copy)(s, target)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    commands = parser.add_subparsers(dest="command", required=True)
    d = commands.add_parser("diff", help="what changed between snapshots")
    d.add_argument("snapshots", nargs="+")
    e = commands.add_parser("extract", help="one aspect of a node")
    for name in ("left", "right", "path", "aspect"):
        e.add_argument(name)
    c = commands.add_parser("changelog", help="render changesets that diff wrote as JSON")
    c.add_argument("changesets", nargs="+")
    c.add_argument("--format", default="markdown")
    b = commands.add_parser("report", help="a folder with snapshots, configuration, trace and all renderings")
    b.add_argument("snapshots", nargs="+")
    b.add_argument("folder")
    for p in (d, e, b):
        p.add_argument("--config")
    d.add_argument("-o", "--output", action="append", default=[], help="format:path, or a path for the format in --format")
    d.add_argument("--format", default="markdown")
    d.add_argument("-q", "--quiet", action="store_true")
    try:
        found = parser.parse_args(args)
    except SystemExit as stop:
        return 2 if stop.code else 0
    if found.command == "changelog":
        api.discover()
        try:
            raw = [x for name in found.changesets for x in _listed(json.loads(Path(name).read_text()))]
            print(api.RENDERERS[found.format]([api.Changeset.from_dict(x) for x in raw]), end="")
        except (OSError, KeyError, ValueError) as problem:
            print(f"error: {problem}", file=sys.stderr)
            return 2
        return 0
    spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
    api.discover()
    config = api.load(Path(found.config).read_text() if found.config else None)
    try:
        if found.command == "extract":
            changeset = api.diff(spark, found.left, found.right, config)
            df = api.extract(spark, found.left, found.right, changeset, found.path, found.aspect, config)
            print(",".join(df.columns))
            for row in df.toLocalIterator():
                print(",".join("" if v is None else str(v) for v in row))
            return 0
        if len(found.snapshots) < 2:
            print("diff needs two snapshots or more", file=sys.stderr)
            return 2
        changesets = api.diff_many(spark, found.snapshots, config)
        if found.command == "report":
            report(Path(found.folder), found.snapshots, found.config, changesets)
            return int(any(x.changed for x in changesets))
        for target in found.output:
            kind, _, path = target.rpartition(":") if ":" in target else (found.format, "", target)
            Path(path).write_text(api.RENDERERS[kind](changesets))
        if not found.quiet and not found.output:
            print(api.RENDERERS[found.format](changesets), end="")
    except (OSError, KeyError, ValueError) as problem:
        print(f"error: {problem}", file=sys.stderr)
        return 2
    if config.has_errors():
        return 2
    return int(any(c.changed for c in changesets))


if __name__ == "__main__":
    sys.exit(main())
