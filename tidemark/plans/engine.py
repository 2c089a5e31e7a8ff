"""Comparison of two snapshots: items are paired by joins, pairs are explained by edits, and the result is a tree of what changed.

The control plane (items without their bytes, links, edits of a pair) is as large as the number of files; the data plane (contents,
rows of tables) stays in DataFrames, and all changed pairs go through it together.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import plugins
from tidemark.config import Config, Diagnostic, diagnostic, load
from tidemark.operators import pairing, similarity
from tidemark.operators.compact import Edit, cost, edit
from tidemark.operators.order import ROW
from tidemark.plans.compare import Plan, compare
from tidemark.plans.reading import Head, content_batches, heads_of, read_files, read_pairs
from tidemark.plans.tables import CONTAINERS, DELIMITED, is_tabular
from tidemark.sources import files, large
from tidemark.sources.records import untagged
from tidemark.store import keep, local

FUZZY_BYTES = 8 << 20
#: Files that can't be cut are read whole up to this; larger ones are compared by their hashes.
WHOLE_BYTES = 1 << 30
DIAGNOSTICS = 16
LINKS = "left string, right string, evidence string"
#: Links that settle both ends: what is below these has no part in anything else. Renames are among them if they aren't to be expanded.
SETTLED = ("same content", "copy")


def plain(value):
    """Params with the cells' own values in place of their tagged texts."""
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return untagged(value) if isinstance(value, str) else value


@dataclass
class Node:
    """What happened to one item."""

    path: str
    action: str
    source: str | None = None
    item_type: str = "file"
    tags: list[str] = field(default_factory=list)
    edits: list[Edit] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)
    summary: str = ""

    def to_dict(self) -> dict:
        out = {"path": self.path, "action": self.action, "item_type": self.item_type}
        out |= {k: v for k, v in (("source", self.source), ("tags", sorted(set(self.tags))), ("summary", self.summary)) if v}
        if shown := [e for e in self.edits if e["visible"]]:
            out["edits"] = [{"verb": e["verb"], "params": plain(e["params"])} for e in shown]
        if self.children:
            out["children"] = [c.to_dict() for c in self.children]
        return out

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()


@dataclass
class Changeset:
    root: Node
    claims: list[dict] = field(default_factory=list)
    diagnostics: list[Diagnostic] = field(default_factory=list)
    left: str = ""
    right: str = ""
    trace: list[dict] = field(default_factory=list)

    @property
    def changed(self) -> bool:
        return self.root.action != "identical"

    def to_dict(self) -> dict:
        return {"from": self.left, "to": self.right, "root": self.root.to_dict(), "claims": self.claims, "diagnostics": self.diagnostics}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, ensure_ascii=False)

    @classmethod
    def from_dict(cls, raw: dict) -> Changeset:
        """From what to_dict gave; hidden edits are gone."""

        def node(x: dict) -> Node:
            edits = [edit(e["verb"], e["params"]) for e in x.get("edits", [])]
            return Node(x["path"], x["action"], x.get("source"), x["item_type"], x.get("tags", []), edits, [node(c) for c in x.get("children", [])], x.get("summary", ""))

        return cls(node(raw["root"]), raw["claims"], raw["diagnostics"], raw["from"], raw["to"])

    def find(self, path: str) -> Node | None:
        return next((n for n in self.root.walk() if n.path == path), None)

    def tags(self) -> set[str]:
        return {t for n in self.root.walk() for t in n.tags}


# --- links ---------------------------------------------------------------------------------------------------------------


def _meta(items: DataFrame) -> DataFrame:
    return items.select("path", "name", "parent", "ext", "size", "hash", "is_dir", "container")


def _fresh(links: DataFrame, new: DataFrame) -> DataFrame:
    """Those new links that concern an item of the right side for the first time."""
    return new.join(links.select("right").distinct(), "right", "left_anti").select("left", "right", "evidence").dropDuplicates(["right"])


def _add(links: DataFrame, new: DataFrame) -> DataFrame:
    return keep(links.unionByName(_fresh(links, new)))


def settling(config: Config) -> tuple[str, ...]:
    return SETTLED if config.expand_renamed else (*SETTLED, "moved")


def visible(items: DataFrame, links: DataFrame, side: str, kinds: tuple[str, ...]) -> DataFrame:
    """Items that are not below an archive which a link has settled."""
    parts = F.split("path", "/>")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/>"))
    settled = links.filter(F.col("evidence").isin(*kinds)).select(F.col(side).alias("above")).distinct()
    below = items.filter(F.contains("path", F.lit("/>"))).select("path", F.explode(above).alias("above")).join(settled, "above", "left_semi")
    return items.join(below.select("path").distinct(), "path", "left_anti")


def below_settled(paths: set[str], settled: set[str]) -> set[str]:
    """The same for paths on the driver."""
    return {p for p in paths if any(p[:i] in settled for i in range(len(p)) if p.startswith("/>", i))}


@dataclass
class Open:
    """How many items have no link yet."""

    left_files: int
    right_files: int
    left_folders: int
    right_folders: int

    @property
    def files(self) -> bool:
        return bool(self.left_files and self.right_files)

    @property
    def folders(self) -> bool:
        return bool(self.left_folders and self.right_folders)


def _open(a: DataFrame, b: DataFrame, links: DataFrame) -> Open:
    free = lambda items, side: items.join(links.select(F.col(side).alias("path")).distinct(), "path", "left_anti").select(F.lit(side).alias("side"), (F.col("is_dir") | F.col("container")).alias("holds"), ~F.col("is_dir"))
    both = free(a, "left").unionByName(free(b, "right")).toDF("side", "holds", "is_file")
    count = lambda side, what: F.count_if((F.col("side") == side) & F.col(what))
    return Open(*both.agg(count("left", "is_file"), count("right", "is_file"), count("left", "holds"), count("right", "holds")).first())


def pair_items(left: DataFrame, right: DataFrame, config: Config) -> tuple[DataFrame, list[dict], list[Diagnostic]]:
    """(left, right, evidence), claims and diagnostics of split and merged tables. Rules in the order of their weight; names under
    paired parents are tried again whenever parents were paired. Rules that need unlinked items run only where there are some."""
    spark = left.sparkSession
    a, b = keep(_meta(left)), keep(_meta(right))
    links = local(spark, [("", "", "root")], LINKS)
    if config.pairs:
        given = local(spark, config.pairs, "left string, right string").withColumn("evidence", F.lit("declared"))
        links = _add(links, given.join(a.select(F.col("path").alias("left")), "left", "left_semi").join(b.select(F.col("path").alias("right")), "right", "left_semi"))
    files_of = lambda df: df.filter("NOT is_dir")
    for rule in config.rules:
        links = _add(links, pairing.declared(files_of(a), files_of(b), rule["left"], rule["right"], rule["key"], links))
    outer = lambda df: files_of(df).filter(~F.contains("path", F.lit("/>")))
    nested = bool(a.select("path").unionByName(b.select("path")).filter(F.contains("path", F.lit("/>"))).take(1))

    def shown(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        if not nested:
            return a, b
        return keep(visible(a, links, "left", settling(config))), keep(visible(b, links, "right", settling(config)))

    links = _add(links, pairing.same_content(files_of(a), files_of(b)))
    a, b = shown(links)
    links = _add(links, pairing.moved(outer(a), outer(b), links))
    if not config.expand_renamed:
        a, b = shown(links)

    def names(links: DataFrame) -> DataFrame:
        while True:
            new = keep(_fresh(links, pairing.same_name_below(a, b, links)))
            if not new.take(1):
                return links
            links = keep(links.unionByName(new))

    def containers(links: DataFrame) -> DataFrame:
        """Paired containers vote for their own parents, so this goes on for as many rounds as folders lie in each other."""
        while True:
            new = keep(_fresh(links, pairing.best_containers(pairing.container_votes(a, b, links), links)))
            if not new.take(1):
                return links
            links = names(keep(links.unionByName(new)))

    links = names(links)
    rest = _open(a, b, links)
    if rest.right_files:
        if nested:  # whole archives before what is in them
            links = _add(links, pairing.copied(files_of(a), outer(b).filter("container"), links))
            a, b = shown(links)
        if rest.left_files:
            links = _add(links, pairing.moved(files_of(a), files_of(b), links))
        links = _add(links, pairing.copied(files_of(a), files_of(b), links))
        a, b = shown(links)
    if rest.folders:
        links = containers(links)
    for rule in plugins.PAIR_RULES:
        links = _add(links, rule(a, b, links))
    if rest.files or rest.folders:
        rest = _open(a, b, links)
    if not rest.files:
        return links, [], []
    if nested:
        left, right = left.join(a.select("path"), "path", "left_semi"), right.join(b.select("path"), "path", "left_semi")
    claims, diagnostics = partitions(left, right, links, config)
    claimed = local(spark, [(p,) for c in claims for p in [c["whole"], *c["parts"]]], "path string")
    free = lambda df: df.join(claimed, "path", "left_anti")
    found = keep(_fresh(links, similar_tables(free(left), free(right), links, config)))
    found = keep(found.unionByName(_fresh(links.unionByName(found), similar_files(free(left), free(right), links.unionByName(found), config))))
    if found.take(1):
        links = keep(links.unionByName(found))
        links = containers(links) if rest.folders else names(links)
    return links, claims, diagnostics


def similar_tables(left: DataFrame, right: DataFrame, links: DataFrame, config: Config) -> DataFrame:
    """Unlinked files that are one table each, whatever their formats, by their headers and the tokens of their first rows."""

    def side(items: DataFrame, name: str) -> DataFrame | None:
        free = items.filter(~F.col("is_dir") & ~F.col("container") & F.col("content").isNotNull()).join(links.select(F.col(name).alias("path")).distinct(), "path", "left_anti")
        found = sorted((r["path"], r["ext"]) for r in free.select("path", "ext").collect() if config.of(r["path"]).rule not in ("text", "binary") and is_tabular(r["ext"], config.of(r["path"])))
        if not found:
            return None
        read = read_files(items, [(i, path, ext, config_number(config, path)) for i, (path, ext) in enumerate(found)], config)
        single = read.filter("kind = 'head'").groupBy("id").agg(F.count("*").alias("n"), F.first("cells").alias("columns")).filter("n = 1").select("id", F.array_distinct(F.transform("columns", F.lower)).alias("headers"))
        cells = read.filter((F.col("kind") == "row") & (F.col(ROW) < similarity.HEAD_ROWS)).select("id", F.explode(similarity.word_tokens(F.concat_ws(" ", "cells"))).alias("token"))
        tokens = cells.groupBy("id").agg(F.collect_set("token").alias("tokens"))  # of HEAD_ROWS rows
        none = F.array().cast("array<string>")
        paths = local(items.sparkSession, [(i, path) for i, (path, _) in enumerate(found)], "number int, id string")
        joined = single.join(tokens, "id", "left").withColumnRenamed("id", "number").join(paths, "number")
        return keep(joined.select("id", "headers", F.coalesce("tokens", none).alias("tokens")))

    a = side(left, "left")
    b = side(right, "right") if a is not None else None
    if a is None or b is None:
        return local(left.sparkSession, [], LINKS)
    found = similarity.greedy(similarity.table_pairs(a, b)).select("left", "right")
    rest = lambda df, name: df.join(found.select(F.col(name).alias("id")), "id", "left_anti")
    return found.unionByName(similarity.by_place(rest(a, "left"), rest(b, "right"))).withColumn("evidence", F.lit("similar table"))


def similar_files(left: DataFrame, right: DataFrame, links: DataFrame, config: Config) -> DataFrame:
    """Unlinked texts of one extension by their tokens, one to one; all of them are compared, through shared rare tokens."""

    def side(items: DataFrame, name: str) -> DataFrame:
        free = items.filter(~F.col("is_dir") & ~F.col("container") & F.col("content").isNotNull() & (F.col("size") <= FUZZY_BYTES) & (F.col("size") > 0))
        free = free.join(links.select(F.col(name).alias("path")).distinct(), "path", "left_anti")
        content = F.decode("content", "ISO-8859-1")
        plain = ~F.contains(F.substring(content, 1, 8192), F.lit("\0"))
        return keep(free.filter(plain).select(F.col("path").alias("id"), "ext", similarity.file_tokens(content).alias("tokens")))

    a, b = side(left, "left"), side(right, "right")
    if not a.take(1) or not b.take(1):
        return local(left.sparkSession, [], LINKS)
    return similarity.greedy(keep(similarity.similar_pairs(a, b, ["ext"]))).select("left", "right", F.lit("similar").alias("evidence"))


# --- edits of a pair --------------------------------------------------------------------------------------------------------


def config_number(config: Config, path: str) -> int:
    """Place of a path's configuration in [defaults, *paths]."""
    own = config.of(path)
    return next((i for i, p in enumerate(config.paths, 1) if p is own), 0)


def with_contents(items: DataFrame, paths: list[tuple[str, str]]) -> DataFrame:
    """path, content of items, with those of some that aren't held read from where they are. paths: (path, physical)."""
    own = items.filter("content IS NOT NULL").select("path", "content")
    if not paths:
        return own
    spark = items.sparkSession
    read = spark.read.format("binaryFile").load(large.reader_paths([p for _, p in paths])).select(F.col("_metadata.file_path").alias("physical"), "content")
    return own.unionByName(local(spark, paths, "path string, physical string").join(read, "physical").select("path", "content"))


def large_pairs(left: DataFrame, right: DataFrame, changed: list[tuple[dict, dict]], config: Config) -> tuple[DataFrame | None, dict[tuple[int, str, str], Head], set[int]]:
    """Rows and heads of the pairs of which a file is too large to be held, and the pairs of these that are no tables that can be cut."""
    too_large = [i for i, (a, b) in enumerate(changed) if not (a["held"] and b["held"])]
    if not too_large:
        return None, {}, set()
    files_, held = [], {"l": [], "r": []}
    for i in too_large:
        for side, item in zip("lr", changed[i], strict=True):
            if item["held"]:
                held[side].append((i, item["path"], item["ext"], config_number(config, item["path"])))
            elif config.of(item["path"]).rule not in ("text", "binary"):
                files_.append(large.File(i, side, item["path"], item["ext"], item["physical"], config.of(item["path"])))
    rows, tables = large.read_large(left.sparkSession, [f for f in files_ if f.kind])
    heads = {(i, side, t.name): Head(t.columns, {}, t.inferred, t.rows) for (i, side), own in tables.items() for t in own}
    for side, items in (("l", left), ("r", right)):
        if held[side]:
            read = read_files(items, held[side], config)
            heads |= {(i, side, name): head for (i, _, name), head in heads_of(read).items()}
            more = read.filter("kind = 'row'").select("id", F.lit(side).alias("side"), "name", ROW, "cells")
            rows = more if rows is None else rows.unionByName(more)
    known = {(i, side) for i, side, _ in heads}
    left_out = {i for i in too_large if not {(i, "l"), (i, "r")} <= known}
    heads = {k: h for k, h in heads.items() if k[0] not in left_out}
    if rows is not None:
        rows = rows.filter(~F.col("id").isin(sorted(left_out))).select(F.lit("row").alias("kind"), "id", "side", "name", ROW, "cells")
    return rows, heads, left_out


def explain(left: DataFrame, right: DataFrame, changed: list[tuple[dict, dict]], config: Config) -> tuple[list[Node], list[Diagnostic]]:
    """A node for each pair of items of different bytes, with what explains it. All pairs are read and compared together."""
    nodes = [Node(b["path"], "modify", a["path"], "file") for a, b in changed]
    if not changed:
        return [], []
    diagnostics: list[Diagnostic] = []
    large_rows, large_heads, left_out = large_pairs(left, right, changed, config)
    jobs, whole = [], {"l": [], "r": []}
    for i, (a, b) in enumerate(changed):
        own = (i, a["path"], b["path"], a["ext"], b["ext"], config_number(config, a["path"]), config_number(config, b["path"]))
        if a["held"] and b["held"]:
            jobs.append(own)
        elif i in left_out and max(a["size"], b["size"]) <= WHOLE_BYTES:
            jobs.append(own)
            for side, item in (("l", a), ("r", b)):
                whole[side] += [] if item["held"] else [(item["path"], item["physical"])]
        elif i in left_out:
            diagnostics.append(diagnostic("warning", "too_large", f"files of {a['size']:,} and {b['size']:,} bytes that can't be cut are compared by their hashes", b["path"]))
    left, right = (with_contents(items, whole[side]) for items, side in ((left, "l"), (right, "r")))
    found = read_pairs(left, right, jobs, config)
    for r in found.filter("kind = 'pair'").select("id", "body").collect():  # edits of a pair, up to the limits of each verb
        body, node = json.loads(r["body"]), nodes[r["id"]]
        node.item_type, node.tags, node.edits = body["item_type"], body["tags"], body["edits"]
        diagnostics += body["diagnostics"]
    heads = heads_of(found) | large_heads
    found = found.select("kind", "id", "side", "name", ROW, "cells")
    if large_rows is not None:
        found = found.unionByName(large_rows)
    names: dict[int, dict[str, list[str]]] = defaultdict(lambda: {"l": [], "r": []})
    for i, side, name in sorted(heads):
        names[i][side].append(name)
    plans: list[Plan] = []
    holders: list[tuple[Node, Node]] = []  # the node of a plan's table, and the one that it is in
    for i, own in sorted(names.items()):
        a, b = changed[i]
        node, cfg = nodes[i], config.of(b["path"])
        if a["ext"] != b["ext"]:
            node.tags.append("serialization-change")
        if any(heads[i, "r", n].inferred_dialect for n in own["r"]):
            node.tags.append("dialect-inferred")
        if b["ext"] not in CONTAINERS and len(own["l"]) == len(own["r"]) == 1:
            node.item_type = "table"
            plans.append(Plan(len(plans), node.path, i, own["l"][0], own["r"][0], heads[i, "l", own["l"][0]], heads[i, "r", own["r"][0]], cfg))
            holders.append((node, node))
            continue
        node.item_type = "container"
        for name in sorted({*own["l"], *own["r"]}):
            path = f"{node.path}/>{name}"
            if name not in own["r"]:
                node.children.append(Node(path, "remove", item_type="table"))
            elif name not in own["l"]:
                node.children.append(Node(path, "add", item_type="table"))
            else:
                inner = config.of(path) if config.of(path) is not config.defaults else cfg
                plans.append(Plan(len(plans), path, i, name, name, heads[i, "l", name], heads[i, "r", name], inner))
                holders.append((Node(path, "modify", f"{node.source}/>{name}", "table"), node))
    compare(found, plans, config.sentinels)
    for plan, (table, holder) in zip(plans, holders, strict=True):
        table.edits = plan.edits
        diagnostics += plan.diagnostics
        if table is not holder and table.edits:
            _finish(table)
            if table.action != "identical":
                holder.children.append(table)
    for node in nodes:
        node.children.sort(key=lambda n: n.path)
    return nodes, diagnostics


def _finish(node: Node) -> None:
    node.tags = sorted({*node.tags, *(t for e in node.edits for t in e["tags"])})
    visible = [e for e in node.edits if e["visible"]]
    if node.edits and not visible and not node.children and any(e["verb"] == "tabular.numeric_canonical_equal" for e in node.edits) and node.action == "modify":
        node.action = "identical"
    elif not node.edits and not node.children and node.action == "modify":
        node.edits = [edit("content.differs", {"reason": "bytes differ"}, ("content-changed",))]
        node.tags = sorted({*node.tags, "content-changed"})
    for annotate in plugins.ANNOTATORS:
        node.tags = sorted({*node.tags, *annotate(node)})
    node.summary = summarise(node)


def summarise(node: Node) -> str:
    """Counts of what the edits say."""
    n: Counter[str] = Counter()
    for e in node.edits:
        p, verb = e["params"], e["verb"].rpartition(".")[2]
        if not e["visible"]:
            continue
        if verb == "append_rows":
            n["row added"] += p.get("row_count", len(p["rows"]))
        elif verb in ("values_rounded", "values_suppressed", "column_type_changed"):
            n[{"values_rounded": "value rounded", "values_suppressed": "value suppressed", "column_type_changed": "cell retyped"}[verb]] += p["cells"]
        elif verb == "keyed_stream_summary":
            n.update({"row added": p["rows_added"], "row removed": p["rows_removed"], "cell changed": p["cells_changed"]})
        elif verb == "replace_lines":
            n.update({"line added": p["lines_added"], "line removed": p["lines_removed"]})
        else:
            n[{"add_row": "row added", "remove_row": "row removed", "edit_cell": "cell changed", "add_column": "column added", "remove_column": "column removed", "rename_column": "column renamed"}.get(verb, verb.replace("_", " "))] += 1
    plural = lambda k, v: f"{v:,} {k}" if v == 1 or " " not in k else f"{v:,} {k.split()[0]}s {k.split(' ', 1)[1]}"
    return ", ".join(plural(k, v) for k, v in n.items() if v and k != "set headers")


# --- row sets across files ------------------------------------------------------------------------------------------------


def partitions(left: DataFrame, right: DataFrame, links: DataFrame, config: Config) -> tuple[list[dict], list[Diagnostic]]:
    """Claims of tables that were split or merged exactly, among all unlinked delimited files; suggestions for near misses. A row's token
    is a hash of its table's columns and its cells; the rows of all files are read and matched together."""

    def tokens(items: DataFrame, side: str) -> tuple[DataFrame, dict[int, str]] | None:
        free = items.filter(~F.col("is_dir") & F.col("ext").isin(*DELIMITED)).join(links.select(F.col(side).alias("path")), "path", "left_anti")
        files_ = sorted((r["path"], r["ext"]) for r in free.select("path", "ext").collect())
        if not files_:
            return None
        read = read_files(items, [(i, path, ext, config_number(config, path)) for i, (path, ext) in enumerate(files_)], config)
        heads = read.filter("kind = 'head'").select("id", "name", F.col("cells").alias("columns"))
        cells = F.transform(F.sequence(F.lit(0), F.size("columns") - 1), lambda i: F.coalesce(F.get("cells", i), F.lit("\0")))
        rows = read.filter("kind = 'row'").select("id", "name", "cells").join(heads, ["id", "name"])
        token = F.sha2(F.concat(F.array_join("columns", "\x1e"), F.lit("\x1d"), F.array_join(cells, "\x1f")), 256)
        return rows.select("id", token.alias("token")), {i: path for i, (path, _) in enumerate(files_)}

    claims, diagnostics = [], []
    one = tokens(left, "left")
    two = tokens(right, "right") if one else None
    if one is None or two is None:
        return claims, diagnostics
    for verb, (w, whole_names), (p, part_names) in (("split", one, two), ("merge", two, one)):
        whole, part = w.withColumnRenamed("id", "whole"), p.withColumnRenamed("id", "part")
        cover = keep(pairing.exact_cover(whole, part))
        clean = pairing.clean_splits(cover)
        parts = defaultdict(list)
        for r in whole.join(clean.select("whole"), "whole", "left_semi").distinct().join(part.distinct(), "token").select("whole", "part").distinct().collect():
            parts[r["whole"]].append(part_names[r["part"]])
        for row in clean.collect():
            claims.append({"verb": verb, "whole": whole_names[row["whole"]], "parts": sorted(parts[row["whole"]]), "covered": row["covered"], "residual": 0})
        for row in pairing.near_splits(cover).collect():
            diagnostics.append(diagnostic("suggestion", "possible_split", f"{row['covered']} rows would be covered, {row['residual']} not", whole_names[row["whole"]]))
    return sorted(claims, key=lambda c: (c["verb"] != "split", c["whole"])), diagnostics


# --- the whole ----------------------------------------------------------------------------------------------------------------


def diff(spark: SparkSession, left: str, right: str, config: Config | dict | str | None = None) -> Changeset:
    with content_batches(spark):
        return _diff(spark, left, right, config if isinstance(config, Config) else load(config))


def _diff(spark: SparkSession, left: str, right: str, config: Config) -> Changeset:
    a, b = (keep(files.scan(spark, root, config, closed)) for root, closed in zip((left, right), files.closed_archives(spark, left, right, config), strict=True))
    only = [d.agg(F.count("*").alias("n"), F.count_if(F.col("is_dir") | F.contains("path", F.lit("/"))).alias("deep"), F.min("path").alias("path")).first() for d in (a, b)]
    single = all(x["n"] == 1 and not x["deep"] for x in only)
    if single and not config.pairs:
        config = replace(config, pairs=[(only[0]["path"], only[1]["path"])])
    links, claims, found = pair_items(a, b, config)
    links = links.collect()
    trace = [{"phase": "pair", "rule": rule, "links": n} for rule, n in sorted(Counter(x["evidence"].split(":")[0] for x in links).items())]
    columns = ["path", "name", "parent", "ext", "size", "hash", "is_dir", "container", "physical", "problem"]
    held = F.col("content").isNotNull().alias("held")
    old, new = ({r["path"]: r.asDict() for r in d.select(*columns, held).collect()} for d in (a, b))
    diagnostics = list(config.diagnostics)
    diagnostics += [diagnostic("warning", r["problem"].split(":")[0], r["problem"], r["path"]) for r in [*old.values(), *new.values()] if r["problem"]]
    diagnostics += found
    nodes: list[Node] = []
    changed: list[tuple[dict, dict]] = []
    evidence: list[tuple[str, bool]] = []
    parent_of = {x["right"]: x["left"] for x in links}
    for x in sorted(links, key=lambda x: (x["right"], x["left"])):
        if x["left"] not in old or x["right"] not in new:
            continue
        l, r = old[x["left"]], new[x["right"]]
        carried = l["name"] == r["name"] and parent_of.get(r["parent"]) == l["parent"]
        if r["is_dir"]:
            if l["path"] != r["path"] and not carried:
                nodes.append(Node(r["path"], "move", l["path"], "directory", ["move", "folder-move"]))
            continue
        if l["hash"] == r["hash"]:
            if x["evidence"] == "copy":
                nodes.append(Node(r["path"], "copy", l["path"], tags=["copy"]))
            elif l["path"] != r["path"] and not carried:
                nodes.append(Node(r["path"], "move", l["path"], tags=["move", *(["folder-move"] if r["container"] else [])]))
            continue
        if l["container"] and r["container"]:
            if l["path"] != r["path"] and not carried:
                nodes.append(Node(r["path"], "move", l["path"], "container", ["move", "folder-move"]))
            continue  # what is inside has links of its own
        changed.append((l, r))
        evidence.append((x["evidence"], carried))
    explained, more = explain(a, b, changed, config)
    diagnostics += more
    for node, (why, carried) in zip(explained, evidence, strict=True):
        if why.startswith("declared") and not single:
            node.tags.append("declared-correspondence")
        _finish(node)
        if node.source != node.path and not carried and not single and not why.startswith("declared"):
            node.action, node.tags = "move", [*node.tags, "move", "move.modified"]
        if node.action != "identical":
            nodes.append(node)
    nodes = fused_layers(nodes, set(old), set(new))
    trace += [{"phase": "write", "path": n.path, "edits": len(n.edits), "cost": cost(n.edits)} for n in nodes if n.edits]
    settled = [x for x in links if x["evidence"] in settling(config)]
    gone, came = set(old) - {x["left"] for x in links}, set(new) - {x["right"] for x in links}
    gone -= below_settled(gone, {x["left"] for x in settled})
    came -= below_settled(came, {x["right"] for x in settled})
    claimed = {p for c in claims for p in [c["whole"], *c["parts"]]}
    nodes += [Node(p, "remove", item_type="directory" if old[p]["is_dir"] else "file") for p in sorted(gone - claimed)]
    nodes += [Node(p, "add", item_type="directory" if new[p]["is_dir"] else "file") for p in sorted(came - claimed)]
    for c in claims:
        if c["verb"] == "split":
            nodes += [Node(p, "tabular_split", c["whole"], "table", ["tabular_split"]) for p in c["parts"]]
        else:
            nodes.append(Node(c["whole"], "tabular_merge", ", ".join(c["parts"]), "table", ["tabular_merge"], summary=f"Merged from {', '.join(c['parts'])}"))
    seen, unique = set(), []
    for d in diagnostics:
        if (d["code"], d["location"]) not in seen:
            seen.add((d["code"], d["location"]))
            unique.append(d)
    return Changeset(tree(nodes), claims, unique[:DIAGNOSTICS], left, right, trace)


def stem(path: str) -> str:
    """The path without its last extension, in lower case."""
    head, dot, tail = path.rpartition(".")
    return (head if dot and "/" not in tail else path).lower()


def fused_layers(nodes: list[Node], old: set[str], new: set[str]) -> list[Node]:
    """Shapefiles are layers: a .shp with a .shx and a .dbf of the same folder and stem has its geometry and its attribute table
    inside it, and the index has no node of its own."""
    kinds: dict[str, dict[str, str]] = defaultdict(dict)
    for p in new & old:
        if p.lower().endswith((".shp", ".shx", ".dbf")):
            kinds[stem(p)].setdefault(p.lower()[-4:], p)
    layers = {k: v[".shp"] for k, v in kinds.items() if len(v) == 3}
    out = []
    for n in nodes:
        layer, ext = layers.get(stem(n.path)), n.path.lower()[-4:]
        if layer and ext == ".shx":
            continue
        if layer and ext in (".shp", ".dbf"):
            n.path, n.source = f"{layer}/>{'geometry' if ext == '.shp' else 'attributes'}", n.source
        out.append(n)
    return out


def tree(nodes: list[Node]) -> Node:
    """Nodes under their folders; a folder on the way that did not change itself is `modify`."""
    by = {n.path: n for n in nodes}
    opened = {p[: p.index("/>", i)] for p in by for i in range(len(p)) if p.startswith("/>", i)}
    below: dict[str, list[Node]] = defaultdict(list)
    placed: set[str] = set()
    for path in sorted(by):
        at = path
        while at:
            parent = at.rpartition("/")[0]
            if at not in by:
                by[at] = Node(at, "modify", item_type="container" if at in opened else "directory")
            if at in placed:
                break
            placed.add(at)
            below[parent].append(by[at])
            at = parent
    root = by.get("") or Node("", "modify" if nodes else "identical", item_type="directory")
    for path, children in below.items():
        holder = root if path == "" else by[path]
        known = {c.path for c in holder.children}
        holder.children = sorted([*holder.children, *(c for c in children if c.path not in known)], key=lambda n: n.path)
    return root


def diff_many(spark: SparkSession, snapshots: list[str], config: Config | dict | str | None = None) -> list[Changeset]:
    return [diff(spark, a, b, config) for a, b in zip(snapshots, snapshots[1:], strict=False)]


def description_cost(changeset: Changeset) -> int:
    return sum(cost(n.edits, 1) for n in changeset.root.walk() if n.source is not None)
