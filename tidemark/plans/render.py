"""Changesets as Markdown or HTML."""

from __future__ import annotations

import html
from collections import defaultdict

from tidemark.plans.engine import Changeset, Node, plain

EXAMPLES, BLOCKS, CHARS, BYTES, DIAGNOSTICS = 3, 4, 160, 200_000, 8
#: Sections in this order; a node goes to the first one that has one of its tags.
SECTIONS = [
    ("Attention", {"row-correspondence-uncertain", "identity-diagnostic"}),
    ("Schema changes", {"schema-change"}),
    ("Data changes", {"row-addition", "row-removal", "cell-change", "row-reorder", "document-value-change", "content-changed"}),
    ("Precision", {"value-suppressed", "value-rounded"}),
    ("Moved and copied", {"move", "copy", "folder-move"}),
    ("Format", {"serialization-change", "line-ending-change", "encoding-change", "whitespace-only-change"}),
]


def _short(value: object) -> str:
    out = str(value)
    return out if len(out) <= CHARS else out[: CHARS - 3] + "..."


def _lines(node: Node) -> list[str]:
    out = [f"- **{node.path or '/'}** {node.action}" + (f" from `{node.source}`" if node.source and node.source != node.path else "") + (f": {node.summary}" if node.summary else "")]
    groups: dict[str, list] = defaultdict(list)
    for e in node.edits:
        if e["visible"] and e["verb"] != "tabular.set_headers":
            groups[e["verb"]].append(plain(e["params"]))
    for verb, found in list(groups.items())[:BLOCKS]:
        # examples take turns between columns
        by: dict[str, list] = defaultdict(list)
        for p in found:
            by[str(p.get("column", ""))].append(p)
        turns = [p for i in range(EXAMPLES) for own in by.values() for p in own[i : i + 1]][:EXAMPLES]
        for p in turns:
            if verb.endswith("edit_cell"):
                where = p.get("key") or {"row": p.get("row", p.get("right_row"))}
                out.append(f"  - `{p['column']}` {_short(where)}: {_short(p['from'])!s} -> {_short(p['to'])!s}")
            else:
                out.append(f"  - {verb.rpartition('.')[2].replace('_', ' ')}: {_short(p)}")
        if len(found) > len(turns):
            out.append(f"  - and {len(found) - len(turns):,} more")
    return out


def to_markdown(changesets: list[Changeset]) -> str:
    out: list[str] = ["# Changelog"]
    for c in changesets:
        out += ["", f"## {c.left} to {c.right}"]
        nodes = [n for n in c.root.walk() if n.action not in ("identical",) and (n.edits or n.action != "modify")]
        if not nodes:
            out += ["", "No changes."]
        done: set[int] = set()
        for title, tags in [*SECTIONS, ("Other", None)]:
            own = [n for n in nodes if id(n) not in done and (tags is None or tags & set(n.tags))]
            done |= {id(n) for n in own}
            if own:
                out += ["", f"### {title}", "", *(line for n in own for line in _lines(n))]
        for claim in c.claims:
            out.append(f"- {claim['verb']}: `{claim['whole']}` and {', '.join(f'`{p}`' for p in claim['parts'])}, {claim['covered']:,} rows")
        if c.diagnostics:
            out += ["", "### Notes", "", *(f"- {d['severity']}: {d['message']} ({d['location']})" for d in c.diagnostics[:DIAGNOSTICS])]
    return "\n".join(out).encode()[:BYTES].decode("utf-8", "ignore") + "\n"


def to_html(changesets: list[Changeset]) -> str:
    def block(n: Node) -> str:
        tags = "".join(f"<span class='tag'>{html.escape(t)}</span>" for t in sorted(set(n.tags)))
        return f"<div class='node {html.escape(n.action)}'><b>{html.escape(n.path or '/')}</b> {html.escape(n.action)} {html.escape(n.summary)} {tags}{''.join(map(block, n.children))}</div>"

    return "<!doctype html><meta charset='utf-8'><title>Changelog</title>" + "".join(f"<h2>{html.escape(c.left)} to {html.escape(c.right)}</h2>{block(c.root)}" for c in changesets)
