"""License scan: an Aho-Corasick automaton finds notice phrases and identifier tags; a shunting-yard parser evaluates licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import arrow_schema, slices, table_rows, worker_state

# Phrases of the contract and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Phrases of our own, lower case, as words between single spaces.
OWN_PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by 4 0": "cc-by",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: How freely a label lets text be used, from 0 to 1; other labels have UNKNOWN.
FREEDOM = {
    "mit": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "public-domain": 1.0, "apache-2": 0.9, "cc-by": 0.9, "mpl": 0.6,
    "cc-by-sa": 0.5, "lgpl": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nc": 0.2, "all-rights-reserved": 0.0, "none": 0.0,
}
UNKNOWN = 0.5
#: What an exception after "with" adds to its licence.
EXCEPTION_GAIN = 0.1

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

#: Words are runs outside [\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z became a-z; everything else becomes a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_TAGGED = re.compile(rb"spdx-license-identifier\s*:?[ \t]*")
_LINE = re.compile(rb"[^\r\n]*")
#: What a comment may begin a line with.
_COMMENT = re.compile(rb"[ \t\r\n]*(?:#+|//+|/?\*+|--+|;+|%+|<!--|rem\b|dnl\b)?[ \t]*")
_TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+\-:]*")
_RANK = {"or": 1, "and": 2, "with": 3}

# Stems of identifiers of the public SPDX licence list (spdx.org/licenses) that are in common use, lower case. A version
# or clause may follow, as in gpl-3.0-or-later or bsd-3-clause.
STEMS = """
0bsd aal afl agpl aladdin apache apsl artistic beerware blueoak bsd bsl bzip2 cal cc cc0 cc-by cc-by-nc cc-by-nc-nd cc-by-nc-sa cc-by-nd
cc-by-sa cc-pddc cddl cdla-permissive cdla-sharing cecill cecill-b cecill-c cern-ohl-p cern-ohl-s cern-ohl-w cpal cpl curl dl-de-by
ecl efl elastic entessa epl etalab eupl fair fsfap ftl gfdl gpl hpnd icu ijg imagemagick intel ipa ipl isc json lgpl lgpllr libpng
libtiff lpl lppl mit mit-0 mit-modern-variant mpl ms-pl ms-rl mulanpsl multics ncsa netcdf ngpl nokia nosl npl ntp o-uda odbl odc-by
ofl ogc ogl-uk oldap openssl opubl osl pddl php pixar postgresql psf python qhull qpl rpl rpsl ruby sax-pd sendmail sgi-b sissl sleepycat
spl sspl tcl tcp-wrappers tmate ucl unicode unicode-dfs unlicense upl vim vsl w3c watcom wtfpl x11 xerox xnet zend zlib zpl
""".split()
_VERSION = r"(?:-\d+(?:\.\d+)*[a-z]?|-clause|-only|-or-later|-clear|-patent|-attribution|-invariants|-no-invariants|-no-copyleft-exception|-[a-z]{2}|\+)*"
_IDENTIFIER = re.compile(f"(?:{'|'.join(map(re.escape, sorted(STEMS, key=len, reverse=True)))}){_VERSION}|(?:documentref-[a-z0-9.\\-]+:)?licenseref-[a-z0-9.\\-]+|none|noassertion")
_EXCEPTION = re.compile(r"[a-z0-9.+\-]*(?:exception|additional-terms|linking)[a-z0-9.+\-]*|(?:documentref-[a-z0-9.\-]+:)?additionref-[a-z0-9.\-]+|llvm-exception|qt-gpl-exception.*")


def label_of(identifier: str) -> str:
    """The family label of an identifier: gpl-3.0-or-later gives gpl, apache-2.0 gives apache-2."""
    for family in ("agpl", "lgpl", "gpl", "apache-2", "mpl", "cc-by-nc", "cc-by-sa", "cc-by", "cc0", "bsd", "isc", "mit"):
        if identifier == family or identifier.startswith((f"{family}-", f"{family}.", f"{family}+")):
            return family
    return identifier


def evaluate(expression: str) -> tuple[float, list[str]] | None:
    """Score and labels of a licence expression; None if it starts with none.

    `or` lets the reader choose (the freer side), `and` binds both (the stricter side), `with` adds an exception to a licence.
    Reading stops where the expression stops being well formed, or at a word that is neither an identifier of the list, a reference
    (licenseref-...), none nor noassertion (behind `with`: an exception), so text behind it does no harm.
    """
    output: list[tuple[float, list[str]]] = []
    pending: list[str] = []

    def reduce() -> None:
        op, right, left = pending.pop(), output.pop(), output.pop()
        if op == "with":
            output.append((min(1.0, left[0] + EXCEPTION_GAIN), left[1]))
        else:
            output.append(((max if op == "or" else min)(left[0], right[0]), left[1] + right[1]))

    operand = True  # what must come next
    depth = 0
    at = 0
    while at < len(expression):
        if expression[at].isspace():
            at += 1
            continue
        m = _TOKEN.match(expression, at)
        if not m:
            break
        token, at = m.group(), m.end()
        if operand and token == "(":
            pending.append(token)
            depth += 1
        elif operand and token not in _RANK and token != ")":
            token = token.rstrip(".:-")
            if not (_EXCEPTION if pending and pending[-1] == "with" else _IDENTIFIER).fullmatch(token):
                break
            output.append((FREEDOM.get(label_of(token), UNKNOWN), [label_of(token)]))
            operand = False
        elif not operand and token == ")" and depth:
            while pending[-1] != "(":
                reduce()
            pending.pop()
            depth -= 1
        elif not operand and token in _RANK:
            while pending and pending[-1] != "(" and _RANK[pending[-1]] >= _RANK[token]:
                reduce()
            pending.append(token)
            operand = True
        else:
            break
    if operand and pending and pending[-1] in _RANK:
        pending.pop()  # an operator without a right side
    while pending:
        if pending[-1] == "(":
            pending.pop()
        elif len(output) >= 2:
            reduce()
        else:
            pending.pop()
    return output[-1] if output else None


def expression_at(text: bytes, start: int, end: int) -> str:
    """The expression behind a tag: its line and, while a parenthesis is open, the next ones without their comment marks."""
    m = _LINE.match(text, start, end)
    parts = [m.group()]
    depth = parts[0].count(b"(") - parts[0].count(b")")
    while depth > 0 and m.end() < end:
        m = _LINE.match(text, _COMMENT.match(text, m.end(), end).end(), end)
        parts.append(m.group())
        depth += parts[-1].count(b"(") - parts[-1].count(b")")
    return b" ".join(parts).decode("utf-8", "replace")


def _automaton():
    state = worker_state()
    if "licenses" not in state:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for phrase in {**BASE_PHRASES, **OWN_PHRASES, TAG: ""}:
            machine.add_word(f" {phrase} ", phrase)
        machine.make_automaton()
        state["licenses"] = machine
    return state["licenses"]


def scan(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a text in UTF-8."""
    words = text.translate(_WORDS).split()
    joined = f" {b' '.join(words).decode('utf-8', 'surrogateescape')} "
    places: list[int] = []
    base: set[str] = set()
    own: set[str] = set()
    tagged = False
    for end, phrase in _automaton().iter(joined):
        if phrase in BASE_PHRASES:
            places.append(end - len(phrase) - 1)
            base.add(BASE_PHRASES[phrase])
        elif phrase == TAG:
            tagged = True
        else:
            own.add(OWN_PHRASES[phrase])
    labels, scores = base | own, [FREEDOM.get(x, UNKNOWN) for x in base | own]
    if tagged:
        lowered = text.lower()
        tags = list(_TAGGED.finditer(lowered))
        for m, following in zip(tags, [*[x.start() for x in tags[1:]], len(text)], strict=True):
            if found := evaluate(expression_at(lowered, m.end(), following)):
                scores.append(found[0])
                labels |= set(found[1])
    first = joined.count(" ", 0, min(places)) if places else None
    last = joined.count(" ", 0, max(places)) if places else None
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), min(scores, default=0.0)


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: word count, places of the base phrases, labels and a score.

    score: the least freedom among all that was found, 0 to 1; 0 for a document without any licence. A null or empty text has
    0 words, no labels and score 0; an empty table gives an empty one. Texts are read whole, in time linear in their length. Phrases
    that overlap all count. Repeated rows give repeated results; columns besides doc_id and text are ignored.
    """
    kind = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches):
            raw = data.tobytes()
            rows = [scan(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield table_rows({"doc_id": part.column(0)} | dict(zip(kind.names[1:], zip(*rows, strict=True), strict=True)), kind)

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, SCHEMA)
