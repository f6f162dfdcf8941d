"""LaTeX to tokens and syntax nodes: one Arrow pass per text, rows out.

mode="strict" keeps the quirks of the data model's origin: a command is always shown as `\\name [opt] {req}`, `$` opens
math only where a token starts, a backslash before another character is a command of its own, and nodes lie flat under
the root. mode="intended" reads LaTeX as it is meant: escapes, starred commands, `$` anywhere, nested environments and
sections, and nodes of their own for labels, references, citations, authors and affiliations.

NUL characters are dropped before lexing. A null text has no tokens and a root without children; a text that fails
becomes one row with its error, and the job goes on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

TOKEN_SCHEMA = "doc_id string, ord int, type string, value string, position long, cmd string, opt string, req string"
NODE_SCHEMA = "doc_id string, node_id int, parent_id int, ord int, depth int, type string, content string, position long, state string, cmd string, opt string, req string, error string"

#: What may start a token; white space and comments give none.
STRICT_SCAN = re.compile(rb"(?P<space>[ \t-\r]+)|(?P<comment>%[^\n]*)|(?P<shift>\$\$?)|(?P<command>\\[A-Za-z]+)|(?P<stray>\\)|(?P<open>\{)|(?P<close>\})|(?P<text>[^\\{}%]+)")
FREE_SCAN = re.compile(rb"(?P<comment>%[^\n]*\n?)|(?P<shift>\$\$?)|(?P<command>\\[A-Za-z]+\*?)|(?P<break>\\\\)|(?P<open>\{)|(?P<close>\})|(?P<text>(?:[^\\{}%$]|\\[^A-Za-z\\])+)|(?P<stray>\\)")
ESCAPE = re.compile(rb"\\([^A-Za-z\\])")
SIMPLE = {"shift": "MathShift", "open": "OpenBrace", "close": "CloseBrace", "text": "Text", "stray": "Command", "break": "Command"}


class Token(NamedTuple):
    type: str
    value: str
    position: int
    cmd: str | None = None
    opt: str | None = None
    req: str | None = None


def _inside(text: bytes, at: int, brackets: re.Pattern[bytes]) -> tuple[bytes, int]:
    """Contents of the bracket that opens at `at`, and the place after it; the rest of the text if it never closes."""
    depth = 0
    for m in brackets.finditer(text, at):
        depth += 1 if m.group() in b"[{" else -1
        if depth == 0:
            return text[at + 1 : m.start()], m.end()
    return text[at + 1 :], len(text)


SQUARE, CURLY = re.compile(rb"[\[\]]"), re.compile(rb"[{}]")


def _say(b: bytes) -> str:
    return b.decode("utf-8", "replace")


def lex(text: str, strict: bool) -> list[Token]:
    """All tokens with byte positions; the end of the text gives none."""
    data = text.replace("\0", "").encode()
    scan = STRICT_SCAN if strict else FREE_SCAN
    out: list[Token] = []
    at = 0
    while at < len(data):
        m = scan.match(data, at)
        kind, raw, at = m.lastgroup, m.group(), m.end()
        if kind in ("space", "comment"):
            continue
        if kind != "command":
            value = _say(ESCAPE.sub(rb"\1", raw) if kind == "text" and not strict else raw)
            if strict or value.strip() or kind != "text":
                out.append(Token(SIMPLE[kind], value, m.start()))
            continue
        opt = req = None
        if data[at : at + 1] == b"[":
            opt, at = _inside(data, at, SQUARE)
        if data[at : at + 1] == b"{":
            req, at = _inside(data, at, CURLY)
        name = raw.rstrip(b"*")
        shown = b"%s [%s] {%s}" % (raw, opt or b"", req or b"")
        kind = {b"\\begin": "BeginEnvironment", b"\\end": "EndEnvironment"}.get(name, "Command") if not strict else "Command"
        out.append(Token(kind, _say(shown if strict else data[m.start() : at]), m.start(), _say(name[1:]), None if opt is None else _say(opt), None if req is None else _say(req)))
    return out


class Node(NamedTuple):
    parent: int
    depth: int
    type: str
    content: str
    position: int
    state: str = "DefaultState"
    cmd: str | None = None
    opt: str | None = None
    req: str | None = None


ROOT = Node(-1, 0, "Document", "Document Root", 0)


def _math_end(tokens: list[Token], at: int) -> int:
    """Index of the shift that ends the math opened at `at`, or the number of tokens."""
    return next((k for k in range(at + 1, len(tokens)) if tokens[k].type == "MathShift" and tokens[k].value == tokens[at].value), len(tokens))


def parse_flat(tokens: list[Token]) -> list[Node]:
    """Commands, texts and math under the root; braces outside math give nothing."""
    nodes, at = [ROOT], 0
    while at < len(tokens):
        t = tokens[at]
        if t.type == "MathShift":
            end = _math_end(tokens, at)
            closed = end < len(tokens)
            nodes.append(Node(0, 1, "Math", "".join(x.value for x in tokens[at + 1 : end]), t.position, "DefaultState" if closed else "MathModeState"))
            at = end
        elif t.type in ("Command", "Text"):
            nodes.append(Node(0, 1, t.type, t.value, t.position, "DefaultState", t.cmd, t.opt, t.req))
        at += 1
    return nodes


#: Environments whose node isn't called Environment.
ENVIRONMENT_TYPES = {"abstract": "Abstract", "thebibliography": "Bibliography", "equation": "Math", "align": "Math", "gather": "Math", "displaymath": "Math", "math": "Math"}
COMMAND_TYPES = {c: "Citation" for c in ("cite", "citep", "citet", "citeyear", "citeauthor", "bibitem")} | {"label": "Label", "author": "Author", "affiliation": "Affiliation", "institute": "Affiliation"} | {c: "Reference" for c in ("ref", "eqref", "pageref", "autoref", "cref")}


def parse_nested(tokens: list[Token]) -> list[Node]:
    """Sections by level and environments by begin and end, nodes in reading order."""
    nodes = [ROOT]
    stack: list[tuple[int, str, float]] = [(0, "", -1.0)]  # node, environment's name, section's level

    def add(kind: str, t: Token, content: str) -> int:
        nodes.append(Node(stack[-1][0], len(stack), kind, content, t.position, "DefaultState", t.cmd, t.opt, t.req))
        return len(nodes) - 1

    at = 0
    while at < len(tokens):
        t = tokens[at]
        if t.type == "MathShift":
            end = _math_end(tokens, at)
            add("Math", t, "".join(x.value for x in tokens[at + 1 : end]).strip())
            at = end
        elif t.type == "BeginEnvironment":
            name = (t.req or "").rstrip("*")
            kind = ENVIRONMENT_TYPES.get(name, "Environment")
            if kind == "Math":
                end = next((k for k in range(at + 1, len(tokens)) if tokens[k].type == "EndEnvironment" and tokens[k].req == t.req), len(tokens))
                add(kind, t, " ".join(x.value for x in tokens[at + 1 : end]).strip())
                at = end
            else:
                stack.append((add(kind, t, name), t.req or "", 99.0))
        elif t.type == "EndEnvironment":
            place = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][1] == t.req), None)
            if place is not None:
                del stack[place:]
        elif t.type == "Text":
            add("Text", t, t.value)
        elif t.type == "Command" and t.cmd in fixed.SECTION_LEVELS:
            level = float(fixed.SECTION_LEVELS[t.cmd])
            while len(stack) > 1 and not stack[-1][1] and stack[-1][2] >= level:
                stack.pop()
            stack.append((add("Section", t, t.req or ""), "", level))
        elif t.type == "Command":
            kind = COMMAND_TYPES.get(t.cmd or "", "Command")
            add(kind, t, t.value if kind == "Command" else (t.req or ""))
        at += 1
    return nodes


def _rows(docs: DataFrame, make, schema: str) -> DataFrame:
    """A row for each tuple that make(text) gives, behind doc_id and a running number."""
    arrow = docs.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows += [(doc, *r) for r in make(text or "")]
                if len(rows) > 20_000:
                    yield _batch(rows, target)
                    rows = []
            if rows:
                yield _batch(rows, target)

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)


def token_rows(text: str, strict: bool) -> list[tuple]:
    return [(k, *t) for k, t in enumerate(lex(text, strict))]


def node_rows(text: str, strict: bool) -> list[tuple]:
    try:
        nodes = (parse_flat if strict else parse_nested)(lex(text, strict))
        return [(k, n.parent if k else None, k, *n[1:], None) for k, n in enumerate(nodes)]
    except Exception as error:  # noqa: BLE001 - one bad text must not end the job
        return [(0, None, 0, *ROOT[1:], str(error))]


def tokens(docs: DataFrame, mode: str = "intended") -> DataFrame:
    """(doc_id, ord, type, value, position, cmd, opt, req) of (doc_id, text)."""
    return _rows(docs, lambda text: token_rows(text, mode == "strict"), TOKEN_SCHEMA)


def ast_nodes(docs: DataFrame, mode: str = "intended") -> DataFrame:
    """Syntax nodes of (doc_id, text) in reading order; node 0 is the root."""
    return _rows(docs, lambda text: node_rows(text, mode == "strict"), NODE_SCHEMA)
