"""The lexer and the parser as table functions for SQL.

    register(spark)
    SELECT d.doc_id, n.* FROM documents d, LATERAL tex_nodes(d.text) n
    SELECT d.doc_id, t.* FROM documents d, LATERAL tex_tokens(d.text, 'strict') t
    SELECT * FROM paper_nodes(TABLE(files) PARTITION BY doc_id ORDER BY place)

tex_nodes and tex_tokens give what ast_nodes and tokens of operators.latex give for one text, in mode intended or strict.
paper_nodes puts the texts of a partition together, in its order, a line break between, and parses them as one: a paper
whose parts are rows. Rows travel in Arrow batches.

Defined cases: a null text reads as empty and gives the root alone; so does a text that the parser fails on, with the error
in its row; an unknown mode is an error; a partition's null texts are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from . import latex

_TOKENS = latex.TOKEN_SCHEMA.partition(", ")[2]  # without doc_id
_NODES = latex.NODE_SCHEMA.partition(", ")[2]


def _strict(mode: str | None) -> bool:
    if mode not in ("intended", "strict"):
        raise ValueError("the mode must be intended or strict")
    return mode == "strict"


class TexTokens:
    def eval(self, text: str, mode: str = "intended") -> Iterator[tuple]:
        yield from latex.token_rows(text or "", _strict(mode))


class TexNodes:
    def eval(self, text: str, mode: str = "intended") -> Iterator[tuple]:
        yield from latex.node_rows(text or "", _strict(mode))


class PaperNodes:
    """State of one partition: its texts so far, and the doc_id of its rows."""

    def __init__(self) -> None:
        self.doc_id, self.texts = None, []

    def eval(self, row: Row) -> None:
        self.doc_id = str(row["doc_id"]) if row["doc_id"] is not None else None
        if row["text"] is not None:
            self.texts.append(row["text"])

    def terminate(self) -> Iterator[tuple]:
        for node in latex.node_rows("\n".join(self.texts), False):
            yield (self.doc_id, *node)


def register(spark: SparkSession) -> None:
    for name, handler, schema in (("tex_tokens", TexTokens, _TOKENS), ("tex_nodes", TexNodes, _NODES), ("paper_nodes", PaperNodes, latex.NODE_SCHEMA)):
        spark.udtf.register(name, udtf(handler, returnType=schema, useArrow=True))
