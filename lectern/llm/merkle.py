"""A Merkle manifest of a dataset: every row a leaf, every source a subroot, one root, and each row's proof.

A leaf is the SHA-256 of a row's fields, each with its length before it. Within a source leaves stand by doc_id; while
more than one node is left, each run of ARITY consecutive ones becomes the hash of their digests. The subroots, by source,
likewise give the root. A row's proof is what its run has beside it, level by level up to the root, left to right: from it
and the row alone the root can be computed again, which a changed row fails to give.

No tree is built in one place. Leaves get their places from ranges of (source, doc_id); each ARITY ** levels consecutive
ones are one block, an ordered array that sequence, transform, slice and aggregate collapse by some levels; the blocks'
roots are the leaves of the next pass, until every tree has one node. Then the siblings go back down, pass by pass: a
block's rows share what stands above the block. So a task holds blocks of fixed size, whatever a source's share of the
rows is, and the number of passes is the logarithm of the largest source.

Defined cases: a null field is a dash, an empty one "0:"; a null doc_id stands first in its source and isn't tampered
with, a null source before all others; equal doc_ids stand by their leaves, and repeated rows have equal leaves, whose
places (and with them proofs) are dealt to them in any order; a very long text is hashed whole and never moved; an empty
table gives no row; other columns are no part of a leaf, whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import columns, written

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text that a check of the proofs is to fail on: of one doc_id in five, with A-Z in lower case."""
    chosen = F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
    return F.when(chosen, F.translate(text, UPPER, LOWER)).otherwise(text)


def leaves(docs: DataFrame, tamper: Column | None = None) -> DataFrame:
    """(doc_id, source, leaf, changed): changed is the leaf of the row with tamper in place of its text."""
    head = [field(F.col(c)) for c in FIELDS[:-1]]
    tamper = F.col("text") if tamper is None else tamper
    leaf = digest(*head, field(F.col("text")))
    return docs.select("doc_id", "source", leaf.alias("leaf"), F.when(tamper.eqNullSafe(F.col("text")), leaf).otherwise(digest(*head, field(tamper))).alias("changed"))


def placed(nodes: DataFrame, tree: str, *by: str) -> DataFrame:
    """nodes with place, from 0 within their tree in the order by, and left, the number of nodes in the tree.

    Ranges are written, so that they stay as they are; a row's place is its number within its range, and the rows that
    its tree has in the ranges before. That is one row for each tree and range.
    """
    order = [F.col(c).asc_nulls_first() for c in (tree, *by, "_tie")]  # equal rows may be dealt to several ranges
    ranged = nodes.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    ranged = written(ranged.withColumn("_range", F.spark_partition_id()).withColumn("_number", F.monotonically_increasing_id()), "places")
    sizes = ranged.groupBy(tree, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_number").alias("_first"))
    own = Window.partitionBy(tree)
    before = F.coalesce(F.sum("_n").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(tree).alias("_tree"), F.col("_range").alias("_own"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("left"))
    joined = ranged.join(starts, (ranged["_range"] == starts["_own"]) & ranged[tree].eqNullSafe(starts["_tree"]))
    return joined.withColumn("place", F.col("_number") + F.col("_shift")).drop("_range", "_number", "_tree", "_own", "_shift")


def run_of(level: Column, i: Column) -> Column:
    """The i-th run of a level's nodes, joined."""
    return F.array_join(F.slice(level, (i * ARITY + 1).cast("int"), ARITY), "")


def collapsed(level: Column) -> Column:
    """The next level up."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.sha2(run_of(level, i), 256))


def siblings(level: Column, i: Column) -> Column:
    """(l, r): what stands to the left and to the right of node i in its run."""
    first = F.floor(i / ARITY).cast("int") * ARITY
    left = F.array_join(F.slice(level, first + 1, i.cast("int") - first), "")
    right = F.array_join(F.slice(level, i.cast("int") + 2, first + ARITY - 1 - i.cast("int")), "")
    return F.struct(left.alias("l"), right.alias("r"))


class Forest:
    """The trees over nodes (tree, place, left, node and what else they carry), pass by pass from the leaves up."""

    def __init__(self, nodes: DataFrame, tree: str, levels: int) -> None:
        self.tree, self.levels, self.block = tree, levels, ARITY**levels
        self.passes: list[DataFrame] = []
        while True:
            blocks = written(self._blocks(nodes), "blocks")
            self.passes.append(blocks)
            tops = blocks.select(tree, F.col("block").alias("place"), F.col("top").alias("node"), F.ceil(F.col("left") / self.block).alias("left"))
            if blocks.where(F.col("left") > self.block).isEmpty():
                self.roots = tops.select(tree, F.col("node").alias("subroot"))
                return
            nodes = tops  # a tree that has its root goes on as a lone node, which is its own root

    def _blocks(self, nodes: DataFrame) -> DataFrame:
        own = [c for c in ("place", *nodes.columns) if c not in (self.tree, "left")]
        rows = nodes.withColumn("block", F.floor(F.col("place") / self.block))
        blocks = rows.groupBy(self.tree, "block").agg(F.min("left").alias("left"), F.array_sort(F.collect_list(F.struct(*dict.fromkeys(own)))).alias("rows"))
        blocks = blocks.withColumn("l0", F.col("rows")["node"])
        for k in range(1, self.levels + 1):  # a level less where the tree has its root already
            below = F.col(f"l{k - 1}")
            blocks = blocks.withColumn(f"l{k}", F.when(F.ceil(F.col("left") / ARITY ** (k - 1)) > 1, collapsed(below)).otherwise(below))
        return blocks.withColumn("top", F.col(f"l{self.levels}")[0])

    def _down(self, blocks: DataFrame, above: DataFrame | None, carried: list[str]) -> DataFrame:
        """(tree, place, carried, above): of every node of a pass, with the siblings from its own level up to the root."""
        i = F.col("_i")
        own = [F.when(F.ceil(F.col("left") / ARITY**k) > 1, siblings(F.col(f"l{k}"), F.floor(i / ARITY**k))) for k in range(self.levels)]
        if above is None:
            blocks = blocks.withColumn("above", F.expr("CAST(array() AS array<struct<l: string, r: string>>)"))
        else:
            above = above.select(F.col(self.tree).alias("_tree"), F.col("place").alias("_place"), "above")
            blocks = blocks.join(above, blocks[self.tree].eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_place")))
        kept = [self.tree, "left", "above", *(f"l{k}" for k in range(self.levels))]
        rows = blocks.select(*kept, F.posexplode("rows").alias("_i", "_row"))
        ups = F.filter(F.array(*own), lambda x: x.isNotNull())
        return rows.select(self.tree, F.col("_row")["place"].alias("place"), *[F.col("_row")[c].alias(c) for c in carried], F.concat(ups, F.col("above")).alias("above"))

    def proofs(self, tops: DataFrame | None = None) -> DataFrame:
        """(tree, place, carried, above) of the leaves; tops: (tree, place, above) of the trees' roots in a tree over them."""
        above = tops
        for blocks in reversed(self.passes):
            own = [c for c in blocks.schema["rows"].dataType.elementType.names if c != "place"]
            above = self._down(blocks, above, own)
        return above


def manifest(docs: DataFrame, tamper: Column | None = None, levels: int = 2) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, proof array<struct<l, r>>, changed, folded_root, verified) of every row.

    proof: the siblings to the left and to the right, from the leaf's run up to the root's; folded_root: the root that the
    row with tamper in place of its text gives with this proof. A block is ARITY ** levels nodes.
    """
    spark = docs.sparkSession
    rows = columns(docs, "doc_id", "source", "lang", "n_chars", "text")
    hashed = written(leaves(rows, tamper), "leaves")
    forest = Forest(placed(hashed, "source", "doc_id", "leaf").withColumnRenamed("leaf", "node"), "source", levels)
    subroots = forest.roots.withColumn("forest", F.lit(0)).withColumnRenamed("subroot", "node")
    top = Forest(placed(subroots, "forest", "source"), "forest", levels)
    # the root of a source's tree stands at place 0 of its last pass
    over = top.proofs().join(top.roots.withColumnRenamed("subroot", "root"), "forest")
    over = written(over.select("source", F.lit(0).cast("bigint").alias("place"), "above", F.col("node").alias("subroot"), "root"), "subroots")
    proofs = forest.proofs(over)
    named = over.select(F.col("source").alias("_source"), "subroot", "root")
    out = proofs.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    folded = F.aggregate("above", F.col("changed"), lambda acc, s: F.sha2(F.concat(s["l"], acc, s["r"]), 256))
    out = out.select("doc_id", "source", F.col("node").alias("leaf"), "subroot", "root", F.col("above").alias("proof"), "changed", folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(proof: Column) -> Column:
    """The hash of a proof's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["l"], s["r"])), ""), 256)


#: Trees of up to 16 ** 5 leaves, level by level as lists; the checksum bit by bit.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, lang, n_chars, text,
  CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1))))) END AS crc FROM documents),
t AS (SELECT *, CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM d),
h AS (SELECT *, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
  || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
  || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
  || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head FROM t),
l AS (SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
  sha256(head || CASE WHEN other IS NULL THEN '-' ELSE strlen(other) || ':' || other END) AS changed FROM h),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
s0 AS (SELECT source, list(leaf ORDER BY i) AS v0 FROM p GROUP BY source),
s1 AS (SELECT *, UP(v0) AS v1 FROM s0), s2 AS (SELECT *, UP(v1) AS v2 FROM s1), s3 AS (SELECT *, UP(v2) AS v3 FROM s2),
s4 AS (SELECT *, UP(v3) AS v4 FROM s3), s5 AS (SELECT *, UP(v4) AS v5 FROM s4),
s AS (SELECT *, v5[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS j FROM s5),
r0 AS (SELECT list(subroot ORDER BY j) AS w0 FROM s),
r1 AS (SELECT *, UP(w0) AS w1 FROM r0), r2 AS (SELECT *, UP(w1) AS w2 FROM r1), r3 AS (SELECT *, UP(w2) AS w3 FROM r2),
x AS (SELECT p.doc_id, p.leaf, p.changed, s.subroot, w3[1] AS root, list_concat(PAIRS_S, PAIRS_R) AS pairs
  FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source, r3),
y AS (SELECT *, list_reduce(list_prepend({'l': changed, 'r': ''}, list_filter(pairs, lambda q: q IS NOT NULL)), lambda a, q: {'l': sha256(q.l || a.l || q.r), 'r': ''}).l AS folded_root FROM x)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(pairs, lambda q: q IS NOT NULL), lambda q: q.l || q.r), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified FROM y
"""
for _v in ("v0", "v1", "v2", "v3", "v4", "w0", "w1", "w2"):
    ORACLE = ORACLE.replace(f"UP({_v})", f"CASE WHEN len({_v}) = 1 THEN {_v} ELSE list_transform(range(0, len({_v}), 16), lambda k: sha256(array_to_string({_v}[k + 1 : k + 16], ''))) END")


def _pairs(name: str, i: str, levels: int) -> str:
    one = "CASE WHEN len({v}) > 1 THEN {{'l': array_to_string({v}[{f} + 1 : {k}], ''), 'r': array_to_string({v}[{k} + 2 : {f} + 16], '')}} END"
    return "[" + ", ".join(one.format(v=f"{name}{n}", k=f"({i} // {16**n})", f=f"({i} // {16 ** (n + 1)} * 16)") for n in range(levels)) + "]"


ORACLE = ORACLE.replace("PAIRS_S", _pairs("v", "i", 5)).replace("PAIRS_R", _pairs("w", "j", 3))
