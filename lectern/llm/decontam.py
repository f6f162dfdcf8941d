"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item leaks into a text that contains at least percent of the item's distinct five-word shingles. Items are
partitioned by set size, and each is represented by its bottom-k MinHash sketch, with k one more than the shingles that
may be missing: a text that contains enough of the item holds one of the k at least, so no leak escapes the index
however long the text is (a MinHash of the whole text would be blind to a short item within it). Texts below a
partition's size skip it. Candidates are verified by exact containment of the words themselves.

The benchmark is indexed in blocks of bounded size, each sent to all tasks and streamed over all texts; nothing grows
with the corpus but the matches.

Defined cases: null, empty or white-space texts and items match nothing; an item with fewer than five words is one
shingle, its whole sequence, and matches texts that consist of it; repeated rows match each on their own; rows without
doc_id or item_id take no part; a very long text is searched whole; containment of exactly percent counts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import exact_shingles, in_chunks, mix, shingle_sets, tidy
from ._common import columns, shared


class ContainmentIndex:
    """Partitions by size: sorted sketch tokens with the items they stand for; full sets for the verification."""

    def __init__(self, item_ids: list[int], texts: list[bytes], shingle: int, percent: int) -> None:
        self.ids, self.texts, self.shingle, self.percent = item_ids, texts, shingle, percent
        owner, tokens = shingle_sets(texts, shingle)
        at = np.searchsorted(owner, np.arange(len(texts) + 1))
        self.sets = [tokens[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        n = np.diff(at)
        self.need = -(-percent * n // 100)
        order = np.lexsort((mix(tokens), owner))
        sketch = np.arange(len(tokens)) - at[owner] < (n - self.need + 1)[owner]
        token, item = tokens[order][sketch], owner[sketch]
        self.parts = []
        for c in np.unique(np.log2(n[item]).astype(int)):
            own = np.log2(n[item]).astype(int) == c
            by = np.argsort(token[own], kind="stable")
            self.parts.append((int(self.need[item[own]].min()), token[own][by], item[own][by]))

    def candidates(self, owner: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Distinct (text, item) with a common sketch token."""
        found = []
        for least, sketch, item in self.parts:
            large = sizes[owner] >= least
            own, tok = owner[large], tokens[large]
            low, high = np.searchsorted(sketch, tok), np.searchsorted(sketch, tok, "right")
            hit = np.flatnonzero(high > low)
            count = (high - low)[hit]
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            found.append(np.stack((np.repeat(own[hit], count), item[np.repeat(low[hit], count) + step]), 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def matches(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item_id, item's shingles, of these in the text)."""
        owner, tokens = shingle_sets(texts, self.shingle)
        at = np.searchsorted(owner, np.arange(len(texts) + 1))
        exact: tuple[int, set] = (-1, set())
        for i, j in self.candidates(owner, tokens, np.diff(at)).tolist():
            if np.isin(self.sets[j], tokens[at[i] : at[i + 1]], assume_unique=True).sum() < self.need[j]:
                continue
            if exact[0] != i:
                exact = (i, exact_shingles(texts[i], self.shingle))
            item = exact_shingles(self.texts[j], self.shingle)
            common = len(item & exact[1])
            if 100 * common >= self.percent * len(item):
                yield i, self.ids[j], len(item), common


def find_leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, percent: int = 75, block_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every text and item of enough containment."""
    spark = docs.sparkSession
    docs = columns(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    items = columns(benchmark, "item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    blocks = 1 + int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes

    def scan(block: int) -> DataFrame:
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        index = shared(spark, ContainmentIndex([r["item_id"] for r in rows], [r["text"].encode() for r in rows], shingle, percent))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = index()
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for begin, texts in in_chunks(batch.column("text")):
                    found = [(ids[begin + i], item, n, common, common / n) for i, item, n, common in held.matches(texts)]
                    if found:
                        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)], ["doc_id", "item_id", "n_item", "n_shared", "containment"])

        return docs.mapInArrow(tidy(run), "doc_id long, item_id long, n_item long, n_shared long, containment double")

    return reduce(DataFrame.unionByName, map(scan, range(blocks)))


ORACLE = r"""
WITH w AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
l AS (SELECT side, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM w),
g AS (SELECT side, id, list_distinct(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [list_aggregate(l, 'string_agg', ' ')]
      ELSE list_transform(range(1, len(l) - 3), lambda i: list_aggregate(l[i:i + 4], 'string_agg', ' ')) END) AS s FROM l),
d AS (SELECT id AS doc_id, unnest(s) AS t FROM g WHERE side = 0),
b AS (SELECT id AS item_id, len(s)::BIGINT AS n_item, unnest(s) AS t FROM g WHERE side = 1)
SELECT doc_id, item_id, n_item, count(*)::BIGINT AS n_shared, count(*) / n_item::DOUBLE AS containment
FROM d JOIN b ON d.t = b.t GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 75 * n_item
"""
