"""Suffix-array dedup by a depth-limited radix sort.

Byte strings of the threshold length that also start earlier (smaller doc_id, or the same document further left) are
removed. Suffixes are sorted only as deep as the threshold. The first digit is the suffix's minimiser, dealt out over
the cluster; suffixes alone under theirs go (see _repeats). In the tasks the most-significant-digit passes go over the
bytes themselves, eight at a time, dropping every suffix that is alone in its group. What is still together after the
threshold's last byte are exactly the repeated windows, and each takes the first place of its group.

Defined cases: null text reads as empty; a text shorter than the threshold loses nothing; a very long text is cut into
pieces of its own minimisers like any other, and no task but the reading and the writing one holds it whole; repeated
rows (same doc_id and text) are one document at one place, so the result of each is that of one row; rows that share a
doc_id but not a text are one document, too, and keep their own bytes; of equal windows the one first by (doc_id, start)
stays, which leaves no ties; a null doc_id takes no part and keeps its bytes; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _repeats as R
from ._bytes import Block, in_chunks, tidy
from ._common import columns


def radix_groups(data: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into at, group) of the suffixes that share their first depth bytes with another one of their group."""
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    digit = np.zeros(len(data), np.uint64)
    for k in range(8):
        digit = digit << np.uint64(8) | padded[k : k + len(data)]
    index = np.arange(len(at))
    for d in range(0, depth, 8):
        value = digit[at[index] + d]
        if depth - d < 8:
            value = value >> np.uint64(8 * (8 - (depth - d)))
        order = np.lexsort((value, group))
        index, group, value = index[order], group[order], value[order]
        new = np.ones(len(index) + 1, bool)
        new[1:-1] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
        group = np.cumsum(new[:-1])
        several = ~(new[:-1] & new[1:])
        index, group = index[several], group[several]
        if not len(index):
            break
    return index, group


def repeated(table: pa.Table, depth: int) -> Iterator[pa.RecordBatch]:
    """The windows of these forms that start before the last place of their form, as runs with their first places."""
    keys, pids, n, docs, starts, last_doc, last_start, pieces = R.merged(table)
    block = Block(pieces)
    row, step = np.repeat(np.arange(len(n)), n), R.steps(n)
    first_doc, first_start = docs[row], starts[row] + step  # of a window that no other form has
    index, group = radix_groups(block.data, block.first[row] + step, np.unique(keys, return_inverse=True)[1][row], depth)
    order = np.lexsort((first_start[index], first_doc[index], group))
    index, group = index[order], group[order]
    head = np.ones(len(group), bool)
    head[1:] = group[1:] != group[:-1]
    lead = index[np.maximum.accumulate(np.where(head, np.arange(len(group)), 0))]
    first_doc[index], first_start[index] = first_doc[lead], first_start[lead]
    earlier = (first_doc < last_doc[row]) | ((first_doc == last_doc[row]) & (first_start < last_start[row] + step))
    row, step = row[earlier], step[earlier]
    if len(row):
        yield R.runs_batch(keys[row], pids[row], step, first_doc[earlier], first_start[earlier])


def remove_repeats(docs: DataFrame, threshold: int = 100, gram: int = 32, shard_bytes: int = 64 << 10, split_rows: int = 20_000) -> DataFrame:
    """(doc_id, n_bytes, spans array of removed (start, end) runs of bytes, kept binary).

    shard_bytes: bytes that are sorted at once; split_rows: forms of one minimiser beyond which they are dealt out by
    whole windows.
    """
    docs = columns(docs, "doc_id", "text")
    cut = lambda piece, n: [piece[j : j + threshold] for j in range(n)]
    judged = R.repeated_runs(docs, R.byte_units, threshold, gram, lambda t: repeated(t, threshold), cut, True, shard_bytes, split_rows)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            runs = R.run_arrays(batch.column("runs"))
            for begin, texts in in_chunks(batch.column("text")):
                sizes, kept, spans = [], [], []
                for i, text in enumerate(texts):
                    s, n = runs(begin + i)
                    gone = R.cover(s, n + threshold - 1, len(text))
                    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist()
                    spans.append([{"start": a, "end": b} for a, b in edge])
                    kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes() if edge else text)
                    sizes.append(len(text))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, len(texts)), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "spans", "kept"],
                )

    return judged.mapInArrow(tidy(finish), "doc_id long, n_bytes long, spans array<struct<start: int, end: int>>, kept binary")
