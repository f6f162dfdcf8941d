"""Substring dedup by repeated-phrase automata.

Windows of consecutive words that also start in a document with a smaller doc_id are removed. Passages that may recur
are dealt out by content to shards (see _repeats). Each shard confirms the phrases, a window's words each, that occur in
more than one document, compiles them into an Aho-Corasick automaton over words, and streams every distinct passage that
any document has there through it, which locates all occurrences. A document meets the automata of its own content only,
so the work grows with the corpus and not with shards times documents.

Defined cases: null or empty text has no words, nothing is removed and the kept text is empty; a text shorter than the
window keeps all its words; a very long text is cut into pieces of its own minimisers like any other, and no task but
the reading and the writing one holds it whole; repeated rows (same doc_id and text) get the same result each and don't
count as earlier, nor do other rows of the same doc_id, which are judged each on its own text; ties can't occur, as only
the smallest doc_id with a phrase matters; a null doc_id takes no part and keeps its words; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _repeats as R
from ._bytes import Block, in_chunks, run_hashes, tidy, window_hashes
from ._common import columns


def locate(table: pa.Table, window: int) -> Iterator[pa.RecordBatch]:
    """One shard: confirm, compile, stream; the windows that start first in a document before the last that has the form.

    A phrase is confirmed by the hashes of its words, of which the shard has two windows at least, or one in a passage of
    several documents. Where phrases occur, and in which document first, is what the automaton finds in the passages.
    """
    import ahocorasick

    keys, pids, counts, docs, _, last, _, pieces = R.merged(table)
    joined = b"\n".join([*pieces, b""])
    data = np.frombuffer(joined, np.uint8)
    ends = np.flatnonzero((data == 32) | (data == 10))  # of words; passages have single spaces between them
    starts = np.concatenate(([0], ends[:-1] + 1))
    edge = np.concatenate(([0], np.flatnonzero(data[ends] == 10) + 1))  # words of each passage
    row = np.repeat(np.arange(len(counts)), counts)
    at = edge[:-1][row] + R.steps(counts)
    hashes = window_hashes(run_hashes(data, starts, ends), window)[at]
    _, phrase, several = np.unique(hashes, return_inverse=True, return_counts=True)
    confirmed = at[(several[phrase] > 1) | (docs < last)[row]]
    if not len(confirmed):
        return
    words: dict[bytes, int] = {}
    ids = tuple([words.setdefault(w, len(words)) for w in joined.split()])
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for k, a in enumerate(confirmed.tolist()):
        automaton.add_word(ids[a : a + window], k)  # equal phrases are one, with the number that comes last
    automaton.make_automaton()
    found = [(i, end, k) for i, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)) for end, k in automaton.iter(ids[a:b])]
    form, end, phrase = np.array(found, np.int64).reshape(-1, 3).T
    first = np.full(len(confirmed), np.iinfo(np.int64).max)
    np.minimum.at(first, phrase, docs[form])
    early = first[phrase]
    some = early < last[form]
    form = form[some]
    if len(form):
        yield R.runs_batch(keys[form], pids[form], end[some] - window + 1, early[some], None)


def cut(piece: bytes, n: int, window: int) -> list[bytes]:
    words = piece.split(b" ")
    return [b" ".join(words[j : j + window]) for j in range(n)]


def remove_repeats(docs: DataFrame, window: int = 13, gram: int = 5, shard_bytes: int = 64 << 10, split_rows: int = 20_000) -> DataFrame:
    """(doc_id, n_words, removed array<boolean> or null where nothing goes, kept string).

    shard_bytes: passages in an automaton's shard; split_rows: forms of one minimiser beyond which they are dealt out by
    whole windows.
    """
    docs = columns(docs, "doc_id", "text")
    judged = R.repeated_runs(docs, R.word_units, window, gram, lambda t: locate(t, window), lambda p, n: cut(p, n, window), False, shard_bytes, split_rows)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = R.run_arrays(batch.column("runs"))
            for begin, texts in in_chunks(batch.column("text")):
                block = Block(texts)
                starts, ends = block.words()
                owner = np.searchsorted(starts, np.append(block.first, len(block.data)))
                data = block.data.tobytes()
                n_words, kept, flags = [], [], []
                for i in range(len(texts)):
                    a, b = owner[i], owner[i + 1]
                    s, n = runs(begin + i)
                    gone = R.cover(s, n + window - 1, b - a)
                    own = ~gone
                    kept.append(b" ".join([data[x:y] for x, y in zip(starts[a:b][own].tolist(), ends[a:b][own].tolist(), strict=True)]))
                    n_words.append(b - a)
                    flags.append(gone if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, len(texts)), pa.array(n_words, pa.int64()), pa.array(flags, pa.list_(pa.bool_())), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "removed", "kept"],
                )

    return judged.mapInArrow(tidy(finish), "doc_id long, n_words long, removed array<boolean>, kept string")


ORACLE = r"""
WITH l AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
p AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM l),
s AS (SELECT doc_id, i, string_agg(word, ' ') OVER w AS seq, count(*) OVER w AS n FROM p
      WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
f AS (SELECT seq, min(doc_id) AS first_doc FROM s WHERE n = 13 GROUP BY seq),
h AS (SELECT s.doc_id, s.i FROM s JOIN f ON s.seq = f.seq WHERE s.n = 13 AND f.first_doc < s.doc_id),
g AS (SELECT DISTINCT doc_id, i + k AS i FROM h, range(0, 13) AS t(k)),
m AS (SELECT p.*, g.i IS NOT NULL AS gone FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.i = g.i)
SELECT l.doc_id, len(l.l)::BIGINT AS n_words, count(*) FILTER (WHERE m.gone)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.i) FILTER (WHERE NOT m.gone), '')) AS kept_sha256
FROM l LEFT JOIN m ON m.doc_id = l.doc_id GROUP BY l.doc_id, len(l.l)
"""
