"""Cross-tokenizer alignment: which tokens of a byte-level and of a piece vocabulary cover the same bytes.

Both tokenizers read the same bytes (a space, and the text). The tokens of both are the nodes of a bipartite graph, with
an edge where two overlap; its connected components, found by union-find, are the smallest groups of tokens that cover the
same bytes, cut where a token of each ends. A component's members that end together are linked. How often an id pair is
linked is counted over the corpus, and every text is judged by the counts of its links.

No token of either vocabulary goes on over a space that follows something else than white space, so a text is cut there
into chunks, which are aligned once for each task and looked up after that (the table is dropped when it has table_bytes).

Of two tokens that end together one's bytes are the end of the other's, so the vocabularies alone bound the id pairs that
can be linked (324,297 for the public ones). Pairs are numbered by that list: tasks count into an array of its length,
the sums are one row a pair, and go to the driver and back to the tasks within this bound.

Defined cases: a text that is null or empty, or whose tokens' bytes aren't a space and the text (with U+2581 in it, say),
has no tokens: zeros, and no groups; a chunk of any length is aligned whole, a very long text chunk by chunk; texts of
repeated rows count each time, as do rows that share a doc_id; a null doc_id is aligned and counted like any other; pairs
with the highest count of their B id all are best; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import in_chunks, tidy
from ._common import columns, shared, written

CHUNK = re.compile(r"(?<=\S)(?= )")  # what \S leaves out holds all white space of both tokenizers
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups string, pair array<int>, times array<int>"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Vocabularies:
    """Both tokenizers from their files, the bytes of every token, and the list of pairs that can end together."""

    def __init__(self, byte_json: str, piece_model: bytes) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = json.loads(byte_json)
        if spec.get("normalizer") or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": spec["pre_tokenizer"].get("trim_offsets"), "use_regex": True}:
            raise ValueError("not a byte-level vocabulary whose words can be encoded alone")
        alphabet = byte_alphabet()
        special = {t["content"] for t in spec["added_tokens"]}
        self.a = {i: bytes(map(alphabet.__getitem__, t)) for t, i in spec["model"]["vocab"].items() if t not in special}
        model = proto.ModelProto()
        model.ParseFromString(piece_model)
        norm = model.normalizer_spec
        if norm.remove_extra_whitespaces or not norm.escape_whitespaces or norm.precompiled_charsmap or not norm.add_dummy_prefix:
            raise ValueError("the piece model rewrites white space; chunks can't be encoded alone")
        if any(re.search("[^▁]▁", p.piece) for p in model.pieces):
            raise ValueError("a piece goes on over a space; chunks can't be encoded alone")
        norm.add_dummy_prefix = False  # the space before a text is in its first chunk already
        kinds = proto.ModelProto.SentencePiece
        self.b = {i: bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace("▁", " ").encode() for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.BYTE, kinds.USER_DEFINED)}
        self.byte_json, self.piece_model, self.library = byte_json, model.SerializeToString(), sentencepiece.SentencePieceProcessor
        self.pair_a, self.pair_b = self._pairs()

    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All (A id, B id) of which one's bytes end with the other's, in order."""
        by_a, by_b = ({}, {})
        for found, tokens in ((by_a, self.a), (by_b, self.b)):
            for i, data in tokens.items():
                found.setdefault(data, []).append(i)
        found = {(i, j) for i, data in self.a.items() for k in range(len(data)) for j in by_b.get(data[k:], ())}
        found |= {(i, j) for j, data in self.b.items() for k in range(len(data)) for i in by_a.get(data[k:], ())}
        both = np.array(sorted(found), np.int64).reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()


def joined_groups(overlaps: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """The component of each of n nodes, as its smallest node: union-find over all edges at once.

    Each round hooks roots to the smallest root over an edge and halves every path until it is flat.
    """
    root = np.arange(n)
    a, b = overlaps
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low < high
        if not open_.any():
            return root
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]
    return root


def bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


class Table:
    """The chunks that a task has met, numbered, with their alignment: n_a (-1 where the bytes differ), n_b and n_groups of
    each, its groups, and its pairs, one chunk's after another's."""

    def __init__(self, vocabularies: Vocabularies, table_bytes: int) -> None:
        from tokenizers import Tokenizer

        self.limit = table_bytes
        self.byte_level = Tokenizer.from_str(vocabularies.byte_json)
        self.byte_level.encode_special_tokens = True  # their strings in a text are ordinary text
        self.processor = vocabularies.library(model_proto=vocabularies.piece_model)
        self.a, self.b = ([t.get(i, b"") for i in range(max(t) + 1)] for t in (vocabularies.a, vocabularies.b))
        self.size_a, self.size_b = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.a, self.b))
        self.width = int(vocabularies.pair_b.max()) + 1
        self.key = vocabularies.pair_a * self.width + vocabularies.pair_b
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.n_a, self.n_b, self.n_groups, self.pairs, self.end = array("i"), array("i"), array("i"), array("i"), array("q", [0])
        self.groups: list[str] = []
        self.bytes = 0

    def learn(self, texts: list[list[str]]) -> None:
        """Align the chunks that aren't in the table yet."""
        if self.bytes > self.limit:
            self.clear()
        new = list({c for own in texts for c in set(own).difference(self.at)})
        if not new:
            return
        ids_a = [e.ids for e in self.byte_level.encode_batch_fast(new, add_special_tokens=False)]
        ids_b = self.processor.encode(new, num_threads=1)
        data = [c.encode("utf-8") for c in new]
        good = self._sound(data, ids_a, ids_b)
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        self._align([x if ok else [] for x, ok in zip(ids_a, good, strict=True)], [x if ok else [] for x, ok in zip(ids_b, good, strict=True)], good)
        self.bytes += sum(map(len, data)) + 300 * len(new)

    def _sound(self, data: list[bytes], ids_a: list[list[int]], ids_b: list[list[int]]) -> list[bool]:
        """Whether the tokens of both have each chunk's bytes; all at once, as nearly every chunk's do."""
        joined = b"".join(data)
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        for tokens, size, ids in ((self.a, self.size_a, ids_a), (self.b, self.size_b, ids_b)):
            flat = [i for x in ids for i in x]
            own = np.diff(bounds(size[flat])[bounds(np.fromiter(map(len, ids), np.int64, len(ids)))])
            if (own != sizes).any() or b"".join([tokens[i] for i in flat]) != joined:
                return [b"".join([self.a[i] for i in a]) == d == b"".join([self.b[i] for i in b]) for d, a, b in zip(data, ids_a, ids_b, strict=True)]
        return [True] * len(data)

    def _align(self, ids_a: list[list[int]], ids_b: list[list[int]], good: list[bool]) -> None:
        count_a, count_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids_a, ids_b))
        a, b = (np.fromiter((i for x in ids for i in x), np.int64, int(n.sum())) for ids, n in ((ids_a, count_a), (ids_b, count_b)))
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])  # chunks one after another
        begin_a = end_a - self.size_a[a]
        # an A token overlaps the B tokens from the first that ends after its begin to the first that reaches its end
        first, last = np.searchsorted(end_b, begin_a, "right"), np.searchsorted(end_b, end_a)
        n = last - first + 1
        edge_a = np.repeat(np.arange(len(a)), n)
        edge_b = np.repeat(first - bounds(n)[:-1], n) + np.arange(int(n.sum()))
        root = joined_groups((edge_a, len(a) + edge_b), len(a) + len(b))
        together = end_a[edge_a] == end_b[edge_b]
        link_a, link_b = edge_a[together], edge_b[together]
        # a component's smallest node is its first A token, and components lie one after another
        head = np.flatnonzero(root[: len(a)] == np.arange(len(a)))
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        cut_a, cut_b = [*head.tolist(), len(a)], [*np.searchsorted(root[len(a) :], head).tolist(), len(b)]
        said = [f"{','.join(text_a[cut_a[g]:cut_a[g + 1]])}|{','.join(text_b[cut_b[g]:cut_b[g + 1]])}" for g in range(len(head))]
        edge = bounds(count_a)
        group, link = np.searchsorted(head, edge), np.searchsorted(link_a, edge)
        cut = group.tolist()
        self.groups += [said[x] if y == x + 1 else ";".join(said[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
        for own, values in ((self.n_a, np.where(good, count_a, -1)), (self.n_b, count_b), (self.n_groups, np.diff(group)), (self.pairs, np.searchsorted(self.key, a[link_a] * self.width + b[link_b]))):
            own.frombytes(values.astype(np.int32).tobytes())
        self.end.frombytes((self.end[-1] + link[1:]).astype(np.int64).tobytes())

    def rows(self, texts: list[list[str]]) -> tuple[np.ndarray, list[str | None], np.ndarray, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups) and the groups of each text, and the pairs of each, each once and counted: numbers, times
        and where each text's begin."""
        count = np.fromiter(map(len, texts), np.int64, len(texts))
        numbers = [list(map(self.at.__getitem__, own)) for own in texts]
        row = np.fromiter((i for own in numbers for i in own), np.int64, int(count.sum()))
        edge, owner = bounds(count), np.repeat(np.arange(len(texts)), count)
        n_a, n_b, n_groups = (np.frombuffer(x, np.int32).astype(np.int64)[row] if len(x) else row for x in (self.n_a, self.n_b, self.n_groups))
        whole = np.bincount(owner[n_a < 0], minlength=len(texts)) == 0 if len(row) else np.ones(len(texts), bool)
        whole &= count > 0
        sums = np.stack([np.diff(bounds(x)[edge]) for x in (n_a, n_b, n_groups)], 1) * whole[:, None]
        said = [";".join(map(self.groups.__getitem__, own)) if ok else None for own, ok in zip(numbers, whole.tolist(), strict=True)]
        some = row[whole[owner]]
        end = np.frombuffer(self.end, np.int64)
        size = end[some + 1] - end[some]
        at = np.repeat(end[some] - bounds(size)[:-1], size) + np.arange(int(size.sum()))
        pair = np.frombuffer(self.pairs, np.int32)[at].astype(np.int64)
        key, times = np.unique(np.repeat(owner[whole[owner]], size) * len(self.key) + pair, return_counts=True)
        return sums, said, key % len(self.key), times, np.searchsorted(key, np.arange(len(texts) + 1) * len(self.key))


def align(docs: DataFrame, vocabularies: Vocabularies, table_bytes: int = 192 << 20) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, pair, times) of every row: groups as "a1,a2|b1;a3|b2,b3", null without tokens;
    pair: the numbers of the linked pairs, each once, and how often the text has each."""
    sent = shared(docs.sparkSession, vocabularies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        table = Table(sent(), table_bytes)
        for batch in batches:
            for begin, texts in in_chunks(batch.column("text")):
                cut = [CHUNK.split(" " + t.decode("utf-8")) if t else [] for t in texts]
                table.learn(cut)
                sums, groups, pair, times, edge = table.rows(cut)
                lists = [pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(x, pa.int32())) for x in (pair, times)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, len(texts)), *map(pa.array, sums.T.copy()), pa.array(groups, pa.string()), *lists], ["doc_id", "n_a", "n_b", "n_groups", "groups", "pair", "times"])

    return columns(docs, "doc_id", "text").mapInArrow(tidy(run), ALIGNED)


def pair_counts(aligned: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """(pair, n) of the pairs that are linked: each task adds up its texts' links, then tasks' sums meet by pair."""
    total = len(vocabularies.pair_a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(total, np.int64)
        for batch in batches:
            pair, times = (batch.column(c).flatten().to_numpy() for c in ("pair", "times"))
            count += np.bincount(pair, times, total).astype(np.int64)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some])], ["pair", "n"])

    return aligned.select("pair", "times").mapInArrow(tidy(run), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def judge(docs: DataFrame, vocabularies: Vocabularies, table_bytes: int = 192 << 20) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    spark = docs.sparkSession
    aligned = align(docs, vocabularies, table_bytes)
    aligned = written(aligned.withColumn("groups_sha256", F.when(F.col("groups").isNull(), "").otherwise(F.sha2("groups", 256))).drop("groups"), "aligned")
    counts = pair_counts(aligned, vocabularies).toArrow()  # a row a pair that the vocabularies can link, at most
    count = np.zeros(len(vocabularies.pair_a), np.int64)
    count[counts.column("pair").to_numpy()] = counts.column("n").to_numpy()
    highest = np.zeros(int(vocabularies.pair_b.max()) + 1, np.int64)
    np.maximum.at(highest, vocabularies.pair_b, count)
    sent = shared(spark, (count, count == highest[vocabularies.pair_b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = sent()
        for batch in batches:
            pair, times = (batch.column(c).flatten().to_numpy() for c in ("pair", "times"))
            edge = bounds(batch.column("pair").value_lengths().to_numpy())
            sums = (bounds(x) for x in (times, times * best[pair], times * count[pair]))
            n_links, n_best, count_sum = (pa.array(np.diff(x[edge]).astype(np.int64)) for x in sums)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")), n_links, n_best, count_sum], ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum"])

    out = aligned.mapInArrow(tidy(run), "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
