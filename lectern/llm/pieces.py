"""SentencePiece encoding and decoding over a table of distinct chunks.

No piece of such a vocabulary holds a space marker after another character, so no merge crosses from one marked
word into the next: a text may be cut before each run of markers and every chunk segmented alone.

  packs   some megabytes of texts each: the pack's distinct chunks, and for each text the places of its chunks among them
  table   each pack's chunks go to shards by their hash; a shard's task holds the distinct ones and segments each once
  join    a shard answers every pack in the order it was asked, and the pack's places turn the answers into ids

So every distinct chunk of the corpus is segmented once, and asked for once a pack, however often it occurs: no chunk is
frequent enough to make a shard hot. Packs are a table bucketed by their name, which a task gives at random: what is
written stays as it is when executors are lost, and the answers come to the packs without moving the texts again.

The number of shards follows the distinct chunks of the corpus, of which the packs' smallest hashes give an estimate, and
is a few thousand at most: packs times shards questions are asked, so shards mustn't grow with what is asked. A shard's
table is bounded by table_bytes; beyond that it is begun anew, and a chunk is segmented once more.

Defined cases: null text reads as empty and gives no ids and an empty decoding; repeated rows give repeated results, so
there are no ties; a very long text is a pack of its own; U+2581 in a text reads as a space, as in the library; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import chunks, in_chunks, tidy
from ._common import bucketed, columns

MARK = "▁"
SKETCH = 512  # smallest hashes kept of each pack's chunks
PACKS = "pack string, doc_id array<long>, n_chunks array<int>, at binary, words string, n_words long, word_bytes long, least array<long>"
ASKED = "pack string, shard int, words binary"
ANSWERS = "pack string, shard int, ids binary, sizes binary, odd array<int>, said array<string>"


def gather(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of values that begin and size name, one after another."""
    total = np.concatenate(([0], np.cumsum(size)))
    return values[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]


def planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on: the high ones are nearly all alike."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def small(data: bytes) -> bytes:
    """Compressed more than a shuffle would."""
    return zstandard.ZstdCompressor(level=3).compress(data)


def whole(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def record(schema: str, **values) -> pa.RecordBatch:
    """A batch of one row, its columns as the schema (name type, ...) has them."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    fields = [field.split(" ") for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([values[name]], kinds[kind]) for name, kind in fields], [name for name, _ in fields])


def hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((crc32(w.encode("utf-8")) for w in words), np.int64, len(words))


def shard_of(words: list[str], shards: int) -> np.ndarray:
    return hashes(words) % shards


class Model:
    """A SentencePiece model whose chunks can be segmented alone."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        norm = spec.normalizer_spec
        if norm.remove_extra_whitespaces or not norm.escape_whitespaces or norm.precompiled_charsmap or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model rewrites white space; chunks can't be segmented alone")
        if any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in spec.pieces):
            raise ValueError("a piece crosses a white-space marker; chunks can't be segmented alone")
        self.prefix = " " if norm.add_dummy_prefix else ""
        norm.add_dummy_prefix = False  # a chunk brings its own marker
        self.model, self.kind = spec.SerializeToString(), "H" if len(spec.pieces) <= 1 << 16 else "i"
        self.library = sentencepiece.SentencePieceProcessor

    def split(self, text: str) -> list[str]:
        """Each run of spaces with what follows it."""
        text = text.replace(MARK, " ")
        return re.findall(" +[^ ]*|[^ ]+", self.prefix + text) if text else []


class ChunkTable:
    """A shard's distinct chunks with their ids, one after another, and the decoded texts that differ from the chunk."""

    def __init__(self, model: Model, table_bytes: int = 64 << 20) -> None:
        self.limit = table_bytes
        self.processor, self.kind = model.library(model_proto=model.model), model.kind
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.odd: dict[int, str] = {}
        self.ids, self.end, self.bytes = array(self.kind), array("q", [0]), 0

    def answer(self, words: list[str]) -> dict:
        """ids and sizes for words in their order, and the places of those that decode to something else."""
        if self.bytes > self.limit:
            self.clear()
        new = [w for w in words if w not in self.at]
        if new:
            ids = self.processor.encode(new, num_threads=1)
            for word, own, said in zip(new, ids, self.processor.decode(ids, num_threads=1), strict=True):
                if said != word:
                    self.odd[len(self.at)] = said
                self.at[word] = len(self.at)
                self.ids.extend(own)
                self.end.append(len(self.ids))
                self.bytes += len(word) + 100
        at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        end = np.frombuffer(self.end, np.int64)
        size = end[at + 1] - end[at]
        found = gather(np.frombuffer(self.ids, self.kind), end[at], size)
        odd = [k for k, i in enumerate(at.tolist()) if i in self.odd] if self.odd else []
        return {"ids": small(found.tobytes()), "sizes": small(planes(size.astype(np.int32))), "odd": odd, "said": [self.odd[at[k]] for k in odd]}


def packed(docs: DataFrame, model: Model, pack_bytes: int, batch_bytes: int) -> DataFrame:
    """The packs, as a table bucketed by pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, places, doc_ids, counts, held = {}, array("I"), [], [], 0

        def pack() -> pa.RecordBatch:
            words = MARK.join(at)  # no chunk holds the marker, as split() reads it as a space
            least = np.unique(hashes(list(at)))[:SKETCH]
            return record(PACKS, pack=uuid.uuid4().hex, doc_id=doc_ids, n_chunks=counts, at=planes(np.frombuffer(places, np.uint32)), words=words, n_words=len(at), word_bytes=len(words.encode("utf-8")), least=least)

        for batch in batches:
            for begin, data in in_chunks(batch.column("text"), batch_bytes):
                doc_ids += batch.column("doc_id").slice(begin, len(data)).to_pylist()
                for text in data:
                    cut = model.split(text.decode("utf-8"))
                    for word in set(cut).difference(at):
                        at[word] = len(at)
                    places.extend(map(at.__getitem__, cut))
                    counts.append(len(cut))
                held += sum(map(len, data))
                if held >= pack_bytes:
                    yield pack()
                    at, places, doc_ids, counts, held = {}, array("I"), [], [], 0
        if doc_ids:
            yield pack()

    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.table(bucketed(docs.mapInArrow(tidy(run), PACKS), "packs", buckets, ["pack"], "zstd"))


def distinct_bytes(packs: DataFrame) -> int:
    """About how many bytes the corpus's distinct chunks have, by the smallest hashes of all packs."""
    asked = packs.agg(F.sum("word_bytes").alias("bytes"), F.sum("n_words").alias("n")).first()
    if not asked["n"]:
        return 0
    least = [r["h"] for r in packs.select(F.explode("least").alias("h")).distinct().orderBy("h").limit(SKETCH).collect()]
    n = len(least) if len(least) < SKETCH else (SKETCH - 1) / (least[-1] / (1 << 32))
    return int(n * asked["bytes"] / asked["n"]) + 1


def answered(packs: DataFrame, model: Model, shard_bytes: int, most: int) -> tuple[DataFrame, int]:
    """(pack, shard, ids, sizes, odd, said) for the chunks of every pack in every shard, and the number of shards."""
    shards = max(1, min(most, -(-distinct_bytes(packs) // shard_bytes)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, words in zip(batch.column(0), batch.column(1), strict=True):
                name, own = pack.as_py(), np.array(words.as_py().split(MARK), object) if words.as_py() else np.zeros(0, object)
                shard = shard_of(own.tolist(), shards)
                order = np.argsort(shard, kind="stable")
                found, first = np.unique(shard[order], return_index=True)
                parts = [small(MARK.join(x).encode("utf-8")) for x in np.split(own[order], first[1:])] if len(found) else []
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array(found, pa.int32()), pa.array(parts, pa.binary())], ["pack", "shard", "words"])

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, last = ChunkTable(model), None
        for batch in batches:
            for row in range(batch.num_rows):
                pack, shard, words = (c[row].as_py() for c in batch.columns)
                if shard != last:
                    table.clear()
                    last = shard
                yield record(ANSWERS, pack=pack, shard=shard, **table.answer(whole(words).decode("utf-8").split(MARK)))

    dealt = packs.select("pack", "words").mapInArrow(tidy(deal), ASKED)
    return dealt.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(tidy(segment), ANSWERS), shards


def encode(docs: DataFrame, model_path: str, pack_bytes: int = 8 << 20, shard_bytes: int = 1 << 20, batch_bytes: int = 1 << 20, most_shards: int = 4096) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every whole text. model_path is read on the driver and sent along."""
    with open(model_path, "rb") as f:
        model = Model(f.read())
    packs = packed(columns(docs, "doc_id", "text"), model, pack_bytes, batch_bytes)
    answers, shards = answered(packs, model, shard_bytes, most_shards)
    answers = answers.groupBy("pack").agg(F.collect_list(F.struct("shard", "ids", "sizes", "odd", "said")).alias("answers"))
    joined = packs.drop("n_words", "word_bytes", "least").join(answers, "pack", "left")

    def unpack(words: list[str], answers: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """ids with the begin and size of each word's, and the decoded words; answers stand in the order of the shards."""
        answers = sorted(answers, key=lambda a: a["shard"])
        order = np.argsort(shard_of(words, shards), kind="stable")
        own = [from_planes(whole(a["sizes"]), np.int32) for a in answers]
        sizes = np.concatenate([np.zeros(0, np.int64), *own])
        begin, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        begin[order], size[order] = np.cumsum(sizes) - sizes, sizes
        decoded, k = list(words), 0
        for a, asked in zip(answers, own, strict=True):
            for place, said in zip(a["odd"], a["said"], strict=True):
                decoded[order[k + place]] = said
            k += len(asked)
        return np.frombuffer(b"".join([whole(a["ids"]) for a in answers]), model.kind), begin, size, decoded

    def join_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop = len(model.prefix)
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, counts, at, words, answers = (batch.column(name)[row].as_py() for name in ("doc_id", "n_chunks", "at", "words", "answers"))
                ids, begin, size, decoded = unpack(words.split(MARK) if words else [], answers or [])
                at, end = from_planes(at, np.uint32), np.concatenate(([0], np.cumsum(counts)))
                for a, b in chunks(counts, batch_bytes // 8):
                    own = at[end[a] : end[b]]
                    stop = np.concatenate(([0], np.cumsum(size[own])))[end[a : b + 1] - end[a]]
                    lists = pa.ListArray.from_arrays(pa.array(stop, pa.int32()), pa.array(gather(ids, begin[own], size[own]).astype(np.int32)))
                    texts = ["".join([decoded[i] for i in at[end[k] : end[k + 1]].tolist()])[drop:] for k in range(a, b)]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a:b], pa.int64()), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return joined.mapInArrow(tidy(join_back), "doc_id long, ids array<int>, decoded string")
