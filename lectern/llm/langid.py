"""Language ID: averaged embeddings of hashed subwords under a linear softmax, trained by SGD in numpy.

Subwords are byte n-grams of letters and spaces, hashed into buckets; a text is the mean of its subwords' vectors, and
the softmax over it gives the languages. As both layers are linear, scoring needs one row of class scores per bucket and
sums those over the whole text. A tenth of the training documents, which the fit never sees, sets the temperature and the score below which an answer is
rejected (accepted = false); the best guess is still named.

The fit uses a bounded sample: cap texts of each language and total in all, the first by a hash of doc_id, whole and in a
few pieces; of a text longer than text_bytes as many stretches over its whole length as come to that.

A text's subwords are its own: none reaches over its ends, in the fit as in scoring, so a score depends on the text alone.

Defined cases: text that is null, empty or without a letter is `und` with score 0; so is every text if nothing can be
learnt from (an empty table, no language known); a doc_id with two languages is not learnt from; a very long text is
summed whole; ties go to the language first in the alphabet; repeated rows get equal
results; a null doc_id is predicted but not learnt from; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import LOWER, SPACE, Block, in_chunks, tidy
from ._common import columns, held_out, shared, training_keys

BITS = 16
ORDERS = (2, 3, 4)


def subwords(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, bucket) of the n-grams of each order; starts ascend."""
    block = Block(texts)
    data = LOWER[np.where(SPACE[block.data], np.uint8(32), block.data)]
    good = (data >= 128) | ((data >= 97) & (data <= 122)) | (data == 32)
    good[block.first + block.length] = False  # what stands between two texts
    wide = data.astype(np.uint32)
    code, own = wide, good
    for n in range(2, max(ORDERS) + 1):
        code = code[:-1] * np.uint32(0x01000193) ^ wide[n - 1 :] * np.uint32(0x9E3779B1)
        own = own[:-1] & good[n - 1 :]
        if n in ORDERS:
            at = np.flatnonzero(own)
            yield at, ((code[at] + np.uint32(n)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)).astype(np.int64)


def pieces_of(text: bytes, pieces: int, size: int, limit: int) -> list[bytes]:
    """The text, and some pieces of about size bytes spread over it, so that short texts are learnt too; of a text longer
    than limit, stretches of it with a gap (no letter) between them."""
    spread = lambda n, size: [text[s : s + size] for s in np.linspace(0, max(0, len(text) - size), n).astype(int)]
    whole = text if len(text) <= limit else b"\x00".join(spread(16, limit // 16))
    return [whole, *(spread(pieces, size) if len(text) > 2 * size else [])]


class Model:
    """Bucket vectors and softmax weights; after fit(), score rows by bucket, temperature and rejection threshold."""

    def __init__(self, classes: list[str], dim: int = 16, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.classes, self.rng = classes, rng
        self.vectors = rng.uniform(-1, 1, (1 << BITS, dim)).astype(np.float32) / dim
        self.weights = np.zeros((dim, len(classes)), np.float32)
        self.bias = np.zeros(len(classes), np.float32)

    def _logits(self, bucket: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = share @ self.vectors[bucket]
        return mean, mean @ self.weights + self.bias

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], owner: list[int], epochs: int = 6, rate: float = 0.5) -> None:
        """owner: the document of each row; a tenth of the documents, pieces and all, are for the calibration only."""
        documents = self.rng.permutation(sorted(set(owner)))
        apart = set(documents[: len(documents) // 10].tolist()) if len(documents) >= 50 else None
        check = [r for r, d in zip(rows, owner, strict=True) if apart is None or d in apart]
        learn = [r for r, d in zip(rows, owner, strict=True) if apart is None or d not in apart]
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            for i in self.rng.permutation(len(learn)):
                bucket, share, y = learn[i]
                mean, z = self._logits(bucket, share)
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1
                back = self.weights @ p
                self.weights -= step * np.outer(mean, p)
                self.bias -= 0.1 * step * p
                self.vectors[bucket] -= step * 20 * share[:, None] * back
        z = np.array([self._logits(b, s)[1] for b, s, _ in check])
        y = np.array([r[2] for r in check])
        loss = lambda t: -np.mean((z / t - np.log(np.exp((z - z.max(1, keepdims=True)) / t).sum(1, keepdims=True)) - z.max(1, keepdims=True) / t)[np.arange(len(y)), y])
        self.temperature = min(np.geomspace(0.2, 5, 40), key=loss)
        p = self._softmax(z)
        right, score = p.argmax(1) == y, p.max(1)
        wrong = np.sort(score[~right])
        self.threshold = float(wrong[int(0.9 * (len(wrong) - 1))]) if len(wrong) else 0.5
        self.rows = (self.vectors @ self.weights).astype(np.float32)
        del self.vectors

    def _softmax(self, z: np.ndarray) -> np.ndarray:
        p = np.exp((z - z.max(1, keepdims=True)) / self.temperature)
        return p / p.sum(1, keepdims=True)

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Class probabilities of whole texts."""
        first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        total, n = np.zeros((len(texts), len(self.classes))), np.zeros(len(texts))
        for at, bucket in subwords(texts):
            edge = np.searchsorted(at, first)
            some = np.flatnonzero(np.diff(edge))
            if len(some):
                total[some] += np.add.reduceat(self.rows[bucket], edge[some], axis=0, dtype=np.float64)
            n += np.diff(edge)
        return self._softmax(total / np.maximum(n, 1)[:, None] + self.bias)


def train(docs: DataFrame, cap: int = 500, classes: int = 1000, total: int = 4000, text_bytes: int = 16 << 10, pieces: int = 3, piece_bytes: int = 160) -> Model | None:
    """A model from (doc_id, text, lang). cap bounds the texts of each language, classes the languages (the commonest),
    total the texts of all of them and text_bytes what one text brings: total * text_bytes is what can reach the driver."""
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    n_langs = min(classes, known.where(~held_out(F.col("doc_id"))).select("lang").distinct().count())
    keys = training_keys(known, "lang", max(2, min(cap, total // max(1, n_langs))), classes)
    chosen = docs.select("doc_id", "text").join(F.broadcast(keys), "doc_id")  # total rows, whatever the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in in_chunks(batch.column("text")):
                for i, text in enumerate(texts):
                    for k, piece in enumerate(pieces_of(text, pieces, piece_bytes, text_bytes)):
                        bucket = np.concatenate([b for _, b in subwords([piece])])
                        found, n = np.unique(bucket, return_counts=True)
                        if len(found):
                            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin + i, 1), pa.array([k], pa.int32()), batch.column("y").slice(begin + i, 1), pa.array([found.astype("<u2").tobytes()], pa.binary()), pa.array([n.astype("<f4").tobytes()], pa.binary())], ["doc_id", "k", "y", "bucket", "n"])

    sample = chosen.mapInArrow(tidy(run), "doc_id long, k int, y string, bucket binary, n binary").toPandas().sort_values(["doc_id", "k"])
    if not len(sample):
        return None
    model = Model(sorted(sample["y"].unique()))
    place = {c: i for i, c in enumerate(model.classes)}
    rows = []
    for y, bucket, n in zip(sample["y"], sample["bucket"], sample["n"], strict=True):
        n = np.frombuffer(n, "<f4")
        rows.append((np.frombuffer(bucket, "<u2").astype(np.int64), n / n.sum(), place[y]))
    model.fit(rows, sample["doc_id"].tolist())
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of every whole text."""
    sent = shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent()
        for batch in batches:
            for begin, texts in in_chunks(batch.column("text")):
                letters = [any(c.isalpha() for c in t.decode("utf-8", "replace")) for t in texts]
                if found:
                    p = found.predict(texts)
                    lang = [found.classes[k] if a else "und" for k, a in zip(p.argmax(1), letters, strict=True)]
                    score = np.where(letters, p.max(1), 0.0)
                    sure = score >= found.threshold
                else:
                    lang, score, sure = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, len(texts)), pa.array(lang, pa.string()), pa.array(score), pa.array(sure)], ["doc_id", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double, accepted boolean")


def identify(docs: DataFrame, cap: int = 500, classes: int = 1000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted): learnt outside the held-out fold, predicted for every text."""
    docs = columns(docs, "doc_id", "text", "lang")
    out = predict(docs, train(docs, cap, classes))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
