"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance of the statistics; the covariance is shrunk towards the pooled one and its
diagonal. The score is the difference of the two log densities, each a Mahalanobis distance through a cached Cholesky
factor, turned into a probability by a logistic curve fitted on the training rows. The statistics are computed in one
pass over all whole texts; learning joins labels to them, so no text is shuffled.

The fit uses a bounded sample: cap labelled rows of each class, the first by a hash of doc_id.

Defined cases: null, empty or white-space texts have all their counts zero and are scored like any other; if only one
class is known the score is its label (0.5 if none is known); a doc_id with two labels is not learnt from; a very long
text is counted whole; equal texts have equal scores, so ties are ties; repeated rows get equal scores; a null doc_id is scored
but not learnt from; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import SPACE, Block, in_chunks, tidy
from ._common import columns, held_out, shared, training_keys, written
from .perplexity import statistics

PUNCTUATION = b".,;:?'\"-()"


def document_statistics(texts: list[bytes]) -> np.ndarray:
    """A row of transformed statistics for each text."""
    n_words, chars, symbols, dup_lines, repeat = (x.astype(float) for x in statistics(texts))
    block = Block(texts)
    data, first, last = block.data, block.first, block.first + block.length
    total = lambda flags: (c := np.concatenate(([0], np.cumsum(flags))))[last] - c[first]
    size = np.maximum(block.length, 1)
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    letters = np.maximum(total(upper | lower | (data >= 128)), 1)
    starts, ends = block.words()
    doc = block.document(starts)
    length = ends - starts
    words = np.maximum(n_words, 1)
    mean = np.bincount(doc, length, block.n) / words
    spread = np.sqrt(np.maximum(np.bincount(doc, length.astype(float) ** 2, block.n) / words - mean**2, 0))
    lines = total(data == 10) + 1
    is_in = lambda b: total(np.isin(data, np.frombuffer(b, np.uint8)))
    return np.stack(
        [
            np.log1p(n_words),
            np.log1p(mean),
            np.log1p(spread),
            np.sqrt(symbols / size),
            np.sqrt(total(upper) / letters),
            np.sqrt(total((data >= 48) & (data <= 57)) / size),
            np.sqrt(is_in(PUNCTUATION) / size),
            np.sqrt(is_in(b"!") / size),
            np.sqrt(total(SPACE[data]) / size),
            np.log1p(lines / words * 10),
            np.sqrt(dup_lines / lines),
            np.sqrt(repeat / words),
            np.sqrt(total(data >= 128) / size),
        ],
        1,
    )


N_STATISTICS = 13


class Discriminant:
    """Two Gaussians with shrunk covariances, and the logistic curve over their log-density difference."""

    def __init__(self, x: np.ndarray, y: np.ndarray, shrink: float = 0.1, ridge: float = 1e-3) -> None:
        self.known = sorted(set(y.tolist()))
        if len(self.known) < 2:
            return
        self.center, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        x = (x - self.center) / self.scale
        groups = [x[y == k] for k in (0, 1)]
        pooled = sum(np.cov(g.T, bias=True) * len(g) for g in groups) / len(x)
        self.mean, self.factor, self.log_det = [], [], []
        for g in groups:
            own = np.cov(g.T, bias=True)
            a = max(shrink, x.shape[1] / (x.shape[1] + len(g)))  # few rows: lean on the pooled covariance
            cov = (1 - a) * own + a * (0.5 * pooled + 0.5 * np.diag(np.diag(pooled))) + ridge * np.eye(x.shape[1])
            self.mean.append(g.mean(0))
            self.factor.append(np.linalg.cholesky(cov))
            self.log_det.append(np.linalg.slogdet(cov)[1])
        self.slope, self.offset = self._calibrate(self._difference(x), y)

    def _difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0, flattened far out, where Gaussians mean little."""
        log = [-0.5 * (np.linalg.solve(f, (x - m).T) ** 2).sum(0) - 0.5 * d for m, f, d in zip(self.mean, self.factor, self.log_det, strict=True)]
        return np.arcsinh((log[1] - log[0]) / 4)

    @staticmethod
    def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Newton steps for a logistic regression on one variable."""
        design, w = np.stack((z, np.ones_like(z)), 1), np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), design.T @ (y - p) - 1e-2 * w)
            w = w + np.clip(step, -2, 2)
        return float(w[0]), float(w[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.known) < 2:
            return np.full(len(x), float(self.known[0]) if self.known else 0.5)
        z = self._difference((x - self.center) / self.scale)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30)))


def classify(docs: DataFrame, labels: DataFrame, cap: int = 8000, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted): learnt outside the held-out fold, scored for every text."""
    docs = columns(docs, "doc_id", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in in_chunks(batch.column("text")):
                x = document_statistics(texts)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_STATISTICS).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, len(texts)), lists], ["doc_id", "x"])

    table = written(docs.mapInArrow(tidy(measure), "doc_id long, x array<double>"), "statistics")
    keys = training_keys(labels.where("quality IN (0, 1)"), "quality", cap)
    sample = table.join(F.broadcast(keys), "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).toPandas().sort_values("doc_id")  # 2 * cap rows
    x = np.array(sample["x"].tolist()).reshape(len(sample), N_STATISTICS)
    model = shared(docs.sparkSession, Discriminant(x, sample["y"].to_numpy().astype(int)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model()
        for batch in batches:
            values = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, N_STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fitted.score(values))], ["doc_id", "score"])

    out = table.mapInArrow(tidy(run), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
