"""A linear-chain CRF trained on tables: its likelihood and gradient summed over partitions, its weights by a quasi-Newton
method.

  sequences  labelled tokens become rows of arrays: hashed features of each token, labels, and how long the sequence is.
             A longer sequence than max_length is cut into stretches of that length, so no row grows with a document
  gradient   a task pads its sequences to blocks of about equal length and works out log-likelihood and expected counts of
             a whole block at once, in log space; it returns one vector. The vectors are added up in two levels: groups of
             tasks first, so that the driver adds the square root of the number of tasks
  step       limited-memory BFGS with a backtracking line search, on the driver, which holds a few vectors of the weights
  labels     Viterbi over blocks, the same way

Features are hashed into 2 ** bits places, which bounds the weights (labels * 2 ** bits doubles, 1.5 MB at 16 bits) and
what is sent to tasks in each step, whatever the corpus; two features may share a place.

Defined cases: a token without features has the scores of the label transitions alone; a null feature is none; tokens
whose label is null or unknown make their whole sequence one that isn't learnt from; an empty table gives weights of 0 and
no labels; of equally good labels the first in the list is taken; rows with the same (doc_id, ord) are taken one after
another, in the order of their features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .entities import LABELS


class Weights(NamedTuple):
    """score[place, label] of a feature, between[label, next label]."""

    score: np.ndarray
    between: np.ndarray

    @classmethod
    def of(cls, vector: np.ndarray, labels: int) -> Weights:
        edge = len(vector) - labels * labels
        return cls(vector[:edge].reshape(-1, labels), vector[edge:].reshape(labels, labels))


class Block(NamedTuple):
    """Sequences of about equal length: features of all tokens one after another (place, and the token that has it), each
    sequence's length, and gold[sequence, step]."""

    place: np.ndarray
    token: np.ndarray
    length: np.ndarray
    gold: np.ndarray

    @property
    def where(self) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, step) of each token."""
        row = np.repeat(np.arange(len(self.length)), self.length)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(self.length) - self.length, self.length)

    def emissions(self, w: Weights) -> np.ndarray:
        """[sequence, step, label], 0 beyond a sequence's end."""
        labels = w.score.shape[1]
        tokens = np.zeros((int(self.length.sum()), labels))
        for k in range(labels):
            tokens[:, k] = np.bincount(self.token, w.score[self.place, k], len(tokens))
        out = np.zeros((len(self.length), int(self.length.max()), labels))
        out[self.where] = tokens
        return out


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def _log_passes(emit: np.ndarray, length: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """passes in log space."""
    n, steps, _ = emit.shape
    ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
    ahead[:, 0] = emit[:, 0]
    for t in range(1, steps):
        ahead[:, t] = emit[:, t] + log_sum(ahead[:, t - 1, :, None] + between, 1)
    for t in range(steps - 2, -1, -1):
        inside = (t + 1 < length)[:, None]
        behind[:, t] = np.where(inside, log_sum(between + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2), 0)
    return ahead, behind, log_sum(ahead[np.arange(n), length - 1], 1)


def passes(emit: np.ndarray, length: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward scores [sequence, step, label] and log Z; sequences end where their length says.

    Worked out as products that are scaled to 1 at each step, one exponential and one logarithm a score. Scores between
    labels that are too far apart for that are summed in log space.
    """
    if np.ptp(between) > 300:
        return _log_passes(emit, length, between)
    n, steps, labels = emit.shape
    rows, top = np.arange(n), between.max()
    high = emit.max(2, keepdims=True)
    chance, move = np.exp(emit - high).transpose(1, 2, 0).copy(), np.exp(between - top)  # [step, label, sequence]
    ahead, behind = np.empty_like(chance), np.ones_like(chance)
    scale = np.empty((steps, n))
    value = chance[0]
    for t in range(steps):
        if t:
            value = (move.T @ ahead[t - 1]) * chance[t]
        scale[t] = value.sum(0)
        ahead[t] = value / scale[t]
    back = np.zeros((steps, n))  # log of what behind was divided by
    for t in range(steps - 2, -1, -1):
        value = move @ (behind[t + 1] * chance[t + 1])
        whole = value.sum(0)
        inside = t + 1 < length
        behind[t] = np.where(inside, value / whole, 1)
        back[t] = np.where(inside, back[t + 1] + np.log(whole) + high[:, t + 1, 0] + top, 0)
    along = np.cumsum(np.log(scale) + high[:, :, 0].T, 0) + top * np.arange(steps)[:, None]
    with np.errstate(divide="ignore"):  # what is too small for a double is 0
        ahead, behind = np.log(ahead) + along[:, None], np.log(behind) + back[:, None]
    return ahead.transpose(2, 0, 1).copy(), behind.transpose(2, 0, 1).copy(), along[length - 1, rows]


def gradient(block: Block, w: Weights) -> tuple[float, np.ndarray]:
    """Log-likelihood of a block's labels, and its derivatives as one vector (observed less expected counts)."""
    labels = w.score.shape[1]
    emit = block.emissions(w)
    ahead, behind, log_z = passes(emit, block.length, w.between)
    row, step = block.where
    gold = block.gold[row, step]
    left = np.zeros((len(row), labels))
    left[np.arange(len(row)), gold] = 1
    left -= np.exp(ahead[row, step] + behind[row, step] - log_z[row][:, None])
    score = np.stack([np.bincount(block.place, left[block.token, k], len(w.score)) for k in range(labels)], 1)
    # pairs of neighbours
    pair = np.flatnonzero(step > 0)
    r, s = row[pair], step[pair]
    joint = np.exp(ahead[r, s - 1][:, :, None] + w.between + (emit[r, s] + behind[r, s])[:, None, :] - log_z[r][:, None, None])
    between = np.bincount(gold[pair - 1] * labels + gold[pair], minlength=labels * labels).reshape(labels, labels) - joint.sum(0)
    likelihood = emit[row, step, gold].sum() + w.between[gold[pair - 1], gold[pair]].sum() - log_z.sum()
    return float(likelihood), np.concatenate((score.ravel(), between.ravel()))


def marginals(block: Block, w: Weights) -> np.ndarray:
    """Probability of each label at each token, one sequence after another."""
    emit = block.emissions(w)
    ahead, behind, log_z = passes(emit, block.length, w.between)
    row, step = block.where
    return np.exp(ahead[row, step] + behind[row, step] - log_z[row][:, None])


def best_labels(block: Block, w: Weights) -> np.ndarray:
    """The best labels of each sequence, one sequence after another; of equally good ones the first."""
    emit = block.emissions(w)
    n, steps, _ = emit.shape
    best, back = emit[:, 0], np.zeros(emit.shape, np.int64)
    last = best.copy()
    for t in range(1, steps):
        total = best[:, :, None] + w.between
        back[:, t] = total.argmax(1)
        best = total.max(1) + emit[:, t]
        last = np.where((block.length - 1 == t)[:, None], best, last)
    out = np.zeros((n, steps), np.int64)
    label = last.argmax(1)
    for t in range(steps - 1, -1, -1):
        ended = t >= block.length
        out[:, t] = label
        label = np.where(ended, label, back[np.arange(n), t, label]) if t else label
    return out[block.where]


# --- tables -----------------------------------------------------------------------------------------------------------


def sequences(tokens: DataFrame, bits: int = 16, max_length: int = 200, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(doc_id, part, ords, places array<array<int>>, gold array<int>): tokens (doc_id, ord, features and, for training,
    label), whose features are hashed; gold is -1 where there is no label that is known."""
    known = F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1 if "label" in tokens.columns else F.lit(-1)
    place = F.transform(F.filter("features", lambda f: f.isNotNull()), lambda f: F.pmod(F.xxhash64(f), F.lit(1 << bits)).cast("int"))
    rows = tokens.select("doc_id", (F.floor(F.col("ord") / max_length)).cast("int").alias("part"), F.struct("ord", F.coalesce(place, F.array().cast("array<int>")).alias("place"), F.coalesce(known.cast("int"), F.lit(-1)).alias("gold")).alias("token"))
    grouped = rows.groupBy("doc_id", "part").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    return grouped.select("doc_id", "part", F.col("tokens.ord").alias("ords"), F.col("tokens.place").alias("places"), F.col("tokens.gold").alias("gold"))


def blocks(batch: pa.RecordBatch, cells: int = 1 << 16) -> Iterator[tuple[np.ndarray, Block]]:
    """(rows of the batch, block): rows by length, as many together as cells tokens hold when padded."""
    length = np.asarray(batch.column("gold").value_lengths())
    order = np.argsort(length, kind="stable")
    order = order[length[order] > 0]
    begin = 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and (end + 1 - begin) * length[order[end]] <= cells:
            end += 1
        rows = order[begin:end]
        part = batch.take(pa.array(rows))
        gold = np.zeros((len(rows), int(length[rows].max())), np.int64)
        lists = part.column("places").flatten()
        own = np.asarray(lists.value_lengths())
        block = Block(lists.flatten().to_numpy(), np.repeat(np.arange(len(own)), own), length[rows], gold)
        gold[block.where] = part.column("gold").flatten().to_numpy()
        yield rows, block
        begin = end


def summed(table: DataFrame, one: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of one(batch), vectors of a size, over a table: a vector a task, those of groups of tasks added up by
    further tasks, and the sums of the groups by the driver."""
    groups = max(1, round(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))

    def add(batches: Iterator[pa.RecordBatch], vector: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
        total = np.zeros(size)
        for batch in batches:
            for x in vector(batch):
                total += x
        return total

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = add(batches, lambda b: iter((one(b),)))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % groups], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = add(batches, lambda b: (np.frombuffer(x.as_py()) for x in b.column("total")))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    sums = table.mapInArrow(first, "part int, total binary").repartition(groups, "part").mapInArrow(then, "total binary").toArrow()
    return sum((np.frombuffer(x.as_py()) for x in sums.column("total")), np.zeros(size))


class ChainTrainer:
    """Likelihood and gradient of a table of sequences, and the weights that make it large."""

    def __init__(self, tokens: DataFrame, bits: int = 16, labels: tuple[str, ...] = LABELS, max_length: int = 200, ridge: float = 1.0) -> None:
        known = sequences(tokens, bits, max_length, labels)
        self.table = written(known.where(F.size("gold") > 0).where(~F.exists("gold", lambda g: g < 0)), "sequences")
        self.spark, self.labels, self.ridge = tokens.sparkSession, labels, ridge
        self.bits, self.size = bits, (len(labels) << bits) + len(labels) ** 2
        self.evaluations = 0

    def loss(self, vector: np.ndarray) -> tuple[float, np.ndarray]:
        """Negative log-likelihood with a ridge, and its gradient."""
        sent, labels, size = self.spark.sparkContext.broadcast(vector), len(self.labels), self.size

        def one(batch: pa.RecordBatch) -> np.ndarray:
            w, total = Weights.of(sent.value, labels), np.zeros(size + 1)
            for _, block in blocks(batch):
                likelihood, slope = gradient(block, w)
                total[0] += likelihood
                total[1:] += slope
            return total

        total = summed(self.table, one, size + 1)
        sent.unpersist()
        self.evaluations += 1
        return float(-total[0] + self.ridge / 2 * vector @ vector), self.ridge * vector - total[1:]

    def fit(self, steps: int = 20, memory: int = 6, tolerance: float = 1e-3) -> ChainWeights:
        """Limited-memory BFGS from 0, until the gradient is small beside the weights."""
        x = np.zeros(self.size)
        loss, slope = self.loss(x)
        self.losses, kept = [loss], []
        for _ in range(steps):
            if np.linalg.norm(slope) <= tolerance * max(1.0, np.linalg.norm(x)):
                break
            way = -direction(slope, kept)
            rate, down = (1.0 if kept else 1 / max(1.0, np.linalg.norm(slope))), slope @ way
            while True:
                new = x + rate * way
                new_loss, new_slope = self.loss(new)
                if new_loss <= loss + 1e-4 * rate * down or rate < 1e-8:
                    break
                rate /= 2
            if new_loss >= loss:
                break
            change, turn = new - x, new_slope - slope
            if change @ turn > 1e-10:
                kept = [*kept[1 - memory :], (change, turn)] if memory > 1 else [(change, turn)]
            x, loss, slope = new, new_loss, new_slope
            self.losses.append(loss)
        return ChainWeights(x, self.bits, self.labels)


def direction(slope: np.ndarray, kept: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The inverse Hessian that the kept steps suggest, times the slope (two loops)."""
    q, shares = slope.copy(), []
    for change, turn in reversed(kept):
        share = (change @ q) / (change @ turn)
        shares.append(share)
        q -= share * turn
    if kept:
        change, turn = kept[-1]
        q *= (change @ turn) / (turn @ turn)
    for (change, turn), share in zip(kept, reversed(shares), strict=True):
        q += change * (share - (turn @ q) / (change @ turn))
    return q


class ChainWeights(NamedTuple):
    vector: np.ndarray
    bits: int
    labels: tuple[str, ...]

    def labelled(self, tokens: DataFrame, max_length: int = 200) -> DataFrame:
        """(doc_id, ord, label, probability): the best labels of tokens (doc_id, ord, features), and each one's marginal."""
        sent, labels = tokens.sparkSession.sparkContext.broadcast(self.vector), self.labels
        kinds = dict(tokens.dtypes)
        table = sequences(tokens.drop("label"), self.bits, max_length, labels)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = Weights.of(sent.value, len(labels))
            for batch in batches:
                for rows, block in blocks(batch):
                    part = batch.take(pa.array(rows))
                    found = best_labels(block, w)
                    chance = marginals(block, w)[np.arange(len(found)), found]
                    docs = part.column("doc_id").take(pa.array(block.where[0]))
                    yield pa.RecordBatch.from_arrays([docs, part.column("ords").flatten(), pa.array(labels).take(pa.array(found)), pa.array(chance)], ["doc_id", "ord", "label", "probability"])

        return table.mapInArrow(run, f"doc_id {kinds['doc_id']}, ord {kinds['ord']}, label string, probability double")
