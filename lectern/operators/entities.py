"""Author and affiliation entities from tokens: features by windows, a linear-chain CRF, runs of labels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed

LABELS = ("O", "AUTHOR", "AFFILIATION")
CELLS = 1 << 16  # tokens that are labelled together
STAY = 0.1  # score of two equal labels in a row; different ones score 0

#: The sequences that the default model learns, five rounds at a rate of 0.1.
DEFAULT_SEQUENCES = (
    ((("WORD=\\author", "CAP"), ("WORD=John", "CAP"), ("WORD=Doe", "CAP")), ("O", "AUTHOR", "AUTHOR")),
    ((("WORD=\\affiliation",), ("WORD=SomeUniversity", "CAP")), ("O", "AFFILIATION")),
    ((("WORD=\\institute",), ("WORD=AnotherInstitute", "CAP")), ("O", "AFFILIATION")),
)


def features(tokens: DataFrame) -> DataFrame:
    """tokens (doc_id, ord, value) with features: the word, its case, its neighbours (BOS and EOS at the ends)."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    case = F.when(F.col("value").rlike("^[A-Z]"), "CAP").otherwise("NOT_CAP")
    said = lambda name, c: F.concat(F.lit(f"{name}="), c)
    made = F.array(said("WORD", F.col("value")), case, said("PREV_WORD", F.lag("value", 1, "BOS").over(order)), said("NEXT_WORD", F.lead("value", 1, "EOS").over(order)))
    return tokens.withColumn("features", made)


class ChainModel:
    """A linear-chain CRF: a weight for each label and feature, fixed scores between labels. Log space throughout."""

    def __init__(self) -> None:
        self.weights: dict[tuple[int, str], float] = {}
        self.between = STAY * np.eye(len(LABELS))

    def emissions(self, sequence: Sequence[Sequence[str]]) -> np.ndarray:
        return np.array([[sum(self.weights.get((k, f), 0.0) for f in fs) for k in range(len(LABELS))] for fs in sequence]).reshape(len(sequence), len(LABELS))

    def forward_backward(self, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[0] = emit[0]
        for t in range(1, len(emit)):
            ahead[t] = emit[t] + np.logaddexp.reduce(ahead[t - 1][:, None] + self.between, axis=0)
        for t in range(len(emit) - 2, -1, -1):
            behind[t] = np.logaddexp.reduce(self.between + (emit[t + 1] + behind[t + 1])[None, :], axis=1)
        return ahead, behind, float(np.logaddexp.reduce(ahead[-1]))

    def gradient(self, sequence: Sequence[Sequence[str]], labels: Sequence[str]) -> tuple[dict[tuple[int, str], float], float]:
        """Observed less expected counts, and the negative log likelihood."""
        emit = self.emissions(sequence)
        ahead, behind, log_z = self.forward_backward(emit)
        posterior = np.exp(ahead + behind - log_z)
        gold = [LABELS.index(x) for x in labels]
        out: dict[tuple[int, str], float] = {}
        for t, fs in enumerate(sequence):
            for f in fs:
                for k in range(len(LABELS)):
                    out[k, f] = out.get((k, f), 0.0) + (k == gold[t]) - posterior[t, k]
        score = sum(emit[t, k] for t, k in enumerate(gold)) + sum(self.between[a, b] for a, b in zip(gold[:-1], gold[1:], strict=True))
        return out, log_z - score

    def fit(self, sequences: Sequence[tuple] = DEFAULT_SEQUENCES, rounds: int = 5, rate: float = 0.1, strict: bool = False) -> ChainModel:
        """Steps along the gradient; strict steps against it, as the model's origin does."""
        for _ in range(rounds):
            for sequence, labels in sequences:
                if len(sequence):
                    step = self.gradient(sequence, labels)[0]
                    for key, g in step.items():
                        self.weights[key] = self.weights.get(key, 0.0) + (-rate if strict else rate) * g
        return self

    def predict(self, sequence: Sequence[Sequence[str]]) -> list[str]:
        """The best labels; of equal ones the first in LABELS."""
        if not len(sequence):
            return []
        emit = self.emissions(sequence)
        best, back = emit[0], []
        for t in range(1, len(emit)):
            total = best[:, None] + self.between
            back.append(total.argmax(0))
            best = total.max(0) + emit[t]
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return [LABELS[k] for k in reversed(path)]

    def scored(self, features: pa.ListArray) -> np.ndarray:
        """emissions of many tokens, each distinct feature looked up once."""
        size = np.asarray(features.value_lengths().fill_null(0))
        coded = features.flatten().dictionary_encode()
        token = np.repeat(np.arange(len(size)), size)
        out = np.zeros((len(size), len(LABELS)))
        for k in range(len(LABELS)):
            weight = np.array([self.weights.get((k, f), 0.0) for f in coded.dictionary.to_pylist()] + [0.0])  # a null has none
            place = coded.indices.fill_null(len(weight) - 1).to_numpy()
            out[:, k] = np.bincount(token, weight[place], len(size))  # added one after another, as emissions does
        return out

    def best(self, emit: np.ndarray, size: np.ndarray) -> np.ndarray:
        """predict for sequences of these sizes, one after another in emit: label numbers, a step of all at a time."""
        out, begin = np.zeros(len(emit), np.int64), np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        longest_first, at = size[order], begin[order]
        alive = int((longest_first > 0).sum())
        best, back = emit[at[:alive]], np.zeros((len(emit), len(LABELS)), np.int8)
        last = np.zeros(len(size), np.int64)
        for t in range(1, int(longest_first[0]) + 1 if alive else 0):
            going = int((longest_first > t).sum())
            last[going:alive] = best[going:].argmax(1)  # of equal ones the first
            alive, total = going, best[:going, :, None] + self.between
            back[at[:alive] + t] = total.argmax(1)
            best = total.max(1) + emit[at[:alive] + t]
        for t in range(int(longest_first[0]) - 1 if len(size) else -1, -1, -1):
            alive = int((longest_first > t).sum())
            out[at[:alive] + t] = last[:alive]
            if t:
                last[:alive] = back[at[:alive] + t, last[:alive]]
        return out


def labelled(featured: DataFrame, model: ChainModel) -> DataFrame:
    """(doc_id, ord, value, label): the best labels of each document's tokens (doc_id, ord, value, features).

    Documents come in Arrow batches and are worked through as columns, so many at a time as hold some 65,000 tokens; a
    document is a sequence and stays whole.
    """
    rows = featured.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "value", "features"))).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch.column("tokens").value_lengths())
            begin = 0
            while begin < len(size):
                count = max(1, int(np.searchsorted(np.cumsum(size[begin : begin + CELLS]), CELLS, "right")))
                part, own = batch.slice(begin, count), size[begin : begin + count]
                ord_, value, features = part.column("tokens").flatten().flatten()
                doc = part.column("doc_id").take(pa.array(np.repeat(np.arange(len(own)), own)))
                found = model.best(model.scored(features), own)
                yield pa.RecordBatch.from_arrays([doc, ord_, value, pa.array(LABELS).take(pa.array(found))], ["doc_id", "ord", "value", "label"])
                begin += count

    return rows.mapInArrow(run, "doc_id string, ord int, value string, label string")


def runs(labels: DataFrame) -> DataFrame:
    """(doc_id, ord, kind, value): each run of one label other than O, its values joined without white space."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    change = F.coalesce((F.col("label") != F.lag("label").over(order)).cast("int"), F.lit(0))
    island = F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = labels.withColumn("change", change).withColumn("island", island).where("label <> 'O'")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), "")
    kind = F.when(F.col("label") == "AUTHOR", "authors").otherwise("affiliations")
    return marked.groupBy("doc_id", "island", "label").agg(F.min("ord").alias("ord"), F.regexp_replace(joined, "\\s", "").alias("value")).select("doc_id", "ord", kind.alias("kind"), "value")


def entity_nodes(entities: DataFrame) -> DataFrame:
    """(node_id, node_type, content): a graph node for each entity, the first type it was seen with."""
    kind = F.when(F.col("kind") == "authors", "Author").otherwise("Affiliation")
    return entities.groupBy(F.col("value").alias("node_id")).agg(F.min_by(kind, F.struct("doc_id", "ord")).alias("node_type")).withColumn("content", F.col("node_id"))


def matches(docs: DataFrame, pattern: str = fixed.AFFILIATION) -> DataFrame:
    """(doc_id, at, value): all first groups of a pattern in (doc_id, text)."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("at", "value"))
