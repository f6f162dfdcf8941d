"""Toxicity: a subsequence string-kernel support vector machine with Nystrom landmarks.

Strings are the gapped windows of a sentence, in lower case and with common digit-for-letter swaps undone: letters from
the beginning of a word on, in that word, or on to the end of a later one over what stands between them (spaces, hyphens,
dots). The kernel of two strings counts the occurrences of the shorter one as a subsequence of the longer one, from its
first letter on, each weighted by decay for every letter in between (spare(m) of them at most), and by apart where the
window goes over more than one word. It comes twice, with that decay and with none (no letters in between, one word only),
so that the machine can tell what holds an insult from what is merely like one. So an insult matches with an ending, with letters put in, or spelt with gaps; a word that only looks like it lacks a letter
or its beginning, and doesn't.

Landmarks are windows of labelled sentences: beginnings of words that three toxic training texts of the sample have at
least and hardly a clean one (all labelled clean texts outside the held-out fold are counted), taken greedily until the
toxic texts are covered a few times or have no more of them, however many that takes. A sentence's features are its best
windows' kernel values with the landmarks, times the inverse root of the landmarks' kernel matrix (Nystrom). The kernel of two
windows is the inner product of their counts of subsequences, over those that are landmarks, so its matrix has no negative
eigenvalue. A linear SVM
with squared hinge loss is trained on labelled sentences by Newton steps: all sentences of clean texts are negative; a
toxic text is toxic for one of its sentences at least, so its worst sentence so far stands for it, chosen anew in each
round. A text's margin is that of its worst sentence, and a logistic curve makes it a score.

A landmark's windows are found for all texts of a piece at once: from every word with its first letter on, the next
letter within the gaps that are left, letter by letter. That finds every window that holds the landmark, and those that
don't have the value 0 by definition; nothing is filtered out.

The fit uses a bounded sample: cap labelled rows of each class, the first by a hash of doc_id, of each text the first
text_chars characters, and as many of these as sample_bytes hold; so no text takes another's place, however long it is. A
beginning in fewer than three toxic texts of the sample is no landmark. Equal and nearly equal texts count once; a longer
text that shares half its words with one before counts for the words that are new in it.

Defined cases: null, empty or white-space texts have no window and get the score of the bare bias; very long texts are
scored whole, sentence by sentence; if no landmark can be learnt (no toxic or no clean rows, an empty table) every score
is 0; equal texts, repeated rows among them, have equal scores, and rows that share a doc_id are scored each on its own
text; a doc_id with two labels is not learnt from, of one with two texts the smaller is; a null doc_id is scored but not learnt from; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import chunks, give_back, in_chunks, tidy
from ._common import columns, held_out, shared, training_keys
from .quality import Discriminant

SHORT, LONG = 3, 12  # letters of a landmark
_PLANE = 0x3000  # code points looked up; those beyond are letters
_LETTER = np.array([chr(c).isalpha() for c in range(_PLANE)])
_SWAP = np.zeros(128, np.uint32)
for _sign, _meant in zip("01345 7$@".replace(" ", ""), "oieastsa", strict=True):  # digits and signs that stand for letters
    _SWAP[ord(_sign)] = ord(_meant)


def spare(m: int) -> int:
    """Letters that may stand between those of a landmark of m letters."""
    return 1 if m < 6 else 2


class Letters(NamedTuple):
    """The letters of some texts: code points, whether a word begins there, the sentence; each sentence's text."""

    code: np.ndarray
    begins: np.ndarray
    sentence: np.ndarray
    text: np.ndarray


def letters_of(texts: list[bytes]) -> Letters:
    low = [t.decode("utf-8").lower() for t in texts]
    joined = "\n".join([*low, ""])
    data = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.where(data < _PLANE, _LETTER[np.minimum(data, _PLANE - 1)], True)
    swap = np.where(data < 128, _SWAP[np.minimum(data, 127)], 0)
    for _ in range(2):  # a sign before a letter, or two of them
        told = (swap[:-1] > 0) & letter[1:] & ~letter[:-1]
        letter = letter.copy()
        letter[:-1] |= told
    data = np.where(letter & (swap > 0), swap, data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    stop = (data == 46) | (data == 33) | (data == 63)
    ends = data == 10
    ends[:-1] |= stop[:-1] & space[1:]
    at = np.flatnonzero(letter)
    sentence = np.concatenate(([0], np.cumsum(ends)))  # of each place
    size = np.fromiter(map(len, low), np.int64, len(low)) + 1
    first = sentence[np.cumsum(size) - size]
    text = np.searchsorted(first, np.arange(sentence[-1] + 1), "right") - 1
    before = np.concatenate(([False], letter[:-1]))
    return Letters(data[at], ~before[at], sentence[at], text)


def kernel(window: np.ndarray, begins: np.ndarray, mark: np.ndarray, decay: float, apart: float) -> np.ndarray:
    """Of each row of windows (code points, 0 beyond the end), the value with the landmark.

    begins: where words begin, a column more than window. Occurrences within the first word count whole; those that go on
    and end with a word count times apart.
    """

    def occurrences(w: np.ndarray) -> np.ndarray:
        """Of each place, the occurrences that end there."""
        here = np.zeros(w.shape)
        here[:, 0] = w[:, 0] == mark[0]
        for c in mark[1:]:
            reach, after = np.zeros(len(w)), np.zeros_like(here)
            for i in range(1, w.shape[1]):
                reach = reach * decay + here[:, i - 1]  # all ends before i, by the letters between
                after[:, i] = reach * (w[:, i] == c)
            here = after
        return here

    first_word = np.concatenate((np.ones((len(window), 1), bool), np.cumsum(begins[:, 1:-1], 1) == 0), 1)
    return occurrences(np.where(first_word, window, 0)).sum(1) + apart * (occurrences(window) * (~first_word & begins[:, 1:])).sum(1)


def codes(word: str) -> np.ndarray:
    return np.array([ord(c) for c in word], np.uint32)


class Machine:
    """Landmarks, Nystrom maps of both kernels and a linear SVM."""

    def __init__(self, landmarks: list[str], decay: float = 0.9, apart: float = 0.9) -> None:
        self.landmarks = landmarks
        self.kernels = ((0.0, 0.0), (decay, apart))  # (decay, apart): without letters in between, and with
        self.marks = [codes(x) for x in landmarks]
        counts = [self.counts(*k) for k in self.kernels]
        self.roots = [c.T @ self.inverse_root(c @ c.T) for c in counts]  # from a window's own counts to its features
        self.weight, self.bias = np.zeros(2 * len(landmarks)), -1.0
        self.curve = (1.0, 0.0)

    def counts(self, decay: float, apart: float) -> np.ndarray:
        """How often each landmark (rows) holds each one (columns); times its own transpose, the kernel of the landmarks."""
        out = np.zeros((len(self.marks), len(self.marks)))
        for j, mark in enumerate(self.marks):
            longer = [i for i, x in enumerate(self.marks) if len(x) >= len(mark) and x[0] == mark[0]]
            width = len(mark) + spare(len(mark))
            window = np.zeros((len(longer), width), np.uint32)
            for row, i in enumerate(longer):
                window[row, : min(width, len(self.marks[i]))] = self.marks[i][:width]
            out[longer, j] = kernel(window, np.zeros((len(longer), width + 1), bool), mark, decay, apart)
        return out

    @staticmethod
    def inverse_root(gram: np.ndarray, least: float = 1e-6) -> np.ndarray:
        value, vector = np.linalg.eigh(gram)
        return vector @ np.diag(np.maximum(value, least) ** -0.5) @ vector.T

    def windows(self, letters: Letters) -> Iterator[tuple[int, np.ndarray]]:
        """(landmark, places in letters) of the windows that hold a landmark."""
        code = np.concatenate((letters.code, np.zeros(LONG + 8, np.uint32)))
        starts = np.flatnonzero(letters.begins)
        by = np.argsort(letters.code[starts], kind="stable")
        starts, heads = starts[by], letters.code[starts][by]
        for j, mark in enumerate(self.marks):
            start = starts[np.searchsorted(heads, mark[0]) : np.searchsorted(heads, mark[0], "right")]
            place, gaps = start, spare(len(mark))
            for k in range(1, len(mark)):
                limit = start + k + gaps
                found = np.full(len(start), -1)
                for d in range(gaps + 1, 0, -1):  # the nearest one is set last
                    hit = (code[place + d] == mark[k]) & (place + d <= limit)
                    found[hit] = place[hit] + d
                some = found >= 0
                start, place = start[some], found[some]
                if not len(start):
                    break
            if len(start):
                some = letters.sentence[place] == letters.sentence[start]
                if some.any():
                    yield j, start[some]

    def features(self, letters: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sentence, landmark, best windows' kernel values, a row for each kernel), each pair once; all others are 0."""
        sentence, landmark, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((2, 0))]
        last = len(letters.code) - 1
        for j, start in self.windows(letters):
            mark = self.marks[j]
            at = start[:, None] + np.arange(len(mark) + spare(len(mark)) + 1)
            inside = np.minimum(at, last)
            same = (at <= last) & (letters.sentence[inside] == letters.sentence[start][:, None])
            window, begins = np.where(same, letters.code[inside], 0)[:, :-1], letters.begins[inside] | ~same
            own, place = np.unique(letters.sentence[start], return_inverse=True)
            best = np.zeros((2, len(own)))
            for k, (decay, apart) in enumerate(self.kernels):
                np.maximum.at(best[k], place, kernel(window, begins, mark, decay, apart))
            sentence.append(own)
            landmark.append(np.full(len(own), j))
            value.append(best)
        return np.concatenate(sentence), np.concatenate(landmark), np.concatenate(value, 1)

    def nystrom(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sentence, feature rows) of the sentences with a landmark in them, and the text of every sentence."""
        letters = letters_of(texts)
        sentence, landmark, value = self.features(letters)
        own, place = np.unique(sentence, return_inverse=True)
        parts = []
        for x, root in zip(value, self.roots, strict=True):
            rows = np.zeros((len(own), len(self.marks)))
            rows[place, landmark] = x
            parts.append(rows @ root)
        return own, np.concatenate(parts, 1), letters.text

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """The margin of each text's worst sentence."""
        letters = letters_of(texts)
        sentence, landmark, value = self.features(letters)
        own = np.zeros(len(letters.text))
        for x, root, weight in zip(value, self.roots, np.split(self.weight, 2), strict=True):
            np.add.at(own, sentence, x * (root @ weight)[landmark])
        out = np.full(len(texts), -np.inf)
        of_text = letters.text < len(texts)
        np.maximum.at(out, letters.text[of_text], own[of_text])
        return np.where(np.isfinite(out), out, 0) + self.bias

    def fit(self, texts: list[bytes], labels: list[int], rounds: int = 4, inserted: float = 0.6) -> None:
        """inserted: the weight of the landmarks with a letter put in, and in two parts, beside the witnesses' weight of one."""
        y = np.array(labels)
        of, x = [np.zeros(0, np.int64)], [np.zeros((0, len(self.weight)))]
        for a, b in chunks(list(map(len, texts))):  # the text of each sentence with a landmark, and its features
            own, rows, text = self.nystrom(texts[a:b])
            of.append(text[own] + a)
            x.append(rows)
        of, x = np.concatenate(of), np.concatenate(x)
        negative = x[y[of] == 0]
        spoilt = [h[:k] + c + h[k:] for h in self.landmarks for k in range(1, len(h)) for c in ("x", "q", " ") if c not in h]
        extra_row, extra, _ = self.nystrom([s.encode() for s in spoilt])
        extra_cost = np.full(len(extra), inserted / max(1, len(extra)))
        margin = np.linalg.norm(x, axis=1)
        nothing = np.zeros((1, x.shape[1]))  # all sentences without a landmark are one negative example
        for _ in range(rounds):
            best: dict[int, int] = {}
            for i in np.flatnonzero(y[of] == 1).tolist():
                t = int(of[i])
                if t not in best or margin[i] > margin[best[t]]:
                    best[t] = i
            witness = np.array(sorted(best.values()), int)
            if not len(witness):
                return
            cost = np.concatenate((np.full(len(witness), 1 / len(witness)), extra_cost, np.full(len(negative), 1 / max(1, len(negative))), [0.3]))
            sign = np.repeat((1.0, -1.0), (len(witness) + len(extra), len(negative) + 1))
            self.weight, self.bias = train_svm(np.concatenate((x[witness], extra, negative, nothing)), sign, cost)
            margin = x @ self.weight + self.bias
        worst = np.full(len(texts), self.bias)
        np.maximum.at(worst, of, margin)
        told = (y == 0) | (worst >= 0)  # toxic texts without a witness say nothing about the curve
        self.curve = Discriminant._calibrate(np.minimum(worst[told], 1), y[told])

    def score(self, margin: np.ndarray) -> np.ndarray:
        """Margins above the SVM's target of one say no more: they are sums over landmarks that are forms of one word."""
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * np.minimum(margin, 1) + b, -30, 30)))


def train_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM with squared hinge loss (Newton steps)."""
    x = np.concatenate((x, np.ones((len(x), 1))), 1)
    w = np.zeros(x.shape[1])
    w[-1] = -1e-6
    active = None
    for _ in range(steps):
        now = y * (x @ w) < 1
        if active is not None and (now == active).all():
            break
        active = now
        own = x[active] * cost[active, None]
        w = np.linalg.solve(own.T @ x[active] + ridge * np.eye(len(w)), own.T @ y[active])
    return w[:-1], float(w[-1])


def words_of(texts: list[bytes]) -> list[set[str]]:
    """The distinct words of each text as the windows see them, first LONG letters only: what a landmark can be."""
    letters = letters_of(texts)
    edge = np.append(np.flatnonzero(letters.begins), len(letters.code))
    word = letters.code.tobytes().decode("utf-32-le", "surrogatepass")
    own = letters.text[letters.sentence[edge[:-1]]] if len(letters.code) else []
    out: list[set[str]] = [set() for _ in texts]
    one: dict[str, str] = {}  # a word of many texts is held once
    for a, b, t in zip(edge[:-1].tolist(), edge[1:].tolist(), np.asarray(own).tolist(), strict=True):
        if b - a >= SHORT:
            head = word[a : min(b, a + LONG)]
            out[t].add(one.setdefault(head, head))
    return out


def heads_of(word: str) -> list[str]:
    """The windows of one word that may be landmarks."""
    return [word[:k] for k in range(SHORT, min(len(word), LONG) + 1)]


def without_copies(bags: list[set[str]], size: int = 24, short: int = 40) -> list[set[str]]:
    """The words that each text brings, copies counted once.

    A text of few words (short) is a copy only if nine tenths of all words of both are common to it and one before: what
    tells short texts of one pattern apart may be the insult. A longer one is a near copy if it shares half of its
    smallest word hashes with one before, and counts for the words that the other one lacks.
    """
    out: list[set[str]] = []
    kept: list[set[str]] = []
    holders: dict[int, list[int]] = {}
    for bag in bags:
        sketch = sorted(zlib.crc32(u.encode("utf-8", "surrogatepass")) for u in bag)[:size]
        near = Counter(i for h in sketch for i in holders.get(h, ()))
        alike = [i for i, n in near.items() if 2 * n >= len(sketch)]
        if len(bag) <= short:
            if any(len(bag & kept[i]) >= 0.9 * len(bag | kept[i]) for i in alike):
                continue
        elif alike:
            new = bag - kept[max(alike, key=lambda i: (near[i], -i))]
            if new:
                out.append(new)
            continue
        for h in sketch:
            holders.setdefault(h, []).append(len(kept))
        kept.append(bag)
        out.append(bag)
    return out


def pure(toxic: int, clean: int, ratio: float, purity: float = 0.9) -> bool:
    """Whether toxic texts, at ratio clean texts each, hold a head so much more often than clean ones."""
    return toxic * ratio / (toxic * ratio + clean * 4) >= purity


def candidates(toxic: list[set[str]], clean: list[set[str]], support: int = 3) -> set[str]:
    """Heads that support toxic texts hold, and hardly a clean one of the sample.

    Support doesn't grow with the sample, so that a rare insult or one of a minority language counts like any other;
    what is in so few toxic texts by chance is told by the clean texts of the whole corpus (clean_counts).
    """
    heads = lambda bag: {h for w in bag for h in heads_of(w)}
    found: Counter[str] = Counter()
    for bag in toxic:
        found.update(heads(bag))
    found = Counter({h: n for h, n in found.items() if n >= support})
    other: Counter[str] = Counter()
    for bag in clean:
        other.update(heads(bag) & found.keys())
    ratio = max(1, len(clean)) / max(1, len(toxic))
    return {h for h, n in found.items() if pure(n, other[h], ratio)}


def choose_landmarks(toxic: list[set[str]], clean: dict[str, int], n_clean: int, support: int = 3, cover: int = 3) -> list[str]:
    """Of the heads in clean (with the clean texts that hold them, of n_clean), those that mark toxic texts: greedily,
    until each text has cover of them or its own are used up. Nothing but the sample bounds their number.

    Texts that have cover already are no evidence for a further head, so it is held against the clean texts anew.
    """
    ratio = max(1, n_clean) / max(1, len(toxic))
    heads = lambda bag: {h for w in bag for h in heads_of(w)}
    whole: Counter[str] = Counter(h for bag in toxic for h in heads(bag) & clean.keys())
    good = {h for h, n in whole.items() if pure(n, clean[h], ratio)}
    found: list[str] = []
    left = [[x, cover] for bag in toxic if (x := heads(bag) & good)]
    while left:
        tally = Counter(h for x, _ in left for h in x)
        tally = Counter({h: n for h, n in tally.items() if n >= support and pure(n, clean[h], ratio)})
        if not tally:  # what is left is for texts that have none yet
            left = [x for x in left if x[1] == cover]
            tally = Counter(h for x, _ in left for h in x)
            if not tally:
                break
        most_common = max(tally.values())
        # of those nearly as common, the longest says most
        best = max((h for h in tally if tally[h] >= 0.9 * most_common), key=lambda h: (len(h), tally[h], h))
        found.append(best)
        for x in left:
            if best in x[0]:
                x[1] -= 1
                # its shorter and longer forms say the same
                x[0] = {h for h in x[0] if not (h.startswith(best) or best.startswith(h))} if x[1] else set()
        left = [x for x in left if x[0]]
    return found


def clean_counts(docs: DataFrame, labels: DataFrame, heads: set[str]) -> tuple[dict[str, int], int]:
    """How many clean training texts hold each head, and how many there are: all labelled ones, not the sample's.

    Each text becomes the few heads it holds before it meets its label. Equal texts count once.
    """
    sent = shared(docs.sparkSession, heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent()
        stems = {h[:SHORT] for h in wanted}
        hits: dict[str, list[str]] = {}
        for batch in batches:
            for begin, texts in in_chunks(batch.column("text")):
                held = []
                for bag in words_of(texts):
                    own = {""}  # "" is in every text
                    for w in bag:
                        if w[:SHORT] in stems:
                            if w not in hits:
                                hits[w] = [h for h in heads_of(w) if h in wanted]
                            own.update(hits[w])
                    held.append(list(own))
                if len(hits) > 400_000:
                    hits.clear()
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(begin, len(texts)) for c in ("doc_id", "copy")), pa.array(held, pa.list_(pa.string()))], ["doc_id", "copy", "heads"])

    clean = labels.where("toxic = 0").select(labels["doc_id"].cast("bigint").alias("doc_id")).where(~held_out(F.col("doc_id"))).distinct()
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("copy")).mapInArrow(tidy(run), "doc_id long, copy long, heads array<string>").join(clean, "doc_id")
    rows = texts.select("copy", F.explode("heads").alias("head")).distinct().groupBy("head").agg(F.count(F.lit(1)).alias("n")).collect()  # candidates only
    found = {r["head"]: r["n"] for r in rows}
    return {h: found.get(h, 0) for h in heads}, found.get("", 0)


def train(docs: DataFrame, labels: DataFrame, cap: int = 2000, sample_bytes: int = 8 << 20, text_chars: int = 16 << 10) -> Machine | None:
    """A machine from labelled rows; cap bounds the texts of each class, text_chars what one text brings and sample_bytes
    what they bring together, and with them what reaches the driver."""
    try:
        return _trained(docs, labels, cap, sample_bytes, text_chars)
    finally:
        give_back()


def _trained(docs: DataFrame, labels: DataFrame, cap: int, sample_bytes: int, text_chars: int) -> Machine | None:
    keys = training_keys(labels.where("toxic IN (0, 1)"), "toxic", cap)
    chosen = docs.join(F.broadcast(keys), "doc_id").where("text IS NOT NULL").select("doc_id", "y", F.substring("text", 1, text_chars).alias("text"))  # 2 * cap rows
    chosen = chosen.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # of a doc_id's texts, the same one in every run
    chosen = chosen.withColumn("so_far", F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")))
    sample = chosen.where(F.col("so_far") <= sample_bytes).select("doc_id", "y", "text").orderBy("doc_id").collect()
    texts, y = [r["text"].encode() for r in sample], [r["y"] for r in sample]
    del sample
    if len(set(y)) < 2:
        return None
    bags = [bag for a, b in chunks(list(map(len, texts))) for bag in words_of(texts[a:b])]
    toxic, clean = (without_copies([bag for bag, label in zip(bags, y, strict=True) if label == k]) for k in (1, 0))
    heads = candidates(toxic, clean)
    if not heads:
        return None
    landmarks = choose_landmarks(toxic, *clean_counts(docs, labels, heads))
    if not landmarks:
        return None
    del bags, toxic, clean, heads
    machine = Machine(landmarks)
    machine.fit(texts, y)
    return machine


def predict(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """(doc_id, score) of every whole text."""
    sent = shared(docs.sparkSession, machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent()
        for batch in batches:
            for begin, texts in in_chunks(batch.column("text")):
                score = found.score(found.margins(texts)) if found else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, len(texts)), pa.array(score)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, cap: int = 2000, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted): learnt outside the held-out fold, scored for every text."""
    docs = columns(docs, "doc_id", "text")
    out = predict(docs, train(docs, labels, cap))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
