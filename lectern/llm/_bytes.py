"""Texts as numpy byte arrays: words, hashes and sliding minima without per-character Python."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np

U = np.uint64
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True  # the ASCII white space of the contracts
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_ODD = (U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F))  # one for each lane
_SEED = (U(0x9E3779B97F4A7C15), U(0x2545F4914F6CDD1D))
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], U)  # the first k bytes of eight


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of runs of bytes: eight bytes at a time go through mix(), so that strings of a pattern don't meet.

    The two lanes are independent hashes.
    """
    eight, left, at = eights(data), ends - starts, starts
    h = mix(left.astype(U) + _SEED[lane])
    live = np.flatnonzero(left > 0)
    left, at = left[live], at[live]
    while len(live):
        h[live] = mix(h[live] * _ODD[1 - lane] ^ (eight[at] & _HEAD[np.minimum(left, 8)]) * _ODD[lane])
        more = left > 8
        live, left, at = live[more], left[more] - 8, at[more] + 8
    return h


def same_runs(data: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether the run of bytes from a to a_end is the one from b to b_end, byte by byte."""
    eight, left = eights(data), a_end - a
    same = left == b_end - b
    live = np.flatnonzero(same & (left > 0))
    a, b, left = a[live], b[live], left[live]
    while len(live):
        equal = (eight[a] ^ eight[b]) & _HEAD[np.minimum(left, 8)] == 0
        same[live[~equal]] = False
        more = equal & (left > 8)
        live, a, b, left = live[more], a[more] + 8, b[more] + 8, left[more] - 8
    return same


def window_hashes(units: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """Hash of units[i : i + width] for each i, unit by unit through mix()."""
    total = len(units) - width + 1
    if total <= 0:
        return np.zeros(0, U)
    h = np.full(total, _SEED[lane] + U(width))
    for k in range(width):
        h = mix(h * _ODD[1 - lane] ^ units[k : k + total] * _ODD[lane])
    return h


class Block:
    """Some documents' bytes one after another, with a newline after each (it belongs to none)."""

    def __init__(self, texts: list[bytes], lower: bool = False) -> None:
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            self.data = LOWER[self.data]
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.concatenate(([0], np.cumsum(self.length + 1)[:-1])).astype(np.int64)
        self.n = len(texts)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs without white space; none reaches past its document."""
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[:-1] = ~SPACE[self.data]
        step = np.diff(inside, prepend=np.int8(0))
        return np.flatnonzero(step == 1), np.flatnonzero(step == -1)

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1


def chunks(sizes: list[int], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about limit bytes together; a longer document stands alone and whole."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n + 1
    if begin < len(sizes):
        yield begin, len(sizes)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for each i, by doubling."""
    have = 1
    total = len(x) - width + 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:total], x[width - have : width - have + total])


def in_chunks(column, limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first row, texts) for bounded pieces of an Arrow text column; null reads as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    data = column.cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(data), 0).to_pylist()
    for a, b in chunks(sizes, limit):
        yield a, [t or b"" for t in data.slice(a, b - a).to_pylist()]


def give_back() -> None:
    """Give the system back the memory that this process holds on to and doesn't use."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def tidy(run: Callable) -> Callable:
    """run, and afterwards give_back(), as Python workers are used again."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def shingles(texts: list[bytes], k: int = 5, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every k-word shingle in order of place; with fewer words, of the whole sequence."""
    block = Block(texts, lower=True)
    starts, ends = block.words()
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, U)
    words = run_hashes(block.data, starts, ends, lane)
    doc = block.document(starts)
    first = np.searchsorted(doc, np.arange(block.n))
    count = np.searchsorted(doc, np.arange(block.n), "right") - first
    at = np.arange(len(doc))
    full = np.flatnonzero(at + k <= (first + count)[doc])
    owner, keys = [doc[full]], [window_hashes(words, k, lane)[full]]
    for n in range(1, k):  # texts of n words
        short = first[count == n]
        if len(short):
            owner.append(doc[short])
            keys.append(window_hashes(words, n, lane)[short])
    owner, keys = np.concatenate(owner), np.concatenate(keys)
    order = np.argsort(owner, kind="stable")
    return owner[order], keys[order]


def shingle_sets(texts: list[bytes], k: int = 5, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles, sorted by document and hash."""
    owner, keys = shingles(texts, k, lane)
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], keys[new]


def exact_shingles(text: bytes, k: int = 5) -> set[tuple[bytes, ...]]:
    """The shingles themselves; bytes.lower() folds A-Z only."""
    words = WORD.findall(bytes(text).lower())
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()
