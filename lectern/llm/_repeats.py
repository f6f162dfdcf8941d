"""Repeated windows of W units (words or bytes): which texts to hold against which, without a row for every window.

Each window is filed under its minimiser: the leftmost smallest hash among its k-unit grams. Consecutive windows with
one minimiser form a segment, so every window lies in exactly one segment, and windows that are equal have equal
minimisers at equal offsets. A minimiser that occurs once in all texts has no repeated window.

  1 (g, doc_id) of every segment's minimiser; those that occur once go (counted with a partial aggregation, joined back)
  2 the segments that are left are cut out of their texts, bytes and all, and dealt out by minimiser. A task sends each
    distinct piece once, with its first and last place, however many copies of it the task has (a form)
  3 whole minimisers meet in a task, which finds the repeated windows on the bytes themselves (the operators, each in its
    own way), for each form the windows and the first place of each
  4 the places of every form take these over, and every text gets its runs of repeated windows

A minimiser with more forms than a task should hold is dealt out anew, by the whole window instead: a further digit,
after which a group is one window. Nothing is decided by the size of a group, and no group is held beyond split_rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import _ODD, _SEED, U, Block, eights, in_chunks, mix, run_hashes, sliding_min, tidy, window_hashes
from ._common import drop_scratch, scratch_path, shuffles_freed

_POSITION = U(31)  # bits that a position takes beside the truncated hash; fixed, so that ties fall alike everywhere
#: A form has piece; a place of a form has no piece. key, pid: minimiser and hash of the piece.
ROWS = "key long, pid long, doc_id long, start int, row long, n int, last_doc long, last_start int, piece binary"
#: n windows of a form from window j on, which start first in first_doc at first_start (and on, window by window).
RUNS = "key long, pid long, j int, n int, first_doc long, first_start int"


class Units(NamedTuple):
    """Units of some texts: hashes of their grams, first unit and number of units by text, bytes [low, high) of each."""

    grams: np.ndarray
    first: np.ndarray
    size: np.ndarray
    data: np.ndarray
    low: np.ndarray
    high: np.ndarray


def byte_units(texts: list[bytes], gram: int) -> Units:
    block = Block(texts)
    total = max(0, len(block.data) - gram + 1)
    eight = eights(block.data)
    grams = np.full(total, _SEED[0])
    for k in [*range(0, gram - 8, 8), gram - 8]:
        grams = mix(grams * _ODD[1] ^ eight[k : k + total] * _ODD[0])
    at = np.arange(len(block.data))
    return Units(grams, block.first, block.length, block.data, at, at + 1)


def word_units(texts: list[bytes], gram: int) -> Units:
    """Words, with the white space between them turned into one space each."""
    block = Block(texts)
    starts, ends = block.words()
    doc = block.document(starts)
    first = np.searchsorted(doc, np.arange(block.n))
    size = np.searchsorted(doc, np.arange(block.n), "right") - first
    length = ends - starts
    high = np.cumsum(length + 1) - 1
    data = np.full(int(high[-1]) + 1 if len(high) else 0, 32, np.uint8)
    step = steps(length)
    data[np.repeat(high - length, length) + step] = block.data[np.repeat(starts, length) + step]
    return Units(window_hashes(run_hashes(block.data, starts, ends), gram), first, size, data, high - length, high)


def steps(counts: np.ndarray) -> np.ndarray:
    """0 .. count-1 for each count."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def find_segments(u: Units, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(g, text, first window, number of windows) of each segment; windows are numbered by their first unit, over all texts."""
    total = len(u.grams) + gram - 1
    none = np.zeros(0, np.int64)
    step = np.zeros(total + 1, np.int32)
    own = u.size >= width
    if total < width or not own.any():
        return none.view(U), none, none, none
    least = sliding_min((u.grams >> _POSITION << _POSITION) | np.arange(len(u.grams)).astype(U), width - gram + 1)
    np.add.at(step, u.first[own], 1)
    np.add.at(step, u.first[own] + u.size[own] - width + 1, -1)
    window = np.flatnonzero(np.cumsum(step)[: total - width + 1])
    anchor = (least[window] & ((U(1) << _POSITION) - U(1))).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    begin = np.flatnonzero(new)
    start = window[begin]
    return mix(u.grams[anchor[begin]]), np.searchsorted(u.first, start, "right") - 1, start, np.diff(np.append(begin, len(window)))


def minimisers(docs: DataFrame, units: Callable, width: int, gram: int, buffer: int = 1_000_000) -> DataFrame:
    """(g, doc_id, n): how often each text has each minimiser, a row for each text."""

    def tally(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        g, text, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((text, g))
        g, text = g[order], text[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        return pa.RecordBatch.from_arrays([pa.array(g[at].view(np.int64)), pa.array(ids[order][at]), pa.array(np.diff(np.append(at, len(g))), pa.int32())], ["g", "doc_id", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, texts_before = [], 0, 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for begin, texts in in_chunks(batch.column("text")):
                g, text, _, _ = find_segments(units(texts, gram), width, gram)
                held.append((g, text + texts_before, ids[begin:][text]))
                rows += len(g)
                texts_before += len(texts)
                if rows >= buffer:
                    yield tally(held)
                    held, rows = [], 0
        if rows:
            yield tally(held)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "g long, doc_id long, n int")


class _Forms:
    """Collects pieces and their places; equal pieces become one form with its first and last place."""

    def __init__(self, limit: int = 16 << 20) -> None:
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.bytes = 0
        self.places: list[tuple] = []

    def add(self, keys, pids, docs, starts, rows, n, last, pieces: list[bytes]) -> None:
        """last: (last_doc, last_start) of each, or None where the place given is the only one."""
        number = np.empty(len(pieces), np.int64)
        for i, piece in enumerate(pieces):
            number[i] = self.at.setdefault(piece, len(self.at))
            self.bytes += len(piece)
        self.places.append((number, keys, pids, docs, starts, rows, n, *(last or (docs, starts))))

    def unique(self) -> tuple:
        """(keys, pids, n, doc, start, last_doc, last_start, pieces) of each form."""
        number, keys, pids, docs, starts, _, n, last_doc, last_start = (np.concatenate(x) for x in zip(*self.places, strict=True))
        low = np.lexsort((starts, docs, number))
        first = low[np.flatnonzero(np.diff(number[low], prepend=-1))]
        high = np.lexsort((last_start, last_doc, number))
        last = high[np.flatnonzero(np.diff(number[high], append=-1))]
        return keys[first], pids[first], n[first], docs[first], starts[first], last_doc[last], last_start[last], list(self.at)

    def batches(self, with_places: bool = True) -> Iterator[pa.RecordBatch]:
        if not self.places:
            return
        names = [f.split()[0] for f in ROWS.split(", ")]
        if with_places:
            for _, keys, pids, docs, starts, rows, *_ in self.places:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(pids), pa.array(docs), pa.array(starts, pa.int32()), pa.array(rows), *(pa.nulls(len(keys), t) for t in (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names)
        keys, pids, n, doc, start, last_doc, last_start, pieces = self.unique()
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(pids), pa.array(doc), pa.array(start, pa.int32()), pa.nulls(len(keys), pa.int64()), pa.array(n, pa.int32()), pa.array(last_doc), pa.array(last_start, pa.int32()), pa.array(pieces, pa.binary())],
            names,
        )
        self.clear()


def merged(table: pa.Table) -> tuple:
    """The distinct forms of a table, of which several tasks may have sent one."""
    keys, pids, docs, starts, n, last_doc, last_start = (table.column(c).to_numpy() for c in ("key", "pid", "doc_id", "start", "n", "last_doc", "last_start"))
    forms = _Forms()
    forms.add(keys, pids, docs, starts, keys, n, (last_doc, last_start), table.column("piece").to_pylist())
    return forms.unique()


def cut_out(docs: DataFrame, units: Callable, width: int, gram: int) -> DataFrame:
    """The forms of the segments under the minimisers in gs, and their places (ROWS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = _Forms()
        for batch in batches:
            ids, rows = (batch.column(c).to_numpy() for c in ("doc_id", "row"))
            lists = batch.column("gs")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(U)
            for begin, texts in in_chunks(batch.column("text")):
                u = units(texts, gram)
                g, text, start, n = find_segments(u, width, gram)
                own = offsets[begin : begin + len(texts) + 1]
                tag = lambda g, text: mix(g ^ mix(text.astype(U)))  # noqa: E731 - a false hit is one segment too many
                some = np.flatnonzero(np.isin(tag(g, text), tag(values[own[0] : own[-1]], np.repeat(np.arange(len(texts)), np.diff(own)))))
                if not len(some):
                    continue
                g, text, start, n = g[some], text[some], start[some], n[some]
                low, high = u.low[start], u.high[start + n - 2 + width]
                data = u.data.tobytes()
                pieces = [data[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                forms.add(g.view(np.int64), run_hashes(u.data, low, high, 1).view(np.int64), ids[begin:][text], start - u.first[text], rows[begin:][text], n, None, pieces)
                if forms.bytes >= forms.limit:
                    yield from forms.batches()
        yield from forms.batches()

    return docs.select("doc_id", "row", "text", "gs").mapInArrow(tidy(run), ROWS)


def windows_of(forms: DataFrame, cut: Callable) -> DataFrame:
    """The windows of forms as forms of one window; a place names the form (doc_id: its key, row: its pid) and the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        out = _Forms()
        for batch in batches:
            n = batch.column("n").to_numpy()
            j = steps(n)
            key, pid, doc, start, last_doc, last_start = (np.repeat(batch.column(c).to_numpy(), n) for c in ("key", "pid", "doc_id", "start", "last_doc", "last_start"))
            pieces = [w for p, k in zip(batch.column("piece").to_pylist(), n.tolist(), strict=True) for w in cut(p, k)]
            wide = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), "<i8").reshape(-1, 2)
            names = [f.split()[0] for f in ROWS.split(", ")]
            none = len(pieces)
            yield pa.RecordBatch.from_arrays([pa.array(wide[:, 0].copy()), pa.array(wide[:, 1].copy()), pa.array(key), pa.array(j, pa.int32()), pa.array(pid), *(pa.nulls(none, t) for t in (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names)
            out.add(wide[:, 0].copy(), wide[:, 1].copy(), doc, start + j, pid, np.ones(none, np.int32), (last_doc, last_start + j), pieces)
            if out.bytes >= out.limit:
                yield from out.batches(False)
        yield from out.batches(False)

    return forms.select("key", "pid", "doc_id", "start", "n", "last_doc", "last_start", "piece").mapInArrow(tidy(run), ROWS)


def shards(table: pa.Table, limit: int) -> Iterator[pa.Table]:
    """Whole keys of a table sorted by key, of about limit bytes of pieces together: what fits a processor's cache is
    worked on many times faster."""
    keys = table.column("key").to_numpy()
    size = np.cumsum(pc.binary_length(table.column("piece")).to_numpy())
    change = np.flatnonzero(np.diff(keys)) + 1
    wanted = np.searchsorted(size, np.arange(limit, int(size[-1]), limit))
    after = np.searchsorted(change, wanted)
    edge = [0, *np.unique(change[after[after < len(change)]]).tolist(), len(keys)]
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield table.slice(a, b - a).combine_chunks()


def by_key(rows: DataFrame, work: Callable, limit: int, held_bytes: int = 4 << 20) -> DataFrame:
    """work(Arrow table) on shards of whole keys, of about limit bytes of pieces each (RUNS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.nbytes
            if size < held_bytes:
                continue
            table = pa.concat_tables(held).combine_chunks()
            keys = table.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # rows are sorted by key; the last key may go on
            for shard in shards(table.slice(0, cut), limit) if cut else ():
                yield from work(shard)
            held = [table.slice(cut)]
            size = held[0].nbytes if cut else size
        for shard in shards(pa.concat_tables(held).combine_chunks(), limit) if held else ():
            yield from work(shard)

    return rows.drop("row").repartition("key").sortWithinPartitions("key").mapInArrow(tidy(run), RUNS)


def runs_batch(key, pid, j, first_doc, first_start) -> pa.RecordBatch:
    """Windows (key, pid, j; each once, in any order) as runs: of one form, side by side, first places side by side or, without first_start, of one text."""
    order = np.lexsort((j, pid, key))
    key, pid, j, first_doc = key[order], pid[order], j[order], first_doc[order]
    first_start = first_start[order] if first_start is not None else np.full(len(j), -1)
    new = np.ones(len(j), bool)
    side = (first_start[1:] - first_start[:-1] == 1) | (first_start[1:] < 0)
    new[1:] = ~((key[1:] == key[:-1]) & (pid[1:] == pid[:-1]) & (j[1:] - j[:-1] == 1) & (first_doc[1:] == first_doc[:-1]) & side)
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(j)))
    return pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(pid[at]), pa.array(j[at], pa.int32()), pa.array(n, pa.int32()), pa.array(first_doc[at]), pa.array(first_start[at], pa.int32())], [f.split()[0] for f in RUNS.split(", ")])


def repeated_runs(docs: DataFrame, units: Callable, width: int, gram: int, work: Callable, cut: Callable, within: bool, limit: int, split_rows: int) -> DataFrame:
    """(doc_id, text, runs): every row of docs (doc_id, text) with its runs (start, n) of repeated windows; null without.

    work: finds the repeated windows of forms; cut(piece, n): the n windows of a piece; within: an earlier place in the
    same document counts as well.
    """
    spark = docs.sparkSession
    tables: dict[str, str] = {}

    def stored(df: DataFrame, name: str) -> DataFrame:
        tables[name] = scratch_path(spark, name)
        with shuffles_freed(spark):
            df.write.option("compression", "zstd").parquet(tables[name])
        return spark.read.schema(df.schema).parquet(tables[name])

    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")

    grams = stored(minimisers(known, units, width, gram), "minimisers")
    several = grams.groupBy("g").agg((F.sum("n") if within else F.count(F.lit(1))).alias("n")).where("n > 1").select("g")
    lists = grams.join(several.hint("merge"), "g", "left_semi").groupBy("doc_id").agg(F.collect_set("g").alias("gs"))
    lists = stored(lists, "lists")
    drop_scratch(spark, tables["minimisers"])
    rows = stored(cut_out(known.join(lists, "doc_id"), units, width, gram), "forms")
    drop_scratch(spark, tables["lists"])

    forms, places = rows.where("piece IS NOT NULL"), rows.where("piece IS NULL").select("key", "pid", "doc_id", "start", "row")
    crowded = stored(forms.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > split_rows).select("key"), "crowded")
    if crowded.isEmpty():
        runs = by_key(forms, work, limit)
    else:
        single = stored(windows_of(forms.join(crowded, "key", "left_semi"), cut), "windows")
        of_single = by_key(single.where("piece IS NOT NULL"), work, limit)
        named = single.where("piece IS NULL").select("key", "pid", F.col("doc_id").alias("form_key"), F.col("row").alias("form"), F.col("start").alias("window"))
        of_single = named.join(of_single, ["key", "pid"]).select(F.col("form_key").alias("key"), F.col("form").alias("pid"), F.col("window").alias("j"), "n", "first_doc", "first_start")
        # a form that several tasks sent has its windows named by each
        runs = by_key(forms.join(crowded, "key", "left_anti"), work, limit).unionByName(of_single.distinct())
    earlier = F.col("first_doc") < F.col("doc_id")
    if within:
        earlier |= (F.col("first_doc") == F.col("doc_id")) & (F.col("first_start") < F.col("start") + F.col("j"))
    found = places.join(runs, ["key", "pid"]).where(earlier).select("doc_id", "row", F.struct((F.col("start") + F.col("j")).alias("start"), "n").alias("run"))
    found = stored(found.groupBy("doc_id", "row").agg(F.collect_list("run").alias("runs")), "runs")
    for name in tables.keys() - {"runs"}:
        if name not in ("minimisers", "lists"):
            drop_scratch(spark, tables[name])
    return docs.join(found, ["doc_id", "row"], "left").select("doc_id", "text", "runs")


def cover(starts: np.ndarray, lengths: np.ndarray, total: int) -> np.ndarray:
    """Which of total units lie in one of the runs."""
    step = np.zeros(total + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + lengths, total), -1)
    return np.cumsum(step)[:total] > 0


def run_arrays(column) -> Callable[[int], tuple[np.ndarray, np.ndarray]]:
    """(starts, lengths) of the runs of each row of a list column."""
    offsets = column.offsets.to_numpy()
    start, n = (column.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
    null = column.is_null().to_numpy(zero_copy_only=False)

    def row(i: int) -> tuple[np.ndarray, np.ndarray]:
        if null[i]:
            return start[:0], n[:0]
        return start[offsets[i] : offsets[i + 1]], n[offsets[i] : offsets[i + 1]]

    return row
