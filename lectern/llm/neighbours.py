"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

  tree    k-means with a few centres, again within each of them, until a node holds leaf_rows of the sample's share. It is
          fitted on a bounded sample (sample_rows, the first by a hash of vec_id); its size follows the sample's
  index   every vector goes down the tree to a leaf. Leaves that lie side by side in the tree make up bins of about equal
          size, by the leaves' counts over all rows; a leaf beyond a bin's size is split over several by a hash of vec_id
  search  a query keeps the tree's nodes in a priority queue, the one with the largest inner product with its centre
          first: inner nodes give way to their children, leaves are visited. It meets the bins of the leaves it visits,
          which work out all inner products there in double precision and keep the query's best; the bins' best meet
  visits  how many leaves a query visits is widened until the exact neighbours of calibration vectors (a bounded number of
          the queries, held against all rows) lie in visited leaves for the share `recall`

Equal vectors are one point with several ids: of one point only the k + 1 smallest ids can be among a query's k nearest,
as ties go to the smaller id, so a task sends no more of them and a vector that a third of the rows have makes no bin hot.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither do those
whose length isn't the commonest one (the shorter of two), nor rows without vec_id; equal scores stand by vec_id;
repeated rows count once; where rows with one vec_id differ, each is a form of it, as a query and as a candidate, and the
nearest forms count; with fewer than k candidates all are returned; an empty table, or one without queries, gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import tidy
from ._common import shared, written

BEST = "query_id long, vec_id long, score double"


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products added up in one order whatever stands beside a vector, so that equal vectors tie."""
    return (vectors * query).sum(axis=-1)


class Tree(NamedTuple):
    """centre of each node, its first child and the number of them (0: a leaf), each leaf's number, how many there are."""

    centre: np.ndarray
    child: np.ndarray
    children: np.ndarray
    leaf: np.ndarray
    leaves: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: from the root to the nearest child each time."""
        node = np.zeros(len(x), np.int64)
        half = (self.centre**2).sum(1) / 2
        open_ = np.arange(len(x)) if self.children[0] else np.arange(0)
        while len(open_):
            at = np.zeros(len(open_), np.int64)
            for parent in np.unique(node[open_]).tolist():
                own = np.flatnonzero(node[open_] == parent)
                kids = np.arange(self.child[parent], self.child[parent] + self.children[parent])
                near = x[open_[own]] @ self.centre[kids].T - half[kids]
                at[own] = kids[near.argmax(1)]
            node[open_] = at
            open_ = open_[self.children[at] > 0]
        return self.leaf[node]

    def order(self, query: np.ndarray, visits: int) -> list[int]:
        """The first leaves that a best-bin-first traversal visits."""
        near, child, children, leaf = (a.tolist() for a in (-(self.centre @ query), self.child, self.children, self.leaf))
        queue, found = [(near[0], 0)], []
        while queue and len(found) < visits:
            _, node = heapq.heappop(queue)
            if not children[node]:
                found.append(leaf[node])
            for kid in range(child[node], child[node] + children[node]):
                heapq.heappush(queue, (near[kid], kid))
        return found


def fit(x: np.ndarray, leaf_rows: int, branching: int, rounds: int = 8, seed: int = 11) -> Tree:
    """A tree over a sample; a node with leaf_rows vectors, or that can't be told apart, is a leaf."""
    rng = np.random.default_rng(seed)
    centre, child, children = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [0], [0]
    queue = [(0, np.arange(len(x)))]
    for node, own in queue:
        if len(own) <= leaf_rows:
            continue
        points = x[own]
        means = points[rng.choice(len(own), branching, replace=False)]
        for _ in range(rounds):
            near = (points @ means.T - (means**2).sum(1) / 2).argmax(1)
            sums = np.zeros_like(means)
            np.add.at(sums, near, points)
            count = np.bincount(near, minlength=branching)
            means = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], means)
        near = (points @ means.T - (means**2).sum(1) / 2).argmax(1)
        kept = np.unique(near)
        if len(kept) < 2:
            continue
        child[node], children[node] = len(centre), len(kept)
        for k in kept.tolist():
            queue.append((len(centre), own[near == k]))
            centre.append(means[k])
            child.append(0)
            children.append(0)
    children_, child_ = np.array(children), np.array(child)
    leaf, n, walk = np.full(len(centre), -1), 0, [0]
    while walk:  # depth first, so that leaves side by side are near each other
        node = walk.pop()
        if children_[node]:
            walk += range(child_[node] + children_[node] - 1, child_[node] - 1, -1)
        else:
            leaf[node] = n
            n += 1
    return Tree(np.array(centre), child_, children_, leaf, n)


def usable(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """(vec_id, v array<double>) of the vectors that take part, their length and their number."""
    v = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = vectors.select(vectors["vec_id"].cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & sound)
    most = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "size").first()
    size, n = (most["size"], most["n"]) if most else (0, 0)
    return rows.where(F.size("v") == size), size, n


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def first_ids(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The places of each distinct vector's k smallest distinct ids."""
    _, point = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * 8}").ravel(), return_inverse=True)
    order = np.lexsort((ids, point))
    p, i = point[order], ids[order]
    new = np.ones(len(order), bool)
    new[1:] = (p[1:] != p[:-1]) | (i[1:] != i[:-1])
    order, p = order[new], p[new]
    begin = np.flatnonzero(np.diff(p, prepend=-1))
    rank = np.arange(len(p)) - np.repeat(begin, np.diff(np.append(begin, len(p))))
    return np.sort(order[rank < k])


def top(query_row: np.ndarray, query_id: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of each query row's k best ids, its own left out, ties to the smaller id; an id counts once, at its best."""
    order = np.lexsort((ids, -scores, query_row))
    order = order[ids[order] != query_id[order]]
    pair = np.lexsort((np.arange(len(order)), ids[order], query_row[order]))  # an id's forms, the best first
    r, i = query_row[order][pair], ids[order][pair]
    new = np.ones(len(pair), bool)
    new[1:] = (r[1:] != r[:-1]) | (i[1:] != i[:-1])
    order = order[np.sort(pair[new])]
    r = query_row[order]
    begin = np.flatnonzero(np.diff(r, prepend=-1))
    rank = np.arange(len(r)) - np.repeat(begin, np.diff(np.append(begin, len(r))))
    return order[rank < k]


def candidates(queries: np.ndarray, ids: np.ndarray, forms: int, x: np.ndarray, k: int, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, place in x, score) of what may be among each query's k nearest of x (where seen): a fast product finds
    the k-th, and all within its error of that are worked out exactly. forms: places that an id takes at most."""
    near = queries @ x.T
    if seen is not None:
        near[~seen] = -np.inf
    wanted = (k + 1) * forms
    hit = np.ones(near.shape, bool) if seen is None else seen
    if len(ids) > wanted:
        least = np.partition(near, len(ids) - wanted, axis=1)[:, len(ids) - wanted]
        slack = 1e-12 * (1 + np.abs(x).max() * np.abs(queries).max(1) * x.shape[1])
        hit = hit & (near >= (least - slack)[:, None])
    row, at = np.nonzero(hit)
    return row, at, exact(queries[row], x[at])


def most_forms(ids: np.ndarray) -> int:
    return int(np.unique(ids, return_counts=True)[1].max()) if len(ids) else 1


class Index:
    """The tree, the bins of its leaves, and the vectors as a table of bins."""

    def __init__(self, vectors: DataFrame, k: int = 20, sample_rows: int = 50_000, sample_bytes: int = 32 << 20, leaf_rows: int = 128, branching: int = 8, bin_rows: int = 32_768) -> None:
        self.rows, self.size, n = usable(vectors)
        self.spark, self.k = vectors.sparkSession, k
        if not n:
            return
        place, sample_rows = F.xxhash64("vec_id"), min(sample_rows, max(1, sample_bytes // (8 * self.size)))
        # the share of the hashes that gives about sample_rows, however many rows there are
        chosen = self.rows.where(F.pmod(place, F.lit(1 << 30)) < int(min(1.0, 1.1 * sample_rows / max(1, n)) * (1 << 30)))
        sample = chosen.orderBy(place, "vec_id").limit(sample_rows).select("v").toArrow().column("v").combine_chunks()
        x = matrix(sample, self.size)
        # a leaf is to hold about leaf_rows of all rows; the sample bounds how many leaves there can be
        self.tree = fit(x, max(branching, leaf_rows * len(x) // max(1, n)), branching)
        self._deal(bin_rows, n)

    def _deal(self, bin_rows: int, n: int) -> None:
        """Write (leaf, vec_id, v), and put leaves into bins by their counts."""
        sent, k, size = shared(self.spark, self.tree), self.k, self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = sent()
            for batch in held(batches):
                x, ids = matrix(batch.column("v"), size), batch.column("vec_id").to_numpy()
                some = first_ids(ids, x, k + 1)
                leaf = tree.assign(x[some])
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), *batch.select(["vec_id", "v"]).take(pa.array(some)).columns], ["leaf", "vec_id", "v"])

        self.table = written(self.rows.mapInArrow(tidy(run), "leaf int, vec_id long, v array<double>"), "leaves")
        counts = np.zeros(self.tree.leaves, np.int64)
        for row in self.table.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a leaf
            counts[row["leaf"]] = row["n"]
        per_bin = max(256, min(bin_rows, -(-n // int(self.spark.conf.get("spark.sql.shuffle.partitions")))))
        self.first_bin, self.n_bins = np.zeros(self.tree.leaves, np.int64), np.ones(self.tree.leaves, np.int64)
        bin_, filled = 0, 0
        for leaf, count in enumerate(counts.tolist()):
            if filled and filled + count > per_bin:
                bin_, filled = bin_ + 1, 0
            self.first_bin[leaf], self.n_bins[leaf] = bin_, max(1, -(-count // per_bin))
            bin_, filled = (bin_ + self.n_bins[leaf], 0) if count > per_bin else (bin_, filled + count)
        self.bins = int(bin_) + 1

    def calibrated(self, queries: DataFrame, recall: float, calibration: int) -> int:
        """The leaves to visit so that the calibration vectors' exact neighbours are found for the share recall."""
        chosen = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(calibration).toArrow()
        if not chosen.num_rows:
            return 0
        ids, x = chosen.column("vec_id").to_numpy(), matrix(chosen.column("v").combine_chunks(), self.size)
        sent, k, size = shared(self.spark, (ids, x)), self.k, self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, queries = sent()
            for batch in held(batches):
                found, leaf = batch.column("vec_id").to_numpy(), batch.column("leaf").to_numpy()
                row, at, score = candidates(queries, found, most_forms(found), matrix(batch.column("v"), size), k)
                best = top(row, own[row], found[at], score, k)
                row, at, score = row[best], at[best], score[best]
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(found[at]), pa.array(score), pa.array(leaf[at], pa.int32())], ["q", "vec_id", "score", "leaf"])

        best = self.table.mapInArrow(tidy(run), "q int, vec_id long, score double, leaf int")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))
        true = best.groupBy("q", "vec_id").agg(F.max_by("leaf", "score").alias("leaf"), F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k).select("q", "leaf").toArrow()
        q, leaf = true.column("q").to_numpy(), true.column("leaf").to_numpy()
        place = np.zeros(len(q), np.int64)
        for i in range(len(ids)):
            order = np.empty(self.tree.leaves, np.int64)
            order[self.tree.order(x[i], self.tree.leaves)] = np.arange(self.tree.leaves)
            place[q == i] = order[leaf[q == i]]
        return int(np.sort(place)[min(len(place) - 1, int(np.ceil(recall * len(place))))]) + 1 if len(place) else self.tree.leaves

    def search(self, is_query: Column, recall: float = 0.95, calibration: int = 200, visits: int | None = None) -> DataFrame:
        """(query_id, rank, vec_id, score) of the k nearest found for the rows of the index that is_query (on vec_id) picks."""
        if not self.size:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        queries = self.rows.where(is_query)
        visits = self.calibrated(queries, recall, calibration) if visits is None else min(visits, self.tree.leaves)
        tree, first_bin, n_bins, k, size = self.tree, self.first_bin, self.n_bins, self.k, self.size
        sent = shared(self.spark, (tree, first_bin, n_bins))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A query for each bin that it meets, with the leaves that it visits there."""
            tree, first_bin, n_bins = sent()
            for batch in batches:
                x = matrix(batch.column("v"), size)
                for i in range(batch.num_rows):
                    by_bin: dict[int, list[int]] = {}
                    for leaf in tree.order(x[i], visits):
                        for b in range(int(first_bin[leaf]), int(first_bin[leaf] + n_bins[leaf])):
                            by_bin.setdefault(b, []).append(leaf)
                    m = len(by_bin)
                    own = pa.array(np.full(m, i))
                    yield pa.RecordBatch.from_arrays([pa.array(list(by_bin), pa.int32()), pa.nulls(m, pa.int32()), *batch.select(["vec_id", "v"]).take(own).columns, pa.array(list(by_bin.values()), pa.list_(pa.int32()))], ["bin", "leaf", "vec_id", "v", "leaves"])

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, first_bin, n_bins = sent()
            for batch in batches:
                leaf, ids = batch.column("leaf").to_numpy(), batch.column("vec_id").to_numpy()
                share = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(first_bin[leaf] + share % n_bins[leaf], pa.int32()), *(batch.column(c) for c in ("leaf", "vec_id", "v")), pa.nulls(batch.num_rows, pa.list_(pa.int32()))], ["bin", "leaf", "vec_id", "v", "leaves"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows sorted by bin, a bin's vectors first and then its queries, which pass in batches."""
            bin_, vectors, points = None, [], None
            for batch in batches:
                bins, leaf = batch.column("bin").to_numpy(), batch.column("leaf")
                is_query = leaf.is_null().to_numpy(zero_copy_only=False)
                edge = np.append(np.flatnonzero((np.diff(bins, prepend=-1) != 0) | (np.diff(is_query, prepend=False) != 0)), len(bins))
                if edge[0] != 0:
                    edge = np.append(0, edge)
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    if bins[a] != bin_:
                        bin_, vectors, points = bins[a], [], None
                    part = batch.slice(a, b - a)
                    if not is_query[a]:
                        vectors.append(part)
                    elif vectors or points is not None:
                        if points is None:
                            points, vectors = Points(vectors, size, k), []
                        yield from points.nearest(part)

        cols = "bin int, leaf int, vec_id long, v array<double>, leaves array<int>"
        both = self.table.mapInArrow(tidy(deal), cols).unionByName(queries.mapInArrow(tidy(probe), cols))
        parts = both.repartition(self.bins, "bin").sortWithinPartitions("bin", F.col("leaf").asc_nulls_last())
        best = parts.mapInArrow(tidy(meet), BEST).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Points:
    """A bin's vectors by leaf, equal ones once with their first ids."""

    def __init__(self, parts: list[pa.RecordBatch], size: int, k: int) -> None:
        table = pa.Table.from_batches(parts).combine_chunks()
        x, ids, leaf = matrix(table.column("v").combine_chunks(), size), table.column("vec_id").to_numpy(), table.column("leaf").to_numpy()
        some = first_ids(ids, x, k + 1)
        self.x, self.ids, self.size, self.k = x[some], ids[some], size, k
        self.forms = most_forms(self.ids)
        self.leaves, self.leaf = np.unique(leaf[some], return_inverse=True)

    def nearest(self, queries: pa.RecordBatch, cells: int = 4 << 20) -> Iterator[pa.RecordBatch]:
        """The best of the bin for each query among the leaves that it visits; cells bounds the products held at once."""
        rows = max(1, cells // len(self.ids))
        for begin in range(0, queries.num_rows, rows):
            part = queries.slice(begin, rows)
            q, own = matrix(part.column("v"), self.size), part.column("vec_id").to_numpy()
            lists = part.column("leaves")
            visits = np.zeros((len(q), len(self.leaves) + 1), bool)
            visited = lists.flatten().to_numpy()
            at = np.searchsorted(self.leaves, visited)
            at[self.leaves[np.minimum(at, len(self.leaves) - 1)] != visited] = len(self.leaves)  # a leaf without a vector here
            visits[np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy()), at] = True
            row, at, score = candidates(q, self.ids, self.forms, self.x, self.k, visits[:, self.leaf])
            best = top(row, own[row], self.ids[at], score, self.k)
            yield pa.RecordBatch.from_arrays([pa.array(own[row[best]]), pa.array(self.ids[at[best]]), pa.array(score[best])], ["query_id", "vec_id", "score"])


def held(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Batches of about rows rows."""
    own: list[pa.RecordBatch] = []
    for batch in batches:
        own.append(batch)
        if sum(b.num_rows for b in own) >= rows:
            yield pa.concat_batches(own)
            own = []
    if any(b.num_rows for b in own):
        yield pa.concat_batches(own)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.95) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that is_query picks."""
    index = Index(vectors, k)
    return index.search(is_query, recall)
