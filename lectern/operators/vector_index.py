"""An inverted file over embeddings: cells around coarse centroids, every vector stored with its cell, queries joined by cell.

  fit      centroids by k-means under the cosine distance, in Spark, on a bounded sample of unit vectors
  store    every vector goes to the cell of its nearest centroid. A cell with more than part_rows vectors is split by a
           hash of the key into parts. The table is bucketed and sorted by (cell, part), so a search doesn't move it
  search   each query goes to its nearest cells (probes of them), meets their parts in a join by (cell, part), and is
           scored there on the vectors themselves; the k best of each part meet by query
  exact    a second pass goes to the cells that may still hold something better: a cell with a radius (its members' largest
           angle to the centroid) can't have a cosine above that of the angle to the centroid less the radius

No block of queries comes to the driver. What is broadcast is the centroids, whose number is bounded by the sample, with a
radius and a number of parts each. A query that no probe count suits is answered exactly by exact=True.

Vectors that are null, empty or zero, or hold null or non-finite components, have no direction and take no part, neither
do those whose length isn't the commonest one, nor keys that are null; of rows that share a key each is a row of its own.
Ties go to the smaller key; scores are rounded to digits before they are ranked, so that equal vectors tie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import bucketed, drop_table, written

#: Angles and scores are held against bounds with so much slack.
SLACK = 1e-6


def unit(vector: Column) -> Column:
    """The vector as doubles of length one; null where it has no direction."""
    v = F.transform(vector, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))  # null with a null component
    return F.when((length > 0) & (length < float("inf")) & ~F.isnan(length), F.transform(v, lambda x: x / length))


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def flat(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def angles(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ centroids.T, -1, 1))


def at_once(others: int, cells: int = 1 << 20) -> int:
    """How many rows meet so many others at a time, in matrices of so many cells: what a task holds doesn't grow with either."""
    return max(1, cells // max(1, others))


@dataclass
class InvertedFile:
    """centroids (unit rows), radius and parts of each cell, and the stored table (key, vector, unit, cell, part)."""

    spark: SparkSession
    key: str
    kind: str
    centroids: np.ndarray
    radius: np.ndarray
    parts: np.ndarray
    name: str
    index: str | None = None
    index_kind: str = "int"
    own: list[str] = field(default_factory=list)
    size: int = 0

    @property
    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    @classmethod
    def build(
        cls,
        vectors: DataFrame,
        key: str = "id",
        vector: str = "embedding",
        index: str | None = None,
        cells: int | None = None,
        sample_rows: int = 20_000,
        part_rows: int = 20_000,
        buckets: int | None = None,
        seed: int = 17,
    ) -> InvertedFile:
        """Fit and store. cells: the square root of the number of rows unless given, at most an eighth of the sample;
        index: a column kept beside the key, for searches within each of its values."""
        spark, kinds = vectors.sparkSession, dict(vectors.dtypes)
        rows = vectors.select(key, *([index] if index else []), unit(F.col(vector)).alias("unit")).where(F.col(key).isNotNull() & F.col("unit").isNotNull())
        most = rows.groupBy(F.size("unit").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "size").first()
        size, n = (most["size"], most["n"]) if most else (0, 0)
        rows = rows.where(F.size("unit") == size)
        cells = max(1, min(cells or round(n**0.5), max(1, min(n, sample_rows) // 8)))
        centroids = cls._fit(rows, key, n, cells, sample_rows, seed)

        @F.pandas_udf("cell int, angle double")
        def nearest_cell(found: pd.Series) -> pd.DataFrame:
            rows, step = stacked(found) if len(found) else np.zeros((0, 1)), at_once(len(centroids))
            cell, least = np.zeros(len(rows), np.int32), np.zeros(len(rows))
            for a in range(0, len(rows), step):
                angle = angles(rows[a : a + step], centroids)
                cell[a : a + step], least[a : a + step] = angle.argmin(1), angle.min(1)
            return pd.DataFrame({"cell": cell, "angle": least})

        placed = written(rows.withColumn("_at", nearest_cell("unit")).select(*rows.columns, F.col("_at.cell").alias("cell"), F.col("_at.angle").alias("angle")), "cells")
        stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).toPandas()  # a row a cell
        radius, parts = np.full(len(centroids), -1.0), np.zeros(len(centroids), np.int64)
        radius[stats["cell"]], parts[stats["cell"]] = stats["radius"], -(-stats["n"] // part_rows)
        of_cell = F.broadcast(spark.createDataFrame([(i, int(p)) for i, p in enumerate(parts)], "cell int, parts int"))  # a row a cell
        dealt = placed.join(of_cell, "cell").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int")).drop("parts", "angle")
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = bucketed(dealt, "inverted_file", buckets, ["cell", "part"])
        return cls(spark, key, kinds[key], centroids, radius, parts, name, index, kinds[index] if index else "int", [key] + ([index] if index else []), size)

    @staticmethod
    def _fit(rows: DataFrame, key: str, n: int, cells: int, sample_rows: int, seed: int) -> np.ndarray:
        place = F.xxhash64(key)
        share = int(min(1.0, 1.1 * sample_rows / max(1, n)) * (1 << 30))
        sample = rows.where(F.pmod(place, F.lit(1 << 30)) < share).orderBy(place, key).limit(sample_rows).select(array_to_vector("unit").alias("features"))
        if not n:
            return np.zeros((1, 1))
        model = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine").fit(sample) if cells > 1 else None
        centres = np.array(model.clusterCenters()) if model else np.array(sample.first()["features"].toArray())[None, :]
        return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)

    def drop(self) -> None:
        drop_table(self.spark, self.name)

    def _asked(self, queries: DataFrame, vector: str) -> DataFrame:
        rows = queries.select(F.col(self.key).alias("query"), unit(F.col(vector)).alias("vector"))
        return rows.where(F.col("query").isNotNull() & (F.size("vector") == self.size))

    def _sent(self, asked: DataFrame, probes: int, bounded: bool) -> DataFrame:
        """(cell, part, query, vector): a row for each part that a query goes to. bounded: to the cells beyond the first
        probes that may hold a score above the query's least (a column of asked)."""
        centroids, radius, parts = self.centroids, self.radius, self.parts
        kind = dict(asked.dtypes)["query"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            step = at_once(len(centroids))
            for batch in (b.iloc[a : a + step] for b in batches for a in range(0, len(b), step)):
                if not parts.any():
                    continue
                angle = angles(stacked(batch["vector"]), centroids)
                angle[:, parts == 0] = np.inf  # nothing there
                order = np.argsort(angle, axis=1, kind="stable")
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(len(centroids))[None, :], 1)
                if bounded:
                    bound = np.cos(np.maximum(0, np.where(np.isfinite(angle), angle, np.pi) - radius - SLACK))
                    goes = (place >= probes) & (parts > 0) & (bound + SLACK >= batch["least"].to_numpy()[:, None])
                else:
                    goes = (place < probes) & (parts > 0)
                row, cell = np.nonzero(goes)
                times = parts[cell]
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                for a in range(0, len(row), 50_000):  # a query goes to many parts
                    own = row[a : a + 50_000]
                    yield pd.DataFrame({"cell": cell[a : a + 50_000], "part": part[a : a + 50_000], "query": batch["query"].to_numpy()[own], "vector": batch["vector"].to_numpy()[own]})

        return asked.mapInPandas(run, f"cell int, part int, query {kind}, vector array<double>")

    def _met(self, sent: DataFrame, k: int, digits: int, query_rows: int = 100_000) -> DataFrame:
        """(query, index, key, score): the k best of each part for the queries that were sent there.

        Where more than query_rows queries go to a cell they are split by a hash, and the cell's vectors meet each share.
        """
        key, index, size = self.key, self.index, self.size

        def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
            matrix, keys = flat(vectors.column("unit"), size), vectors.column(key).combine_chunks()
            kind = vectors.column(index).combine_chunks() if index else None
            group = kind.dictionary_encode(null_encoding="encode").indices.to_numpy() if index else np.zeros(len(keys), np.int64)
            by_key = pc.rank(keys, tiebreaker="dense").to_numpy()
            none = np.zeros(0, np.int64)
            rows, places, scores = [none], [none], [np.zeros(0)]
            step = at_once(len(keys))
            for a in range(0, queries.num_rows if len(keys) else 0, step):
                score = np.round(flat(queries.column("vector").slice(a, step), size) @ matrix.T, digits)
                some: list[tuple[np.ndarray, np.ndarray]] = []
                for g in np.unique(group):
                    own = np.flatnonzero(group == g)
                    near = score[:, own]
                    least = np.partition(near, max(0, len(own) - k), axis=1)[:, max(0, len(own) - k)]
                    row, at = np.nonzero(near >= least[:, None])  # what ties with the k-th stays until keys are held against each other
                    some.append((row, own[at]))
                row, at = (np.concatenate(x) for x in zip(*some, strict=True))
                order = np.lexsort((by_key[at], -score[row, at], group[at], row))
                row, at = row[order], at[order]
                owner = row * (len(keys) + 1) + group[at]
                begin = np.flatnonzero(np.diff(owner, prepend=-1))
                kept = np.arange(len(owner)) - np.repeat(begin, np.diff(np.append(begin, len(owner)))) < k
                rows.append(row[kept] + a)
                places.append(at[kept])
                scores.append(score[row[kept], at[kept]])
            row, at, score = map(np.concatenate, (rows, places, scores))
            found = {"query": queries.column("query").combine_chunks().take(pa.array(row)), key: keys.take(pa.array(at)), "score": pa.array(score)}
            if index:
                found[index] = kind.take(pa.array(at))
            return pa.table({c: found[c] for c in (["query", index] if index else ["query"]) + [key, "score"]})

        schema = f"query {self.kind}, {f'{index} {self.index_kind}, ' if index else ''}{key} {self.kind}, score double"
        shares = sent.where("part = 0").groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / query_rows).alias("shares")).where("shares > 1")
        shares = self.spark.createDataFrame(shares.toPandas(), "cell int, shares long") if not shares.isEmpty() else None  # a row a cell
        if shares is None:
            return self.table.groupBy("cell", "part").cogroup(sent.groupBy("cell", "part")).applyInArrow(run, schema)
        of = lambda rows: rows.join(F.broadcast(shares), "cell", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
        vectors = of(self.table).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
        dealt = of(sent).withColumn("share", F.pmod(F.xxhash64("query"), F.col("shares")))
        keys = ["cell", "part", "share"]
        return vectors.drop("shares").groupBy(*keys).cogroup(dealt.drop("shares").groupBy(*keys)).applyInArrow(run, schema)

    def _ranked(self, met: DataFrame, k: int) -> DataFrame:
        by = ["query"] + ([self.index] if self.index else [])
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), self.key))
        return met.withColumn("place", place).where(F.col("place") <= k)

    def search(self, queries: DataFrame, k: int = 5, probes: int = 8, vector: str = "embedding", digits: int = 9, exact: bool = False, query_rows: int = 100_000) -> DataFrame:
        """(query, index, key, score, place): the k rows of highest cosine similarity of every query (key, vector), in
        each value of index if the file has one. exact: no cell that could hold a better one is left out."""
        asked = self._asked(queries, vector)
        met = self._met(self._sent(asked, probes, False), k, digits, query_rows)
        if exact:
            first = written(self._ranked(met, k).drop("place"), "first_pass")
            full = first.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
            # within indexes a query has a k-th score for each; the bound takes their least, and none if an index may lack k
            wanted = self._index_values() * k
            least = F.when(F.col("n") >= wanted, F.col("least")).otherwise(F.lit(-1.1))
            again = asked.join(full, "query", "left").select("query", "vector", F.coalesce(least, F.lit(-1.1)).alias("least"))
            met = first.unionByName(self._met(self._sent(again, probes, True), k, digits, query_rows))
        return self._ranked(met, k)

    def _index_values(self) -> int:
        return self.table.select(self.index).distinct().count() if self.index else 1

    def probes_for(self, queries: DataFrame, recall: float = 0.95, k: int = 5, sample: int = 100, vector: str = "embedding", digits: int = 9) -> int:
        """The probes with which a bounded sample of queries finds its exact k nearest for the share recall."""
        asked = self._asked(queries, vector).orderBy(F.xxhash64("query"), "query").limit(sample)
        some = written(asked, "sampled").withColumnsRenamed({"query": self.key, "vector": vector})
        exact = self.search(some, k, len(self.centroids), vector, digits)
        cell_of = self.table.select(*self.own, "cell")
        true = exact.join(cell_of, self.own).select("query", "cell").toPandas()  # k a sampled query (and index)
        if not len(true):
            return 1
        rows = some.toPandas()
        angle = angles(stacked(rows[vector]), self.centroids)
        angle[:, self.parts == 0] = np.inf
        place = np.argsort(np.argsort(angle, axis=1, kind="stable"), axis=1)
        at = {q: i for i, q in enumerate(rows[self.key])}
        needed = np.sort([place[at[q], c] for q, c in zip(true["query"], true["cell"], strict=True)])
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def recall(found: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """(query, n, hits): how many of a query's exact nearest (query, key) were found."""
    hits = exact.select("query", key).join(found.select("query", key, F.lit(1).alias("hit")), ["query", key], "left")
    return hits.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"))
