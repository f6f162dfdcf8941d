"""From document JSON to a vector index, and from a query to its context: split, embed, store, search, assemble."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import keyed_write

# Sizes, the default title, and the instruction of the chat model.
CHUNK_BYTES = 40_000
METADATA_BYTES = 40_960
DIMENSION = 1536
TOP_K = 5
NO_TITLE = "Title not listed."
INSTRUCTION = "You are an AI assistant helping to answer questions based on the provided context. Use the context to answer the question thoroughly, including any relevant affiliations and references."


def split_text(value: Column, most: int = CHUNK_BYTES, strict: bool = False) -> Column:
    """Words packed greedily into chunks of at most so many bytes; a longer word stands alone.

    strict: a chunk is closed even when it is empty, so one whose first word is too long follows an empty chunk.
    Only the running size is carried along, and the chunks are cut from the words once their ends are known.
    """
    words = text.words(value)
    state = lambda size, ends: F.struct(size.alias("size"), ends.alias("ends"))

    def step(acc: Column, w: Column) -> Column:
        own = F.octet_length(w)
        fits = F.when(acc["size"] == 0, own <= most).otherwise(acc["size"] + 1 + own <= most)
        closing = (acc["size"] > 0) | F.lit(strict)
        # a chunk's number goes up where a word doesn't fit
        number = F.element_at(acc["ends"], -1) + F.when(fits | ~closing, 0).otherwise(1)
        size = F.when(fits & (acc["size"] > 0), acc["size"] + 1 + own).otherwise(own)
        return state(size.cast("int"), F.concat(acc["ends"], F.array(number.cast("int"))))

    numbers = F.aggregate(words, state(F.lit(0), F.array(F.lit(0))), step, lambda acc: acc["ends"])
    numbered = F.arrays_zip(F.slice(numbers, 2, F.size(words)).alias("n"), words.alias("w"))
    count = F.element_at(numbers, -1)
    cut = F.transform(F.sequence(F.lit(0), count), lambda k: F.array_join(F.transform(F.filter(numbered, lambda x: x["n"] == k), lambda x: x["w"]), " "))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(cut)


def chunked(rows: DataFrame, most: int = CHUNK_BYTES, strict: bool = False) -> DataFrame:
    """rows (..., content) with (chunk, content) for each chunk, numbered from 1; long texts in linear time."""

    def pack(value: str) -> list[str]:
        out: list[str] = []
        held, size = [], 0
        for w in value.split():
            own = len(w.encode())
            if size + (1 if held else 0) + own > most and (held or strict):
                out.append(" ".join(held))
                held, size = [], 0
            size += (1 if held else 0) + own
            held.append(w)
        return out + ([" ".join(held)] if held else [])

    @F.pandas_udf("array<string>")
    def pieces(content: pd.Series) -> pd.Series:
        return content.map(lambda v: pack(v or ""))

    cut = rows.select(*[c for c in rows.columns if c != "content"], F.posexplode(pieces("content")).alias("_place", "content"))
    return cut.withColumn("chunk", F.col("_place") + 1).drop("_place")


def flattened(documents: DataFrame) -> DataFrame:
    """(source_file, document_title, authors, affiliations, place, section_title, ..., content) of document rows.

    documents: source_file and document with title, metadata and content, as sources.documents reads them.
    """
    doc = F.col("document")
    people = F.coalesce(doc["metadata"]["authors"], F.array())
    names = F.transform(people, lambda a: F.coalesce(a["name"], F.lit("")))
    places = F.array_distinct(F.flatten(F.transform(people, lambda a: F.coalesce(a["affiliations"], F.array().cast("array<string>")))))
    head = documents.select("source_file", F.coalesce(doc["title"], F.lit(NO_TITLE)).alias("document_title"), names.alias("authors"), places.alias("affiliations"), F.posexplode(doc["content"]).alias("place", "s"))
    s = F.col("s")
    blank = lambda c: F.coalesce(c, F.lit(""))
    added = lambda said, c: F.when(blank(c) != "", F.concat(F.lit(f"\n{said}: "), c)).otherwise(F.lit(""))
    content = F.concat(F.btrim(blank(s["content"]), F.lit(" \t\n\x0b\x0c\r")), added("Figure Caption", s["figure_caption"]), added("Image File", s["image_file"]))
    return head.select(
        "source_file",
        "document_title",
        "authors",
        "affiliations",
        (F.col("place") + 1).alias("place"),
        F.coalesce(s["section"], F.concat(F.lit("Section "), (F.col("place") + 1).cast("string"))).alias("section_title"),
        blank(s["type"]).alias("section_type"),
        F.transform(F.coalesce(s["references"], F.array()), lambda r: F.coalesce(r["label"], F.lit(""))).alias("references"),
        blank(s["figure_caption"]).alias("figure_caption"),
        blank(s["image_file"]).alias("image_file"),
        content.alias("content"),
    )


def joined_items(items: Column) -> Column:
    """A section's content given as (type, content) items: inline math in dollars, others as JSON, plain ones as they are."""
    shown = lambda x: F.when(x["type"] == "inline_math", F.concat(F.lit("$"), F.coalesce(x["content"], F.lit("")), F.lit("$"))).when(x["type"].isNull(), F.coalesce(x["content"], F.lit(""))).otherwise(F.to_json(x))
    return F.array_join(F.transform(items, shown), "")


METADATA = ("source_file", "document_title", "authors", "affiliations", "section_title", "section_type", "references", "figure_caption", "image_file", "content")


def vector_rows(sections: DataFrame, most: int = CHUNK_BYTES, cap: int = METADATA_BYTES, strict: bool = False) -> DataFrame:
    """(index_name, id, metadata): a row a chunk; those whose metadata as JSON is above the cap are left out."""
    cut = chunked(sections, most, strict)
    metadata = F.struct(*METADATA)
    name = text.index_name(F.concat(F.lit("index-"), "source_file"))
    key = F.concat("source_file", F.lit("_section_"), F.col("place").cast("string"), F.lit("_chunk_"), F.col("chunk").cast("string"))
    return cut.select(name.alias("index_name"), key.alias("id"), metadata.alias("metadata")).where(F.octet_length(F.to_json("metadata")) <= cap)


def hashing_embedder(dimension: int = DIMENSION) -> Callable[[list[str]], np.ndarray]:
    """Texts as unit vectors of hashed words: deterministic, and in need of no service."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for row, value in zip(out, texts, strict=True):
            for w in value.lower().split():
                h = zlib.crc32(w.encode())
                row[h % dimension] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return embed


def embedded(rows: DataFrame, embed: Callable[[list[str]], np.ndarray], batch: int = 100) -> DataFrame:
    """rows with embedding of metadata.content; the model gets batches of texts."""

    @F.pandas_udf("array<float>")
    def vectors(content: pd.Series) -> pd.Series:
        texts = content.fillna("").tolist()
        parts = [embed(texts[k : k + batch]) for k in range(0, len(texts), batch)]
        return pd.Series([v for p in parts for v in p])

    return rows.withColumn("embedding", vectors(F.col("metadata.content")))


def store(rows: DataFrame, path: str) -> None:
    """Upsert vectors by index and id into a table partitioned by index."""
    keyed_write(rows, path, ["index_name", "id"], "index_name")


def delete_indexes(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def nearest(vectors: DataFrame, query: Column, key: str = "id", k: int = TOP_K, vector: str = "embedding") -> DataFrame:
    """The k rows of highest cosine similarity with one vector, ties by key."""
    return vectors.withColumn("score", text.cosine(F.col(vector), query)).orderBy(F.col("score").desc_nulls_last(), key).limit(k)


def nearest_by_index(vectors: DataFrame, query: Column, key: str = "id", index: str = "index_name", k: int = TOP_K, vector: str = "embedding") -> DataFrame:
    """The k nearest rows of each index; no ranking across indexes. Each task keeps k rows an index before the shuffle."""
    scored = vectors.withColumn("score", text.cosine(F.col(vector), query))
    place = F.row_number().over(Window.partitionBy(index).orderBy(F.col("score").desc_nulls_last(), key))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def among_best(score: np.ndarray, group: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of the scores [row, query] that are no less than a query's k-th of the row's group; a NaN is least."""
    found = [(np.zeros(0, int), np.zeros(0, int))]
    for g in np.unique(group):
        own = np.flatnonzero(group == g)
        near = np.where(np.isnan(score[own]), -np.inf, score[own])
        row, query = np.nonzero(near >= np.partition(near, max(0, len(own) - k), axis=0)[max(0, len(own) - k)])
        found.append((own[row], query))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def nearest_many(vectors: DataFrame, queries: np.ndarray, key: str = "id", k: int = TOP_K, vector: str = "embedding", index: str | None = None, digits: int | None = None, cells: int = 1 << 20) -> DataFrame:
    """(query, place, key, score) for a block of query vectors: matrix products of so many cells, k candidates a task.

    index: a column; each query has its k nearest of each of its values, which is returned too. digits: scores are
    rounded to so many before they are ranked, so that equal vectors tie.
    """
    wanted = np.asarray(queries, np.float64)
    wanted = wanted / np.maximum(np.linalg.norm(wanted, axis=1, keepdims=True), 1e-12)
    kinds, own = dict(vectors.dtypes), [key] + ([index] if index else [])
    by = ["query"] + own[1:]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        step = max(1, cells // max(1, len(wanted)))
        for batch in (b.iloc[at : at + step] for b in batches for at in range(0, len(b), step)):
            matrix = np.stack(batch[vector].to_numpy()).astype(np.float64)
            score = matrix @ wanted.T / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
            score = score if digits is None else np.round(score, digits)
            row, query = among_best(score, pd.factorize(batch[index], use_na_sentinel=False)[0] if index else np.zeros(len(batch), int), k)
            long = pd.DataFrame({"query": query, "score": score[row, query]} | {c: batch[c].to_numpy()[row] for c in own})
            best = (long if best is None else pd.concat([best, long])).sort_values([*by, "score", key], ascending=[True] * len(by) + [False, True]).groupby(by, dropna=False).head(k)
        if best is not None:
            yield best[["query", *own, "score"]]

    scored = vectors.select(*own, vector).where(F.col(vector).isNotNull()).mapInPandas(run, f"query int, {', '.join(f'{c} {kinds[c]}' for c in own)}, score double")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), key))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def nearest_in_blocks(vectors: DataFrame, queries: DataFrame, key: str = "id", k: int = TOP_K, vector: str = "embedding", index: str | None = None, digits: int | None = None, block: int = 1024) -> DataFrame:
    """nearest_many for every row of queries, about block of them at a time; query is the row's key."""
    asked = queries.select(F.col(key).alias("query"), F.col(vector).alias("vector")).where(F.col("vector").isNotNull())
    blocks = -(-asked.count() // block) or 1
    kind = dict(asked.dtypes)["query"]
    parts = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).orderBy("query").collect()
        if not rows and (parts or b + 1 < blocks):
            continue
        matrix = np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 1))
        names = F.array(*[F.lit(r["query"]) for r in rows]).cast(f"array<{kind}>")
        found = nearest_many(vectors if rows else vectors.limit(0), matrix, key, k, vector, index, digits)
        parts.append(found.withColumn("query", F.get(names, F.col("query"))))
    return reduce(DataFrame.unionByName, parts)


def contexts(matches: DataFrame) -> DataFrame:
    """matches (…, metadata) with context: six lines a match, defaults for what is missing."""
    m = F.col("metadata")
    line = lambda said, c, other: F.concat(F.lit(said), F.coalesce(c, F.lit(other)))
    several = lambda said, c: F.concat(F.lit(said), F.coalesce(F.array_join(c, ", "), F.lit("")))
    return matches.withColumn("context", F.concat_ws("\n", line("### Source: ", m["source_file"], "Unknown Source"), line("Section Title: ", m["section_title"], "No Title"), line("Content: ", m["content"], "No Content"), several("Authors: ", m["authors"]), several("Affiliations: ", m["affiliations"]), several("References: ", m["references"])))


def prompt(context_rows: DataFrame, question: str, order: list[str]) -> DataFrame:
    """(prompt): the contexts in order, blank lines between, and the question. The matches are few: k an index."""
    together = context_rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "context"))), lambda x: x["context"]), "\n\n").alias("all"))
    return together.select(F.concat(F.lit("Context:\n"), "all", F.lit(f"\n\nQuestion:\n{question}\n\nAnswer:")).alias("prompt"))


@dataclass(frozen=True)
class Session:
    """Settings of a retrieval client over a stored table; models are injected."""

    spark: SparkSession
    path: str
    embed: Callable[[list[str]], np.ndarray]
    chat: Callable[[str, str, float], str] | None = None
    speak: Callable[[str], None] | None = None
    index: str | None = None
    temperature: float = 0.1

    def change_index(self, name: str | None) -> Session:
        return replace(self, index=text_index_name(name) if name else None)

    def set_temperature(self, value: float) -> Session:
        if not 0 <= value <= 1:
            raise ValueError("the temperature must be from 0 to 1")
        return replace(self, temperature=value)

    def toggle_speech(self, speak: Callable[[str], None]) -> Session:
        return replace(self, speak=None if self.speak else speak)

    def query(self, question: str) -> DataFrame:
        """The nearest chunks of the chosen index, or of each index."""
        if not question.strip():
            raise ValueError("the query is empty")
        stored = self.spark.read.parquet(self.path)
        if self.index:
            stored = stored.where(F.col("index_name") == self.index)
        vector = F.array(*[F.lit(float(x)) for x in self.embed([question])[0]])
        return nearest_by_index(stored, vector)

    def answer(self, question: str) -> str:
        text_ = prompt(contexts(self.query(question)), question, ["index_name", "place"]).first()["prompt"]
        said = self.chat(INSTRUCTION, text_, self.temperature).strip() if self.chat else text_
        if self.speak:
            self.speak(said)
        return said


def text_index_name(name: str) -> str:
    """index_name for one Python string."""
    import re

    return re.sub(r"[^a-z0-9-]+", "-", name.lower()).strip("-") or "default-index"
