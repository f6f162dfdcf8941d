"""Papers from folders: the main file, its encoding, its includes, as one UTF-8 text a paper."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from .charsets import Charsets

#: Names that TeX has for encodings, and Python's for the same.
ENCODING_NAMES = {"ansinew": "cp1252", "applemac": "mac_roman", "latin9": "iso8859-15", "utf8x": "utf-8", "UNKNOWN": ""}


def tex_files(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, path, name, content) of the .tex files in the folders right below root; a folder is a paper."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tex").load(f"{root.rstrip('/')}/*/*")
    folder = F.regexp_extract("path", "([^/]+)/[^/]+$", 1)
    return files.select(folder.alias("doc_id"), "path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content")


def all_files(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, path, name, content) of all files below the folders right below root, at any depth: what may be included."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    depth = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toUri().getPath().rstrip("/").count("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split(F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/")
    files = files.select(F.get(parts, F.lit(depth + 1)).alias("doc_id"), "path", F.element_at(parts, -1).alias("name"), "content", F.size(parts).alias("n"))
    return files.where(F.col("n") > depth + 2).drop("n")


def main_files(files: DataFrame) -> DataFrame:
    """The main file of each paper: by name, else the first that begins a document, else the first; first by path."""
    begins = F.col("content").cast("string").contains("\\begin{document}")
    rank = F.when(F.col("name").isin("main.tex", "mainfile.tex"), 0).when(begins, 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "path"))
    ranked = files.select("doc_id", "path", "name", rank.alias("rank")).withColumn("place", place)
    return ranked.where("place = 1").select("doc_id", "path", "name")


def declared_encoding(content: Column) -> Column:
    """The encoding that one of the first fifty lines declares, else UTF-8."""
    lines = F.slice(F.split(content, "\n"), 1, 50)
    found = lambda line: F.coalesce(*[F.nullif(F.regexp_replace(F.regexp_extract(line, p, 1), "\\s", ""), F.lit("")) for p in fixed.ENCODINGS])
    return F.coalesce(F.get(F.filter(F.transform(lines, found), lambda e: e.isNotNull()), F.lit(0)), F.lit("UTF-8"))


def sniffed(data: bytes) -> str:
    """An encoding by byte order mark, by whether UTF-8 reads it, or the usual one-byte one; UNKNOWN for nothing."""
    if not data:
        return "UNKNOWN"
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if data.startswith(mark):
            return name
    try:
        data.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        return "latin-1" if any(0x80 <= b < 0xA0 and b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) for b in data) else "cp1252"


def converted(data: bytes, encoding: str) -> str:
    """The text, without bytes that the encoding doesn't know; '' if there is no such encoding."""
    try:
        return data.decode(ENCODING_NAMES.get(encoding, encoding), errors="ignore")
    except LookupError:
        return ""


def read_text(data: bytes, declared: str, model: Charsets | None = None) -> tuple[str, str]:
    """(encoding that was detected, text)."""
    found = model.detect(data)[0] if model else sniffed(data)
    try:
        return found, converted(data, found) if found == "iso2022_jp" else data.decode("utf-8")
    except UnicodeDecodeError:
        return found, converted(data, found if declared == "UTF-8" and found != "UNKNOWN" else declared)


def utf8_texts(files: DataFrame, model: Charsets | None = None) -> DataFrame:
    """files with encoding_declared, encoding_detected and text. Valid UTF-8 stays as it is, whatever is declared.

    model: tells charsets by their bytes (charsets.trained); without one, what isn't UTF-8 is taken for a one-byte charset.
    """

    @F.pandas_udf("encoding string, text string")
    def decode(content: pd.Series, declared: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_text(data, name, model) for data, name in zip(content, declared, strict=True)], columns=["encoding", "text"])

    named = files.withColumn("encoding_declared", declared_encoding(F.decode(F.col("content"), "ISO-8859-1")))
    out = named.withColumn("d", decode("content", "encoding_declared"))
    return out.select("doc_id", "path", "name", "encoding_declared", F.col("d.encoding").alias("encoding_detected"), F.col("d.text").alias("text"))


def include_edges(texts: DataFrame) -> DataFrame:
    """(doc_id, path, at, target): the files that a file takes in, as written."""
    found = F.regexp_extract_all("text", F.lit(fixed.INCLUDE), F.lit(2))
    return texts.select("doc_id", "path", F.posexplode(found).alias("at", "target"))


def inlined(files: dict[str, str], main: str, strict: bool = False) -> str:
    """main with all it includes put in place, each file once; what isn't there stays as written."""
    pattern, seen = re.compile(fixed.INCLUDE), set()

    def read(path: str, is_main: bool) -> str:
        if path in seen:
            return ""
        seen.add(path)
        body = files[path]
        if not is_main:
            body = body.replace("\\begin{document}", "").replace("\\end{document}", "")
        if not strict:
            body = re.sub(r"(?m)(?<!\\)%.*$", "", body)
        folder = path.rpartition("/")[0]

        def put(m: re.Match[str]) -> str:
            target = m[2] if "." in m[2].rpartition("/")[2] else f"{m[2]}.tex"
            full = _normal(f"{folder}/{target}")
            return read(full, False) if full in files else m[0]

        return pattern.sub(put, body)

    return read(main, True)


def _normal(path: str) -> str:
    out: list[str] = []
    for part in path.split("/"):
        if part == ".." and out and out[-1]:
            out.pop()
        elif part != ".":
            out.append(part)
    return "/".join(out)


def papers(spark: SparkSession, root: str, strict: bool = False) -> DataFrame:
    """(doc_id, main, text, error): each paper as one text. A paper's files, all below its folder, meet in one row; papers run in parallel."""
    texts = utf8_texts(all_files(spark, root))
    gathered = texts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "text"))).alias("files"))
    joined = gathered.join(main_files(tex_files(spark, root)).select("doc_id", F.col("path").alias("main")), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, files, main in zip(batch["doc_id"], batch["files"], batch["main"], strict=True):
                try:
                    rows.append((doc, main, inlined(dict(files), main, strict), None))
                except RecursionError as error:
                    rows.append((doc, main, None, str(error)))
            yield pd.DataFrame(rows, columns=["doc_id", "main", "text", "error"])

    return joined.mapInPandas(run, "doc_id string, main string, text string, error string")
