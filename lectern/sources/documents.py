"""Document JSON files as rows, in the schema that retrieval reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AUTHOR = "struct<name: string, email: string, orcid: string, affiliations: array<string>>"
SECTION = "struct<section: string, type: string, content: string, references: array<struct<label: string>>, figure_caption: string, image_file: string>"
DOCUMENT = f"struct<title: string, metadata: struct<authors: array<{AUTHOR}>, affiliations: array<struct<id: int, details: string>>>, content: array<{SECTION}>>"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(source_file, document) of the *.json files of a folder; a file that isn't JSON has a null document."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    stem = F.regexp_extract("path", "([^/]+)\\.json$", 1)
    parsed = F.from_json(F.col("content").cast("string"), f"struct<document: {DOCUMENT}>")
    return files.select(stem.alias("source_file"), parsed["document"].alias("document"))


def mixed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """documents() of files whose sections' content may be a string, a list of strings and objects, or anything else."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    return from_json_text(files.select(F.regexp_extract("path", "([^/]+)\\.json$", 1).alias("source_file"), F.col("content").cast("string").alias("json")))


def from_json_text(rows: DataFrame) -> DataFrame:
    """(source_file, document) of (source_file, json), parsed once into a VARIANT, so that shapes may differ from row to row.

    A section's content: a string as it is; of a list the items joined, inline math in dollars, other objects as JSON (its
    keys by name), strings as they are, other items as JSON; an object or a number as JSON; none or null as ''. What has
    another type than it should have reads as missing. JSON that can't be parsed gives a null document.
    """
    doc = F.variant_get("v", "$.document", "variant")
    text = lambda v, path: F.when(_kind(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    listed = lambda v, path: F.try_variant_get(v, path, "array<variant>")

    def author(a: Column) -> Column:
        places = F.filter(F.transform(listed(a, "$.affiliations"), lambda x: text(x, "$")), lambda x: x.isNotNull())
        return F.struct(text(a, "$.name").alias("name"), text(a, "$.email").alias("email"), text(a, "$.orcid").alias("orcid"), places.alias("affiliations"))

    def section(v: Column) -> Column:
        labels = F.transform(listed(v, "$.references"), lambda r: F.struct(text(r, "$.label").alias("label")))
        named = [text(v, f"$.{c}").alias(c) for c in ("section", "type")]
        return F.struct(*named, joined_content(F.try_variant_get(v, "$.content", "variant")).alias("content"), labels.alias("references"), *[text(v, f"$.{c}").alias(c) for c in ("figure_caption", "image_file")])

    places = F.transform(listed(doc, "$.metadata.affiliations"), lambda a: F.struct(F.try_variant_get(a, "$.id", "int").alias("id"), text(a, "$.details").alias("details")))
    metadata = F.struct(F.transform(listed(doc, "$.metadata.authors"), author).alias("authors"), places.alias("affiliations"))
    document = F.struct(text(doc, "$.title").alias("title"), metadata.alias("metadata"), F.transform(listed(doc, "$.content"), section).alias("content"))
    parsed = rows.select("source_file", F.try_parse_json("json").alias("v"))
    return parsed.select("source_file", F.when(doc.isNotNull(), document).alias("document"))


def _kind(v: Column) -> Column:
    """STRING, ARRAY, OBJECT, VOID (a null) or another type's name; null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def joined_content(v: Column) -> Column:
    """The text of a section's content, whatever it is."""

    def item(x: Column) -> Column:
        math = F.concat(F.lit("$"), F.coalesce(F.try_variant_get(x, "$.content", "string"), F.lit("")), F.lit("$"))
        is_math = F.coalesce(F.try_variant_get(x, "$.type", "string") == "inline_math", F.lit(False))
        return F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string")).when((_kind(x) == "OBJECT") & is_math, math).otherwise(F.to_json(x))

    kind = _kind(v)
    whole = F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), item), "")
    return F.when(v.isNull() | (kind == "VOID"), "").when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind == "ARRAY", whole).otherwise(F.to_json(v))


def write_documents(rows: DataFrame, path: str) -> None:
    """(doc_id, json) as JSON lines, a folder a document under a file-safe name."""
    safe = rows.select(F.translate("doc_id", "/\\", "__").alias("doc_id"), "json")
    safe.write.mode("overwrite").partitionBy("doc_id").text(path)
