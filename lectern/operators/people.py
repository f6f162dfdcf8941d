"""Authors and affiliations: pieces of an author list, and the three ways affiliations are attached."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import written


def author_block(content):
    """E-mails, notes and institute marks of an author argument, each searched for after the last of the kind before."""
    found = lambda s, c: F.regexp_extract_all(s, F.lit(f"\\\\{c}\\{{([^}}]+)\\}}"), F.lit(1))
    rest = lambda s, c: F.regexp_replace(s, f"^(?s).*\\\\{c}\\{{[^}}]+\\}}", "")
    after_email = rest(content, "email")
    after_thanks = rest(after_email, "thanks")
    return F.struct(found(content, "email").alias("emails"), found(after_email, "thanks").alias("thanks"), found(after_thanks, "inst").alias("institutes"))


def listed_authors(lists: DataFrame, strict: bool = False) -> DataFrame:
    """(doc_id, ord, place, name, email, orcid, affiliation_labels) of author lists (doc_id, ord, content)."""
    split = lists.select("doc_id", "ord", F.posexplode(text.split_authors(F.col("content"), strict)).alias("place", "piece"))
    return split.select("doc_id", "ord", "place", text.author_struct(F.col("piece"), strict).alias("a")).select("doc_id", "ord", "place", "a.*")


def author_nodes(authors: DataFrame) -> DataFrame:
    """(doc_id, node_id, node_type, content): two nodes an author, one by key and one as shown with the e-mail."""
    shown = F.concat("name", F.when(F.col("email").isNotNull(), F.concat(F.lit(" <"), "email", F.lit(">"))).otherwise(""))
    by_key = authors.select("doc_id", F.concat(F.lit("author_"), "name").alias("node_id"))
    return by_key.unionByName(authors.select("doc_id", shown.alias("node_id"))).select("doc_id", "node_id", F.lit("Author").alias("node_type"), F.lit("").alias("content")).distinct()


def by_label(authors: DataFrame, affiliations: DataFrame) -> DataFrame:
    """(doc_id, name, label, details): authors whose labels name an affiliation (doc_id, label, details)."""
    return authors.select("doc_id", "name", F.explode("affiliation_labels").alias("label")).join(affiliations, ["doc_id", "label"])


def by_index(authors: DataFrame, affiliations: DataFrame) -> DataFrame:
    """(doc_id, name, index, details): authors (doc_id, name, indices) with the affiliations at these places, from 0."""
    placed = affiliations.withColumn("index", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1)
    return authors.select("doc_id", "name", F.explode("indices").alias("index")).join(placed.select("doc_id", "index", "details"), ["doc_id", "index"])


def by_position(events: DataFrame) -> DataFrame:
    """events (doc_id, ord, kind, value) with author: the last author before an affiliation, as of its place."""
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    author = F.last(F.when(F.col("kind") == "author", F.col("value")), ignorenulls=True).over(before)
    return events.withColumn("author", author).where("kind = 'affiliation'")


def affiliation_labels(affiliations: DataFrame) -> DataFrame:
    """(doc_id, label, details) of affiliation texts (doc_id, ord, content): the first brace is the label, the last text counts."""
    named = affiliations.withColumn("label", F.regexp_extract("content", "\\{([^}]+)\\}", 1)).where("label <> ''")
    return named.groupBy("doc_id", "label").agg(F.max_by("content", "ord").alias("details"))


def affiliation_flags(content):
    """Whether a text speaks of a department and of an institution."""
    from ..functions import fixed

    return F.struct(text.contains_any(content, fixed.DEPARTMENT_WORDS).alias("department"), text.contains_any(content, fixed.INSTITUTION_WORDS).alias("institution"))


def resolve_people(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Authors and affiliations of nested nodes, in both styles that papers use.

    One name a command, affiliations after it (adjacency); or one command with names between \\and, marked with \\inst and
    \\ref, and one \\institute with labelled entries between \\and (indirection).

    Returns (doc_id, ord, name, email, orcid, affiliations array) and (doc_id, id, details).
    """
    people = nodes.where(F.col("type").isin("Author", "Affiliation")).select("doc_id", "ord", "type", "cmd", "opt", F.regexp_replace(F.coalesce("req", F.lit("")), "(?m)(?<!\\\\)%.*$", "").alias("req"))
    people = written(people, "people")  # read by each branch below, for which papers would be parsed again
    marked = F.col("req").contains("\\inst") | F.col("req").contains("\\and")

    alone = people.where((F.col("type") == "Author") & ~marked)
    squeeze = lambda c: F.trim(F.regexp_replace(c, "\\s+", " "))
    alone = alone.select("doc_id", "ord", F.lit(0).alias("place"), squeeze(F.col("req")).alias("name"), F.lit(None).cast("string").alias("email"), F.nullif("opt", F.lit("")).alias("orcid"))
    pieces = people.where((F.col("type") == "Author") & marked).select("doc_id", "ord", F.posexplode(F.split("req", "\\\\and\\b")).alias("place", "piece"))
    name = F.regexp_replace(F.regexp_replace("piece", "\\\\(thanks|inst|email)\\s*\\{([^{}]|\\{[^{}]*\\})*\\}", ""), "\\\\[a-z]+\\s*|[{}]", "")
    refs = F.regexp_extract_all("piece", F.lit("\\\\ref\\{([^}]+)\\}"), F.lit(1))
    several = pieces.select("doc_id", "ord", "place", squeeze(name).alias("name"), F.nullif(F.regexp_extract("piece", "\\\\email\\{([^}]+)\\}", 1), F.lit("")).alias("email"), F.lit(None).cast("string").alias("orcid"), refs.alias("refs")).where("name <> ''")

    entries = people.where((F.col("type") == "Affiliation")).select("doc_id", "ord", F.posexplode(F.split("req", "\\\\and\\b")).alias("place", "entry"))
    entries = entries.select("doc_id", "ord", "place", F.regexp_extract("entry", "\\\\label\\{([^}]+)\\}", 1).alias("label"), squeeze(F.regexp_replace("entry", "\\\\label\\{[^}]*\\}", "")).alias("details")).where("details <> ''")

    starts = alone.select("doc_id", "ord", F.lit("author").alias("kind"), F.col("ord").cast("string").alias("value"))
    follows = entries.where("label = ''").select("doc_id", "ord", F.lit("affiliation").alias("kind"), F.col("details").alias("value"))
    adjacent = by_position(starts.unionByName(follows)).where("author IS NOT NULL").groupBy("doc_id", F.col("author").cast("int").alias("ord"))
    adjacent = adjacent.agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("ord").alias("at"), "value"))), lambda x: x["value"]).alias("affiliations"))
    labelled = several.select("doc_id", "ord", "place", F.posexplode("refs").alias("k", "label")).join(entries.select("doc_id", "label", "details"), ["doc_id", "label"])
    labelled = labelled.groupBy("doc_id", "ord", "place").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "details"))), lambda x: x["details"]).alias("affiliations"))

    none = F.array().cast("array<string>")
    first = alone.join(adjacent, ["doc_id", "ord"], "left").select("doc_id", "ord", "place", "name", "email", "orcid", F.coalesce("affiliations", none).alias("affiliations"))
    second = several.join(labelled, ["doc_id", "ord", "place"], "left").select("doc_id", "ord", "place", "name", "email", "orcid", F.coalesce("affiliations", none).alias("affiliations"))
    order = Window.partitionBy("doc_id").orderBy("ord", "place")
    authors = first.unionByName(second).withColumn("ord", F.row_number().over(order) - 1).drop("place")
    details = entries.groupBy("doc_id", "details").agg(F.min(F.struct("ord", "place")).alias("at"))
    numbered = details.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")).alias("id"), "details")
    return authors, numbered
