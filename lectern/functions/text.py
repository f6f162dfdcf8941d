"""Scalar functions over strings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = "[ \\t\\n\\x0B\\f\\r]"


def ascii_lower(s: Column) -> Column:
    """A-Z folded; lower() does the same on strings of ASCII alone, and faster."""
    return F.when(F.octet_length(s) == F.char_length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))


def words(s: Column) -> Column:
    """The runs without ASCII white space."""
    return F.filter(F.split(s, f"{SPACE}+"), lambda w: w != "")


def long_words(s: Column, more_than: int = 3) -> Column:
    """Words of more than so many bytes."""
    return F.filter(F.split(s, f"{SPACE}+"), lambda w: F.octet_length(w) > more_than)


def contains_any(s: Column, parts: tuple[str, ...]) -> Column:
    out = s.contains(parts[0])
    for p in parts[1:]:
        out = out | s.contains(p)
    return out


def trimmed(s: Column) -> Column:
    """Without space, tab, newline and carriage return at both ends."""
    return F.btrim(s, F.lit(" \t\n\r"))


def safe_filename(path: Column) -> Column:
    return F.translate(path, "/\\", "__")


def index_name(name: Column) -> Column:
    """A vector index's name: lower case, anything else than a-z, 0-9 and - as one -, none at the ends."""
    bare = F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9-]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("default-index"))


def year(s: Column) -> Column:
    """The first year 19xx or 20xx that stands alone; '' if there is none."""
    return F.regexp_extract(s, fixed.YEAR, 2)


def email(s: Column) -> Column:
    return F.regexp_extract(s, fixed.EMAIL, 0)


def without_newlines(s: Column) -> Column:
    return F.regexp_replace(s, "[\\r\\n]", "")


def valid_utf8(s: Column) -> Column:
    """The bytes as a string, with what isn't UTF-8 replaced."""
    return F.make_valid_utf8(s)


def clean_author(s: Column, strict: bool = False) -> Column:
    """An author's bare name. strict: braces go with their contents and A-Z is folded; else braces alone go."""
    if strict:
        return ascii_lower(trimmed(F.regexp_replace(s, "\\{[^}]*\\}", "")))
    return trimmed(F.regexp_replace(F.regexp_replace(s, "\\{(email|orcid|aff(iliation)?):[^}]*\\}", ""), "[{}]", ""))


def split_authors(s: Column, strict: bool = False) -> Column:
    """Pieces between \\and, comma, \\\\ and semicolon. strict: up to the first empty piece; else empty ones go."""
    pieces = F.split(s, "\\\\and|,|\\\\\\\\|;", -1)
    if not strict:
        return F.filter(pieces, lambda p: trimmed(p) != "")
    stop = F.array_position(pieces, "")
    return F.when(stop > 0, F.slice(pieces, F.lit(1), (stop - 1).cast("int"))).otherwise(pieces)


def author_struct(piece: Column, strict: bool = False) -> Column:
    """name, email, orcid and affiliation labels of one author's piece."""
    field = lambda name: F.nullif(F.regexp_extract(piece, f"\\{{{name}:\\s*([^}}]+)\\}}", 1), F.lit(""))
    labels = F.regexp_extract_all(piece, F.lit("\\{aff(?:iliation)?:\\s*([^}]+)\\}"), F.lit(1))
    return F.struct(clean_author(piece, strict).alias("name"), field("email").alias("email"), field("orcid").alias("orcid"), labels.alias("affiliation_labels"))


def argument(value: Column, command: str) -> Column:
    """The contents of the first brace after a command, with braces inside it at any depth; '' if there is none, and up to
    the end of the text if it never closes."""
    rest = F.regexp_extract(value, f"\\\\{command}\\*?\\s*(?:\\[[^\\]]*\\])?\\s*\\{{([\\s\\S]*)", 1)
    # the text up to each closing brace; the first that leaves as many closed as opened, but for the outer one, ends it
    parts = F.split(rest, "\\}", -1)
    opened = lambda p: F.length(p) - F.length(F.replace(p, F.lit("{"), F.lit("")))
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))
    step = lambda s, p: F.when(s["depth"] == 0, s).otherwise(F.struct((s["depth"] + opened(p) - 1).cast("int").alias("depth"), (s["n"] + 1).alias("n")))
    taken = F.aggregate(parts, start, step)["n"]
    return F.array_join(F.slice(parts, F.lit(1), taken), "}")


def author_names(value: Column) -> Column:
    """Names of all \\author commands of a text."""
    found = F.regexp_extract_all(value, F.lit("\\\\author\\s*(?:\\[[^\\]]*\\])?\\s*\\{((?:[^{}]|\\{[^{}]*\\})*)\\}"), F.lit(1))
    return F.flatten(F.transform(found, lambda a: F.transform(split_authors(a), lambda p: clean_author(p))))


def affiliations(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(fixed.AFFILIATION), F.lit(1))


def section_name(value: Column) -> Column:
    return argument(value, "(?:sub)*section")


def graphics_file(value: Column) -> Column:
    return argument(value, "includegraphics")


def figure_caption(value: Column) -> Column:
    return argument(value, "caption")


def citation_keys(value: Column) -> Column:
    """Keys of a citation's argument, between commas."""
    return F.filter(F.transform(F.split(value, ","), trimmed), lambda k: k != "")


def inline_math(s: Column) -> Column:
    """A text with its $...$ parts and the rest in tags of their own. Math doesn't span lines."""
    parts = F.filter(F.split(F.regexp_replace(s, fixed.INLINE_MATH, "\u0001\u0002$1\u0001"), "\u0001"), lambda p: p != "")
    math = lambda p: F.concat(F.lit("<inline_math>"), F.substr(p, F.lit(2)), F.lit("</inline_math>\n"))
    plain = lambda p: F.concat(F.lit("<text_content>"), p, F.lit("</text_content>\n"))
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("\u0002"), math(p)).otherwise(plain(p))), "")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two float arrays, in doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all of two sets of words; 0 if both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(0.0))
