"""Column functions on text. Lengths are code points, lines are Python's, white space is Unicode's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 3
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
EDGES = "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """Estimated tokens: a third of the length, rounded up."""
    return F.ceil(F.length(text) / CHARS_PER_TOKEN).cast("long")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(strip(text), "(?U)[\\s\\x1c-\\x1f]+", " ")


def truncate(text: Column, limit: int = 300) -> Column:
    whole = strip(text)
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(F.left(whole, F.lit(limit)), F.lit("…")))


def embed_text(header: Column, text: Column) -> Column:
    return F.when(header != "", F.concat_ws("\n", header, text)).otherwise(text)


def split_lines(text: Column) -> Column:
    """Lines as str.splitlines() gives them: every Unicode break counts, a last empty line doesn't."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\\r\\n?", "\n")


def unescape(quote: Column) -> Column:
    """Without the backslashes that escape a mark or an underscore."""
    return F.regexp_replace(quote, "(?U)\\\\(?=[^\\w\\s]|_)", "")


def section_numbers(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit("§(\\d+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def chunk_header(source: Column, label: Column, start: Column, end: Column) -> Column:
    span = F.concat(F.lit("lines "), start.cast("string"), F.lit("-"), end.cast("string"))
    return F.concat(F.lit("["), F.concat_ws(" · ", source, F.nullif(label, F.lit("")), span), F.lit("]"))


def suffix(name: Column) -> Column:
    """The lower-case suffix of a file's name; a name that only starts with a dot has none, nor has one that ends with it."""
    return F.lower(F.regexp_extract(name, "[^/](\\.[^./]+)$", 1))
