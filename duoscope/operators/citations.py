"""Citations of an answer, and the source lines that they quote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoscope.functions.text import let, split_lines, squeeze, strip, unescape

CITATION = '(?Ud)([AB]-\\d+)\\s+"(.*?)"(?=\\s*[,\\]])'


def find_citations(answers: DataFrame) -> DataFrame:
    """pair_id, n (from 0), chunk_id, quote of each citation in `answer`."""
    both = F.arrays_zip(F.regexp_extract_all("answer", F.lit(CITATION), F.lit(1)).alias("chunk_id"), F.regexp_extract_all("answer", F.lit(CITATION), F.lit(2)).alias("quote"))
    return answers.select("pair_id", F.posexplode(both).alias("n", "c")).select("pair_id", "n", F.col("c.chunk_id").alias("chunk_id"), F.col("c.quote").alias("quote"))


def wrapped_line(lines: Column, wanted: Column) -> Column:
    """The number (from 0) of the line where a quote that runs over lines starts, as an array; empty where it doesn't occur. Linear in the text."""

    def found(flat: Column) -> Column:
        start = F.struct((F.instr(F.array_join(flat, " "), squeeze(wanted)) - 1).alias("at"), F.lit(0).alias("pos"), F.lit(-1).alias("line"))
        step = lambda s, x: F.struct(s["at"].alias("at"), (s["pos"] + F.length(x) + 1).alias("pos"), (s["line"] + (s["pos"] <= s["at"]).cast("int")).alias("line"))
        return let(F.aggregate(flat, start, step), lambda s: F.when(s["at"] >= 0, F.array(s["line"])).otherwise(F.array().cast("array<int>")))

    return let(F.transform(lines, squeeze), found)


def matching_lines(lines: Column, wanted: Column) -> Column:
    """Numbers (from 0) of the lines equal to the quote, else of those holding it, else of the one where it starts if it runs over lines."""

    def numbers(test: Callable[[Column], Column]) -> Column:
        marked = F.transform(lines, lambda line, i: F.struct(test(line).alias("hit"), i.alias("i")))
        return F.transform(F.filter(marked, lambda x: x["hit"]), lambda x: x["i"])

    def found(w: Column) -> Column:
        exact, held = numbers(lambda line: strip(line) == w), numbers(lambda line: F.contains(line, w))
        return let(exact, lambda e: F.when(F.size(e) > 0, e).otherwise(let(held, lambda h: F.when(F.size(h) > 0, h).otherwise(wrapped_line(lines, w)))))

    return let(wanted, found)


def resolve(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every citation with source, line, text and unique; these are null where the id or the quote isn't found."""
    known = chunks.select("pair_id", "chunk_id", "source", "start_line", F.col("text").alias("chunk_text"))
    joined = citations.join(known, ["pair_id", "chunk_id"], "left").withColumn("lines", split_lines(F.col("chunk_text"))).withColumn("wanted", strip(F.col("quote")))
    raw = matching_lines(F.col("lines"), F.col("wanted"))
    both = let(raw, lambda hits: F.when(F.size(hits) > 0, hits).otherwise(matching_lines(F.col("lines"), unescape(F.col("wanted")))))
    hits = joined.withColumn("hits", F.when(F.col("chunk_text").isNotNull() & (F.col("wanted") != ""), both))
    found = F.size("hits") > 0
    first = F.get("hits", F.lit(0))
    return hits.select(
        "pair_id", "n", "chunk_id", "quote",
        F.when(found, F.col("source")).alias("source"),
        F.when(found, F.col("start_line") + first).cast("int").alias("line"),
        F.when(found, F.get("lines", first)).alias("text"),
        F.when(found, F.size("hits") == 1).alias("unique"),
    )


def citation_counts(resolved: DataFrame) -> DataFrame:
    """pair_id, written, resolved, and resolved_list in the order of the answer."""
    row = F.when(F.col("line").isNotNull(), F.struct("n", "source", "line", "text", "unique"))
    return resolved.groupBy("pair_id").agg(F.count("*").alias("written"), F.count("line").alias("resolved"), F.array_sort(F.collect_list(row)).alias("resolved_list"))


def line_index(chunks: DataFrame) -> DataFrame:
    """pair_id, chunk_id, line_no (from 0), line, key (a hash of the line without white space at its ends): for exact quotes, written once for many answers."""
    lines = chunks.select("pair_id", "chunk_id", F.posexplode(split_lines(F.col("text"))).alias("line_no", "line"))
    return lines.withColumn("key", F.xxhash64(strip(F.col("line"))))


def resolve_by_index(citations: DataFrame, chunks: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """The rows of resolve(), with quotes of whole lines found by an equi-join on their hash; index: line_index(chunks), where it is written already.

    A quote that several answers have is looked up once, and only those that are no whole line are
    searched in the text: a chunk's lines, and their text without breaks, are made once for all of them.
    """
    wanted = strip(F.col("quote"))
    key = ["pair_id", "chunk_id", "wanted"]
    asked = citations.select("pair_id", "chunk_id", wanted.alias("wanted")).filter("wanted != ''").distinct()
    index = line_index(chunks) if index is None else index
    found = asked.withColumn("key", F.xxhash64("wanted")).join(index, ["pair_id", "chunk_id", "key"]).filter(strip(F.col("line")) == F.col("wanted"))
    exact = found.groupBy(*key).agg(F.min(F.struct("line_no", "line")).alias("first"), F.count("*").alias("hits")).select(*key, "first.line_no", "first.line", (F.col("hits") == 1).alias("unique"))

    lines = chunks.select("pair_id", "chunk_id", split_lines(F.col("text")).alias("lines"))
    lines = lines.withColumn("flat", F.transform("lines", squeeze)).withColumn("joined", F.array_join("flat", " "))
    rest = asked.join(exact, key, "left_anti").join(lines, ["pair_id", "chunk_id"])

    def numbers(test: Callable[[Column], Column]) -> Column:
        marked = F.transform("lines", lambda line, i: F.struct(test(line).alias("hit"), i.alias("i")))
        return F.transform(F.filter(marked, lambda x: x["hit"]), lambda x: x["i"])

    def wrapped(w: Column) -> Column:
        start = lambda at: F.struct(at.alias("at"), F.lit(0).alias("pos"), F.lit(-1).alias("line"))
        step = lambda s, x: F.struct(s["at"].alias("at"), (s["pos"] + F.length(x) + 1).alias("pos"), (s["line"] + (s["pos"] <= s["at"]).cast("int")).alias("line"))
        none = F.array().cast("array<int>")
        return let(F.instr(F.col("joined"), squeeze(w)) - 1, lambda at: F.when(at >= 0, F.array(F.aggregate("flat", start(at), step)["line"])).otherwise(none))

    def searched(w: Column) -> Column:
        return let(numbers(lambda line: F.contains(line, w)), lambda h: F.when(F.size(h) > 0, h).otherwise(wrapped(w)))

    plain = unescape(F.col("wanted"))
    second = let(numbers(lambda line: strip(line) == plain), lambda e: F.when(F.size(e) > 0, e).otherwise(searched(plain)))
    hits = let(searched(F.col("wanted")), lambda h: F.when((F.size(h) > 0) | (plain == F.col("wanted")), h).otherwise(second))
    rest = rest.withColumn("hits", hits).filter(F.size("hits") > 0)
    first = F.get("hits", F.lit(0))
    rest = rest.select(*key, first.alias("line_no"), F.get("lines", first).alias("line"), (F.size("hits") == 1).alias("unique"))

    places = chunks.select("pair_id", "chunk_id", "source", "start_line")
    known = exact.unionByName(rest).join(places, ["pair_id", "chunk_id"])
    whole = citations.withColumn("wanted", wanted).join(known, key, "left")
    return whole.select("pair_id", "n", "chunk_id", "quote", "source", (F.col("start_line") + F.col("line_no")).cast("int").alias("line"), F.col("line").alias("text"), "unique")
