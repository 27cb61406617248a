"""Cuts by size as column expressions: stretches behind ever smaller separators, packed with an overlap.

A text is a row of stretches whose lengths alone decide how they are packed, so a fold over them carries
where the open chunk begins and ends and how many lines were passed. Texts of chunks are taken from
blocks of the text, each at most two of them away, so the work grows with the text and not with its square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from duoscope.functions.pieces import MOST, OVERLAP, SEPARATORS, TARGET
from duoscope.functions.text import let, strip

BLOCK = 4096
LEADING = "(?U)^[\\s\\x1c-\\x1f]+"


def breaks(text: Column) -> Column:
    """How many line feeds a text holds."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def cut_behind(text: Column, separator: str) -> Column:
    """The text in parts that end with the separator, but for the last, if there is one."""

    def joined(parts: Column) -> Column:
        with_end = F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, F.lit(separator))).otherwise(p))
        return F.filter(with_end, lambda p: p != "")

    return let(F.split(text, separator, -1), joined)


def finer_by(separator: str) -> Callable[[Column], Column]:
    return lambda part: F.when(F.length(part) > MOST, cut_behind(part, separator)).otherwise(F.array(part))


def stretches(text: Column) -> Column:
    """The text in stretches of at most MOST characters, cut behind separators and at last anywhere; none of an empty text."""
    now = F.filter(F.array(text), lambda p: p != "")
    for separator in SEPARATORS:
        now = F.flatten(F.transform(now, finer_by(separator)))
    hard = lambda p: F.when(F.length(p) > MOST, F.regexp_extract_all(p, F.lit(f"(?s).{{1,{MOST}}}"), F.lit(0))).otherwise(F.array(p))
    return F.flatten(F.transform(now, hard))


def packing(parts: Column) -> Column:
    """Where chunks begin and end in a row of stretches, and the line feeds before their ends: (start, stop, lines)."""
    one = lambda s: F.array(F.struct(s["begin"].alias("start"), s["end"].alias("stop"), s["lines"].alias("lines")))
    start = F.struct(F.lit(0).alias("begin"), F.lit(0).alias("end"), F.lit(0).alias("lines"), F.array().cast("array<struct<start:int,stop:int,lines:int>>").alias("out"))

    def step(s: Column, part: Column) -> Column:
        def with_stop(stop: Column) -> Column:
            over = (s["end"] > 0) & (stop - s["begin"] > TARGET)
            return F.struct(
                F.when(over, F.greatest(s["begin"], s["end"] - OVERLAP, stop - MOST)).otherwise(s["begin"]).alias("begin"),
                stop.alias("end"),
                (s["lines"] + breaks(part)).alias("lines"),
                F.when(over, F.concat(s["out"], one(s))).otherwise(s["out"]).alias("out"),
            )

        return let(s["end"] + F.length(part), with_stop)

    return F.aggregate(parts, start, step, lambda s: F.when(s["end"] > 0, F.concat(s["out"], one(s))).otherwise(s["out"]))


def size_pieces(text: Column, first_line: int = 1) -> Column:
    """The pieces (text, start_line, end_line, label) of a text cut by size, without white space at their ends; none of a blank one."""

    def taken(blocks: Column) -> Column:
        def piece(c: Column) -> Column:
            near = F.concat(F.get(blocks, F.floor(c["start"] / BLOCK).cast("int")), F.coalesce(F.get(blocks, F.floor(c["start"] / BLOCK).cast("int") + 1), F.lit("")))
            body = F.substring(near, c["start"] % BLOCK + 1, c["stop"] - c["start"])

            def named(b: Column) -> Column:
                kept, lead = strip(b), F.regexp_extract(b, LEADING, 0)
                line = F.lit(first_line) + c["lines"] - breaks(b) + breaks(lead)
                return let(kept, lambda k: F.struct(k.alias("text"), line.cast("int").alias("start_line"), (line + breaks(k)).cast("int").alias("end_line"), F.lit("").alias("label")))

            return let(body, named)

        return F.filter(F.transform(packing(stretches(text)), piece), lambda p: p["text"] != "")

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), taken)
