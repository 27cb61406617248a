"""Grouping of spelling variants by a dictionary of pairs of trie nodes.

The nodes of a forward trie stand for the beginnings of words, those of a reversed trie for their ends,
and every node has a number: up to seven letters are the number themselves, eight bits a letter (no
letter is over U+00FF), longer ones are numbered from a table of the distinct ones. A word is whole at a
pair (beginning of i letters, end from letter i), and skips one letter at a pair (beginning of i
letters, end from letter i + 1). At a pair of numbers there meet, exactly:

- the words that differ in the skipped letter only: neighbours by replacement, each pair of words once;
- at most one word that is whole there: the neighbour by deletion of those that skip a letter. Of equal
  letters in a row only the first is skipped for this, so that a pair of words meets once.

A group has as many rows as there are letters, at most, and is summed up without making its pairs: a
row's neighbours are as many as the others, the best of them is the group's best or its second.

Defined cases: null and empty texts have no words; a null doc_id counts as an empty one; documents that
repeat count again; words of any length are taken (of ends and beginnings over 32 letters the SHA-256
stands for the letters); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duoscope.llm.common import checkpointed, slices

LETTERS = "[A-Za-zÀ-ÿ]+"
#: Words that a task counts before it sends the counts on.
HELD = 200_000
#: Letters that fit into a number, and letters of which the text itself is the key of a node.
PACKED, PLAIN = 7, 32


def altered(run: str, h: int, modulus: int = 97) -> str:
    """A run as it is counted: without one letter, where the modulus divides its hash."""
    at = h % len(run)
    return run[:at] + run[at + 1 :] if h % modulus == 0 else run


def word_counts(docs: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of the words of at least `shortest` letters that occur at least `least` times."""
    find = re.compile(LETTERS).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in slices(batches, 1):
            ids = batch.column(0).to_pylist()
            for id_, text in zip(ids, pc.ascii_lower(batch.column(1)).to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if id_ is None else id_}:".encode())
                for word, n in Counter(find(text or "")).items():
                    word = altered(word, zlib.crc32(word.encode(), start))
                    if len(word) >= shortest:
                        counts[word] += n
                if len(counts) > HELD:
                    yield told()
        yield told()

    parts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def keys(word: str) -> list[bytes]:
    """A key for each beginning of the word of over PACKED letters."""
    out, digest = [], hashlib.sha256(word[:PLAIN].encode())
    for i in range(PACKED + 1, len(word) + 1):
        if i <= PLAIN:
            out.append(word[:i].encode())
        else:
            digest.update(word[i - 1].encode())
            out.append(b"\0" + digest.digest())
    return out


def packed(letters: Column) -> Column:
    """Up to seven letters as a number from 0 down, so that numbers of a table from 1 up differ from all of them."""
    return -F.aggregate(letters, F.lit(0).cast("long"), lambda a, c: a * 256 + F.ascii(c))


def trie_nodes(words: DataFrame) -> DataFrame:
    """word, at (0 to its length), node: the number of its beginning of that length. words: (word, letters), letters an array."""

    @F.arrow_udf("array<binary>")
    def deep(column: pa.Array) -> pa.Array:
        return pa.array([keys(w) for w in column.to_pylist()], pa.list_(pa.binary()))

    shallow = words.select("word", F.explode(F.sequence(F.lit(0), F.least(F.size("letters"), F.lit(PACKED)))).alias("at"), "letters")
    shallow = shallow.select("word", "at", packed(F.slice("letters", 1, F.col("at"))).alias("node"))
    long_ = checkpointed(words.filter(F.size("letters") > PACKED).select("word", F.posexplode(deep(F.array_join("letters", ""))).alias("n", "key")))
    numbered = checkpointed(long_.select("key").distinct().withColumn("node", F.monotonically_increasing_id() + 1))
    return shallow.unionByName(long_.join(numbered, "key").select("word", (F.col("n") + PACKED + 1).alias("at"), "node"))


def node_pairs(words: DataFrame) -> DataFrame:
    """word, n, prefix, suffix, skips (a letter, or none) and first (of equal letters in a row) of all pairs of a word."""
    split = checkpointed(words.withColumn("letters", F.split("word", "")))
    size = F.size("letters")
    begin = trie_nodes(split.select("word", "letters")).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("at", "node"))).alias("p"))  # one entry a letter
    end = trie_nodes(split.select("word", F.reverse("letters").alias("letters"))).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("at", "node"))).alias("s"))
    both = split.join(begin, "word").join(end, "word")
    # The end from letter i on is entry size - i of the reversed word.
    at = lambda i: F.get("letters", i)
    node = lambda side, i: F.get(side, i)["node"]
    whole = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(node("p", i).alias("prefix"), node("s", size - i).alias("suffix"), F.lit(False).alias("skips"), F.lit(False).alias("first")))
    skip = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.struct(node("p", i).alias("prefix"), node("s", size - i - 1).alias("suffix"), F.lit(True).alias("skips"), ((i == 0) | (at(i) != at(i - 1))).alias("first")),
    )
    return both.select("word", "n", F.inline(F.concat(whole, skip)))


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n: of each of the words (word, n) how many others differ by one letter, and the best of them by n, then by code points."""
    here = W.partitionBy("prefix", "suffix")
    rows = node_pairs(words)
    met = rows.withColumns({"of": F.sum(F.col("skips").cast("int")).over(here), "rows": F.count("*").over(here)}).filter(F.col("rows") > 1)
    every = here.orderBy(F.desc("skips"), F.desc("n"), "word")  # those that skip a letter first, by rank
    best = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))  # its least is the best
    only = lambda test: F.min(F.when(test, best)).over(here)
    ranked = met.withColumn("rank", F.row_number().over(every))
    ranked = ranked.withColumns(
        {
            "top": only(F.col("skips") & (F.col("rank") == 1)),
            "next": only(F.col("skips") & (F.col("rank") == 2)),
            "whole": only(~F.col("skips")),
            "fit": only(F.col("skips") & F.col("first")),
            "fits": F.sum((F.col("skips") & F.col("first")).cast("int")).over(here),
        }
    )
    other = F.when(F.col("rank") == 1, F.col("next")).otherwise(F.col("top"))
    replaced = F.struct((F.col("of") - 1).alias("near"), other.alias("best"))
    deleted = F.struct(F.when(F.col("first") & F.col("whole").isNotNull(), 1).otherwise(0).cast("long").alias("near"), F.when(F.col("first"), F.col("whole")).alias("best"))
    inserted = F.struct(F.col("fits").alias("near"), F.col("fit").alias("best"))
    seen = ranked.select("word", F.inline(F.when(F.col("skips"), F.array(replaced, deleted)).otherwise(F.array(inserted)))).filter("near > 0")
    summed = seen.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return words.join(summed, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.word").alias("near"), (-F.col("best.less")).alias("near_n")
    )


def variants(docs: DataFrame, shortest: int = 5, least: int = 3, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words: the form is the near word of largest n, where that is `times` the word's own or more."""
    words = checkpointed(word_counts(docs, shortest, least))
    clear = F.col("near_n") >= times * F.col("n")
    formed = checkpointed(near_words(words).select("word", F.when(clear, F.col("near")).alias("form"), "n", "n_near", F.when(clear, F.col("near_n")).alias("form_n")))
    # n grows by `times` at each form, so there are no cycles, and half of a chain is taken at once.
    to = checkpointed(formed.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        step = to.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = checkpointed(to.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        to = ahead.select("word", "root")
        if ahead.filter("moved").isEmpty():
            break
    return formed.join(to, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
