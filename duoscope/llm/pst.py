"""LM scoring with probabilistic suffix trees (Ron, Singer and Tishby, 1996).

A text is a sequence of words and one end. The model reads it as symbols in order: first the opening
of a token (its first three bytes, closing space included), given the bytes before the token; then the
rest of the token, given its opening.

A context, the last bytes up to `depth`, is a state of a tree if it makes up at least `p_min` of all
symbols and its next-symbol distribution diverges from that of its longest proper suffix by at least
`divergence` (KL, in nats) and by more than its own parameters would cost in a code of minimum
description length, or if a state that does so ends in it. Distributions are smoothed from the
shortest suffix up (Witten-Bell), so each is positive and sums to one, and the longest suffix that is a
state gives a symbol's probability. The p_min test bounds the contexts by depth / p_min, whatever the
corpus. One tree has openings as symbols and the end of the text before as contexts; the other has
bytes as symbols and reads words alone; it learns from each distinct word once, since it spells those
that were not seen. A word that training has seen has its share of the tokens of
its opening, smoothed by Witten-Bell: the product of its further bytes, which is all that an unseen word
has, counts as often as there are words of that opening. The probabilities of all texts sum to one.

Words and openings are counted over the whole corpus in one pass; each distinct word is scored once.
Documents are dealt into blocks of about `block_bytes`, and only the distinct words of a block meet
the word table.

Defined cases: a null or empty text has one token, the end; a null id counts as training; repeated
rows count as often as they occur; without training tokens every count is zero and the trees are their
uniform roots; an empty table gives no rows; further columns are ignored.

The query op5_suffix_tree scores by one tree over whole texts instead (suffix_tree.py), which shares
`Tree` and `fit`.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoscope.llm.common import checkpointed, remainder, slices, utf8

END = b""  # the end among words
SPACE, END_SYMBOL = 0x20, 0x0A
#: Bits of a symbol and number of symbols: bytes, and the opening of a token.
BYTES, OPENINGS = (8, 257), (24, 1 << 24)
SHARE = 0.01
SALTS = 16
TAIL = 3  # bytes before a token that an opening may depend on


def openings(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For each token of the texts, which end in END: its text's number, and the key of the three bytes before it and its opening."""
    line = b"".join([b"\0\0\0" + b" ".join(words) + b"\n\0\0" for words in texts])  # END is the empty string before the line feed
    data = np.frombuffer(line, np.uint8).astype(np.int64)
    sizes = np.array([sum(map(len, words)) + len(words) + 5 for words in texts])
    first = np.cumsum(sizes) - sizes + 3
    at = np.sort(np.concatenate([first, np.flatnonzero(data == SPACE) + 1]))
    a, b, c = data[at], data[at + 1], data[at + 2]
    short = (a == SPACE) | (a == END_SYMBOL)
    b = np.where(short, 0, b)
    c = np.where(short | (b == SPACE), 0, c)
    text = np.searchsorted(first, at, side="right") - 1
    end = at - (at != first[text])  # the space before the token isn't part of the context
    tail = data[end - 3] << 16 | data[end - 2] << 8 | data[end - 1]
    return text, tail << 24 | a << 16 | b << 8 | c


def counts(docs: DataFrame, training: Column, flush: int = 200_000) -> DataFrame:
    """(word, key, c): every distinct token of all documents with its count in those of training, and the counts of openings there; either has the other's column null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, other, keys, tokens = Counter(), set(), [], 0

        def rows() -> pa.RecordBatch:
            other.difference_update(trained)
            words = [*trained, *other]
            key, n = np.unique(np.concatenate(keys or [np.zeros(0, np.int64)]), return_counts=True)
            out = [
                pa.array([*words, *repeat(None, len(key))], pa.binary()),
                pa.concat_arrays([pa.nulls(len(words), pa.int64()), pa.array(key)]),
                pa.array([*trained.values(), *repeat(0, len(other)), *n.tolist()], pa.int64()),
            ]
            trained.clear()
            other.clear()
            keys.clear()
            return pa.RecordBatch.from_arrays(out, ["word", "key", "c"])

        for batch in slices(batches, 1):
            learnt = []
            for use, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words = text.lower().split()
                words.append(END)
                if use:
                    trained.update(words)
                    learnt.append(words)
                else:
                    other.update(words)
            if learnt:
                keys.append(openings(learnt)[1])
                tokens += len(keys[-1])
            if len(trained) + len(other) > flush or tokens > 10 * flush:
                yield rows()
                tokens = 0
        yield rows()

    parts = docs.select(training.alias("training"), F.col("text").cast("string")).mapInArrow(count, "word binary, key long, c long")
    return parts.groupBy("word", "key").agg(F.sum("c").alias("c"))


def spelt(word: bytes) -> bytes:
    return b" " + word + b" " if word != END else bytes((SPACE, END_SYMBOL))


def grams(words: list[bytes], depth: int) -> Iterator[np.ndarray]:
    """For each length of contexts: for all symbols of the words the key of context and symbol."""
    strings = [spelt(w) for w in words]
    size = np.array([len(s) for s in strings])
    data = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64)
    start = np.repeat(np.cumsum(size) - size, size)
    before = np.arange(len(data)) - start
    key = data.copy()
    for d in range(depth + 1):
        if d:
            key[d:] += data[:-d] << (8 * d)
        ok = before >= max(d, 1)
        yield key[ok] + (d << 56)


def gram_counts(words: DataFrame, depth: int) -> DataFrame:
    """(key, c): in how many distinct words of training, repeats in a word included, a symbol follows a context; key: length of the context, its bytes, the symbol."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key in grams(batch.column(0).to_pylist(), depth):
                keys, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "c"])

    return words.filter("c > 0").select("word").mapInArrow(count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


class Tree:
    """States by the length of their context, each with its smoothed next-symbol distribution."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, divergence: float, kind: tuple[int, int] = BYTES):
        """keys: length of the context from bit 56 up, its bytes, the symbol; none is missing for a context or its suffixes."""
        self.bits, self.symbols = kind
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(np.float64)
        self.levels: list[tuple[np.ndarray, ...]] = []
        found = []
        for d in range(depth + 1):
            level = slice(*np.searchsorted(keys, [d << 56, (d + 1) << 56]))
            k, c = keys[level] - (d << 56), counts[level]
            context, where, kinds = np.unique(k >> self.bits, return_inverse=True, return_counts=True)
            total = np.bincount(where, c, len(context))
            escape = kinds / (kinds + total) if len(context) else total
            lower = np.full(len(k), 1 / self.symbols) if d == 0 else found[-1].smoothed(k & ((1 << (8 * (d - 1) + self.bits)) - 1))
            p = (c + kinds[where] * lower) / (total + kinds)[where] if len(k) else c
            gain = np.bincount(where, c / total[where] * np.log(p / lower), len(context)) if d else np.full(len(context), np.inf)
            sure = total * gain >= kinds / 2 * np.log(total + 1) if d else True  # else it may be chance
            found.append(_Level(d, k, p, context, escape, (gain >= divergence) & sure))
        for longer, shorter in zip(found[:0:-1], found[-2::-1], strict=True):  # suffixes of states are states
            shorter.kept |= np.isin(shorter.context, longer.context[longer.kept] & ((1 << (8 * shorter.depth)) - 1))
        for x in found:
            here = np.isin(x.key >> self.bits, x.context[x.kept])
            self.levels.append((x.key[here], np.log10(x.p[here]), x.context[x.kept], np.log10(x.escape[x.kept])))

    def symbol(self, context: np.ndarray, symbol: np.ndarray, length: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol after its context (bytes as an integer, of which `length` count)."""
        logp = np.zeros(len(symbol))
        todo = np.arange(len(symbol))
        for d in range(len(self.levels) - 1, -1, -1):
            known, known_p, contexts, escape = self.levels[d]
            if not len(contexts):
                continue
            now = todo[length[todo] >= d]
            ctx = context[now] & ((1 << (8 * d)) - 1)
            key = ctx << self.bits | symbol[now]
            i = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = known[i] == key
            logp[now[hit]] += known_p[i[hit]]
            j = np.minimum(np.searchsorted(contexts, ctx), len(contexts) - 1)
            missed = ~hit & (contexts[j] == ctx)
            logp[now[missed]] += escape[j[missed]]
            todo = np.setdiff1d(todo, now[hit], assume_unique=True)
        logp[todo] -= math.log10(self.symbols)
        return logp

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each word with its closing space, or of the end; and of its opening."""
        depth = len(self.levels) - 1
        strings = [spelt(w) for w in words]
        size = np.array([len(s) for s in strings])
        data = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64)
        word = np.repeat(np.arange(len(words)), size)
        before = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
        context = np.zeros(len(data), np.int64)
        for d in range(1, depth + 1):
            context[d:] |= data[:-d] << (8 * (d - 1))
        at = np.flatnonzero(before)
        logp = self.symbol(context[at], data[at], np.minimum(before[at], depth))
        return np.bincount(word[at], logp, len(words)), np.bincount(word[at], logp * (before[at] <= 3), len(words))


class _Level:
    def __init__(self, depth, key, p, context, escape, kept):
        self.depth, self.key, self.p, self.context, self.escape, self.kept = depth, key, p, context, escape, kept

    def smoothed(self, key: np.ndarray) -> np.ndarray:
        """Probabilities of (context, symbol) keys of this length, which occur."""
        return self.p[np.searchsorted(self.key, key)]


def fit(gram: DataFrame, depth: int, p_min: float, divergence: float, kind: tuple[int, int], share: float = SHARE) -> Tree:
    """The tree from (key, c). At most depth / p_min contexts come to the driver, and of their symbols those that have share * p_min of all (0: every one)."""
    gram = checkpointed(gram)
    context = F.shiftright("key", kind[0])
    symbols = gram.filter(F.shiftright("key", 56) == 0).agg(F.sum("c")).first()[0] or 0
    gram = gram.filter(F.col("c") >= share * p_min * symbols)  # what is rarer counts as never seen there; a suffix has a count as high at least
    often = gram.groupBy(context.alias("context")).agg(F.sum("c").alias("n")).filter(F.col("n") >= max(1.0, p_min * symbols))
    found = gram.withColumn("context", context).join(often, "context").select("key", "c").toArrow()
    return Tree(found.column(0).to_numpy(), found.column(1).to_numpy(), depth, divergence, kind)


def mixed(c: np.ndarray, of_opening: np.ndarray, types: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """log10 of (c + types * 10 ** rest) / (of_opening + types), however small the powers; `rest` where the opening is new."""
    seen = np.log10(np.maximum(c, 1) + types * 10.0 ** np.maximum(rest, -290))  # nothing below 1e-290 changes a count
    with np.errstate(divide="ignore"):
        new = np.log10(types) + rest
    return np.where(types > 0, np.where(c > 0, seen, new) - np.log10(np.maximum(of_opening + types, 1)), rest)


def opening_counts(longest: DataFrame) -> DataFrame:
    """(key, c) for contexts of all lengths from those of TAIL bytes."""
    lengths = [F.struct((F.col("key").bitwiseAND(F.lit((1 << (8 * d + 24)) - 1)) + F.lit(d << 56)).alias("key")) for d in range(TAIL + 1)]
    return longest.select("c", F.inline(F.array(*lengths))).groupBy("key").agg(F.sum("c").alias("c"))


def score(docs: DataFrame, modulus: int = 7, held_out: int = 2, depth: int = 6, p_min: float = 1e-5, divergence: float = 0.005, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row per document."""
    out = F.coalesce(remainder("doc_id", modulus) == held_out, F.lit(False))
    counted = checkpointed(counts(docs, ~out))
    words = counted.filter("word is not null").select("word", "c")
    n, v = words.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    speller = fit(gram_counts(words, depth), depth, p_min, divergence, BYTES)
    opener = fit(opening_counts(counted.filter("key is not null")), TAIL, p_min, divergence, OPENINGS)
    first = F.when(F.col("word") == END, F.lit(END_SYMBOL << 16)).otherwise(F.conv(F.rpad(F.hex(F.substring(F.concat("word", F.lit(b" ")), 1, 3)), 6, "0"), 16, 10).cast("long"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, of_opening, types = (x.to_numpy() for x in batch.columns[1:])
            logp, opening = speller.words(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(mixed(c, of_opening, types, logp - opening))], ["word", "c", "logp"])

    opened = words.withColumn("opening", first).withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int"))
    root = opened.filter("c > 0").groupBy("opening").agg(F.sum("c").alias("of_opening"), F.count("*").alias("types"))
    root = root.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # many words share an opening
    of = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    lexicon = opened.join(root, ["opening", "salt"], "left").select("word", "c", of("of_opening"), of("types"))
    lexicon = lexicon.mapInArrow(scored, "word binary, c long, logp double")

    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / block_bytes))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select("doc_id", "text", out.alias("held_out"), block.alias("block"))

    def distinct(group: pa.Table) -> pa.Table:
        found: set[bytes] = {END}
        for text in utf8(group.column("text").combine_chunks()):
            found.update(text.lower().split())
        return pa.table({"block": pa.array([group.column("block")[0].as_py()] * len(found), pa.int32()), "word": pa.array(list(found), pa.binary())})

    used = dealt.groupBy("block").applyInArrow(distinct, "block int, word binary").join(lexicon, "word")

    def summed(group: pa.Table, known: pa.Table) -> pa.Table:
        where = {w: i for i, w in enumerate(known.column("word").to_pylist())}
        c = known.column("c").to_numpy()
        base, logp = np.log10((c + 1) / (n + v + 1)), known.column("logp").to_numpy()
        texts = [[*x.lower().split(), END] for x in utf8(group.column("text").combine_chunks())]
        rows = []
        for start in range(0, len(texts), 256):
            part = texts[start : start + 256]
            text, key = openings(part)
            keys, which = np.unique(key, return_inverse=True)
            opening = opener.symbol(keys >> 24, keys & ((1 << 24) - 1), np.full(len(keys), TAIL))[which]
            openings_of = np.bincount(text, opening, len(part))
            for tokens, own in zip(part, openings_of.tolist(), strict=True):
                at = np.fromiter(map(where.__getitem__, tokens), np.int64, len(tokens))
                rows.append((len(at), int((c[at] > 0).sum()), n, float(base[at].sum()), own + float(logp[at].sum())))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        names = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
        return pa.table({"doc_id": group.column("doc_id"), "held_out": group.column("held_out")} | {k: pa.array(x, t) for k, x, t in zip(names, zip(*rows, strict=True), kinds, strict=True)})

    return dealt.groupBy("block").cogroup(used.groupBy("block")).applyInArrow(
        summed, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
