"""LM scoring with one probabilistic suffix tree over whole texts (Ron, Singer and Tishby, 1996).

A text is the bytes of its words, each closed by a space, and one line end. The tree predicts every
symbol from the longest suffix of all that was read before it that is a state, words or not: contexts
of up to `depth` bytes reach over spaces and whole words. Before a text lie line ends.

Learning follows the paper: contexts that make up at least `p_min` of all symbols are candidates, those of
them that predict otherwise than their longest proper suffix does are states, and so are the suffixes of
a state. The test is the authors' first one (1994), the divergence of both
distributions in nats, of which a state has `divergence` at least and more than its own parameters would
cost in a code of minimum description length. Smoothing is Witten-Bell's from the shortest suffix up, so
what follows a context sums to one and the probabilities of all texts to one at most (no text has
a space after a space).

Suffixes are counted over the whole corpus, every symbol of a training text once with its `depth` bytes
before, and merged by the bytes next to the symbol. What comes to the driver are the states' candidates
with all their symbols: at most (depth + 1) / p_min contexts, whatever the corpus. Documents are dealt into blocks of
about `block_bytes`, and only the distinct words of a block meet the word table, for the base.

Defined cases: a null or empty text has one token, the end; a null id counts as training; repeated
rows count as often as they occur; without training tokens every count is zero and the tree is its
uniform root; an empty table gives no rows; further columns are ignored.
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
from duoscope.llm.pst import BYTES, END, Tree, fit

WINDOW = 1 << 20  # symbols whose keys a task holds at a time, however long a text
MERGED = 3 << 19  # distinct keys that a task holds before it passes them on, a memory bound


def tokens(texts: pa.Array) -> list[list[bytes]]:
    return [[*text.lower().split(), END] for text in utf8(texts)]


def symbols(texts: list[list[bytes]], depth: int, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each symbol of the texts, which end in END: its text's number, and the key of the `depth` bytes before it and itself."""
    before = b"\n" * 7
    data = np.frombuffer(b"".join([before + b" ".join(words) + b"\n" for words in texts]), np.uint8)
    sizes = np.array([7 + sum(map(len, words)) + len(words) for words in texts], np.int64)
    own = np.ones(len(data), bool)
    own[np.add.outer(np.cumsum(sizes) - sizes, np.arange(7))] = False
    text = np.repeat(np.arange(len(texts), dtype=np.uint32), sizes)[own]
    eight = np.ndarray(max(len(data) - 7, 0), ">i8", data, strides=(1,))  # each symbol after the seven bytes before it
    own, done = own[7:], 0
    for start in range(0, len(eight), window):
        key = eight[start : start + window][own[start : start + window]].astype(np.int64) & ((1 << (8 * depth + 8)) - 1)
        yield text[done : done + len(key)], key
        done += len(key)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts, with the sums of their counts."""
    keys, n = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 2, *parts, strict=True))
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n


def counts(docs: DataFrame, training: Column, flush: int = 200_000) -> DataFrame:
    """(word, c): every distinct token of all documents with its count in those of training."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, other = Counter(), set()

        def rows() -> pa.RecordBatch:
            other.difference_update(trained)
            out = [pa.array([*trained, *other], pa.binary()), pa.array([*trained.values(), *repeat(0, len(other))], pa.int64())]
            trained.clear()
            other.clear()
            return pa.RecordBatch.from_arrays(out, ["word", "c"])

        for batch in slices(batches, 1):
            for use, words in zip(batch.column(0).to_pylist(), tokens(batch.column(1)), strict=True):
                (trained if use else other).update(words)
            if len(trained) + len(other) > flush:
                yield rows()
        yield rows()

    parts = docs.select(training.alias("training"), F.col("text").cast("string")).mapInArrow(count, "word binary, c long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"))


def packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Rising keys and their counts, byte by byte so that they compress."""
    rows = np.stack([np.diff(keys, prepend=0), n]).view(np.uint8).reshape(2, len(keys), 8)
    return pa.compress(rows.transpose(0, 2, 1).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(pa.decompress(data, 16 * size, "zstd"), np.uint8).reshape(2, 8, size)
    steps, n = np.ascontiguousarray(rows.transpose(0, 2, 1)).view(np.int64)[:, :, 0]
    return np.cumsum(steps), n


def suffixes(docs: DataFrame, depth: int, least: float, buckets: int, most: int = MERGED) -> DataFrame:
    """(key, c) of all contexts with `least` symbols after them at least, and of all up to two bytes: how often a symbol follows; key: length of the context from bit 56 up, its bytes, the symbol.

    Tasks count the longest contexts, and pass them on by the three bytes next to the symbol: suffixes of
    three bytes or more have all their counts in one bucket, and shorter ones are few.
    """
    short = min(depth, 2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0

        def rows() -> pa.RecordBatch:
            keys, n = found[0]
            bucket = ((keys >> 8 & 0xFFFFFF) * 2654435761 >> 16) % buckets
            order = np.argsort(bucket, kind="stable")
            keys, n = keys[order], n[order]
            some, first = np.unique(bucket[order], return_index=True)
            parts = [*zip(np.split(keys, first[1:]), np.split(n, first[1:]), strict=True)] if len(some) else []
            out = [pa.array(some, pa.int32()), pa.array([len(k) for k, _ in parts], pa.int64()), pa.array([packed(*x) for x in parts], pa.binary())]
            return pa.RecordBatch.from_arrays(out, ["bucket", "size", "data"])

        for batch in slices(batches, 0):
            for _, key in symbols(tokens(batch.column(0)), depth):
                found.append(np.unique(key, return_counts=True))
                held += len(found[-1][0])
                if held > 2 * most:
                    found = [merged(found)]
                    held = len(found[0][0])
                    if held > most:
                        yield rows()
                        found, held = [], 0
        found = [merged(found)]
        yield rows()

    def grown(group: pa.Table) -> pa.Table:
        found, held, limit = [], 0, 2 * most
        for size, data in zip(group.column("size").to_pylist(), group.column("data"), strict=True):
            found.append(unpacked(data.as_py(), size))
            held += size
            if held > limit:
                found = [merged(found)]
                held = len(found[0][0])
                limit = 2 * max(most, held)
        level, keys, n = [], *merged(found)
        for d in range(depth, short - 1, -1):
            keys, n = merged([(keys & ((1 << (8 * d + 8)) - 1), n)])
            first = np.flatnonzero(np.diff(keys >> 8, prepend=-1))
            total = np.repeat(np.add.reduceat(n, first), np.diff(first, append=len(n)))
            often = (total >= least) | (d == short)
            level.append((keys[often] + (d << 56), n[often]))
        keys, n = (np.concatenate(x) for x in zip(*level, strict=True))
        return pa.table({"key": keys, "c": n})

    parts = docs.select(F.col("text").cast("string")).mapInArrow(count, "bucket int, size long, data binary")
    found = parts.groupBy("bucket").applyInArrow(grown, "key long, c long")
    found = found.groupBy("key").agg(F.sum("c").alias("c"))
    lengths = [F.struct((F.col("key").bitwiseAND(F.lit((1 << (8 * d + 8)) - 1)) + F.lit(d << 56)).alias("key")) for d in range(short)]
    every = F.when(F.shiftright("key", 56) == short, F.array(F.struct("key"), *lengths)).otherwise(F.array(F.struct("key")))
    return found.select("c", F.inline(every)).groupBy("key").agg(F.sum("c").alias("c"))


class States:
    """A tree's states as ranges of contexts, the byte next to the symbol first: the longest state of a context is the innermost range."""

    def __init__(self, tree: Tree):
        self.uniform = -math.log10(tree.symbols)
        contexts = [level[2] for level in tree.levels]
        first = np.cumsum([0, *map(len, contexts)])
        sizes = [1 << (8 * (6 - d)) for d in range(len(contexts))]
        ranges = [(c.view(np.uint64).byteswap() >> 16).view(np.int64) for c in contexts]
        order = np.lexsort((np.repeat(np.arange(len(contexts)), np.diff(first)), np.concatenate(ranges)))
        number = np.empty(len(order), np.int64)  # states in the order of their ranges, so that near contexts have near entries
        number[order] = np.arange(len(order))
        self.start = np.unique(np.concatenate([np.zeros(1, np.int64), *(x for r, size in zip(ranges, sizes, strict=True) for x in (r, r + size))]))
        self.state = np.full(len(self.start), -1)
        self.parent = np.full(len(order), -1)
        entries = []
        for d, (r, size) in enumerate(zip(ranges, sizes, strict=True)):
            if not len(r):
                continue
            own = number[first[d] : first[d + 1]]
            rising = np.argsort(r)
            at = np.searchsorted(r[rising], self.start, side="right") - 1
            inside = (at >= 0) & (self.start < r[rising][at] + size)
            self.state[inside] = own[rising][at[inside]]
            if d:
                self.parent[own] = number[first[d - 1] + np.searchsorted(contexts[d - 1], contexts[d] & ((1 << (8 * d - 8)) - 1))]
            entries.append(own[np.searchsorted(contexts[d], tree.levels[d][0] >> 8)] * 256 + (tree.levels[d][0] & 255))
        entry = np.concatenate([*entries, np.full(1, np.iinfo(np.int64).max)])
        rising = np.argsort(entry)
        self.entry = entry[rising]
        self.logp = np.concatenate([*(level[1] for level in tree.levels), np.zeros(1)])[rising]
        self.escape = np.concatenate([level[3] for level in tree.levels])[order]

    def symbol(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol after its context, whose bytes are 48 bits with the last one highest; fastest where contexts rise."""
        logp = np.zeros(len(symbol))
        state, todo = self.state[np.searchsorted(self.start, context, side="right") - 1], np.arange(len(symbol))
        while len(todo):
            none = state < 0
            logp[todo[none]] += self.uniform
            todo, state = todo[~none], state[~none]
            wanted = state * 256 + symbol[todo]
            at = np.searchsorted(self.entry, wanted)
            hit = self.entry[at] == wanted
            logp[todo[hit]] += self.logp[at[hit]]
            todo, state = todo[~hit], state[~hit]
            logp[todo] += self.escape[state]
            state = self.parent[state]
        return logp


def scores(states: States, texts: list[list[bytes]], depth: int) -> np.ndarray:
    """log10 probability of each text, every symbol by the longest state before it."""
    out = []
    for start in range(0, len(texts), 256):
        part = texts[start : start + 256]
        found = np.zeros(len(part))
        for text, key in symbols(part, depth):
            key = key.view(np.uint64)
            both = np.sort(key.byteswap() << 8 | (key & 255) << 8 | text.astype(np.uint64))  # context, symbol, text: one of 256
            each = (both >> 8).view(np.int64)
            first = np.flatnonzero(np.diff(each, prepend=-1))
            logp = states.symbol(each[first] >> 8, each[first] & 255)
            found += np.bincount((both & 255).view(np.int64), np.repeat(logp, np.diff(first, append=len(each))), len(part))
        out.append(found)
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, modulus: int = 7, held_out: int = 2, depth: int = 6, p_min: float = 1e-6, divergence: float = 0.005, block_bytes: int = 8 << 20, bucket_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row per document."""
    if not 0 <= depth <= 6:
        raise ValueError("a context, its symbol and its length share 64 bits: depth is 6 at most")
    out = F.coalesce(remainder("doc_id", modulus) == held_out, F.lit(False))
    words = checkpointed(counts(docs, ~out))
    n, v, read = words.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.expr("c * (octet_length(word) + 1)")), F.lit(0))).first()
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    buckets = min(max(1, math.ceil(total / bucket_bytes)), 1 << 12)
    states = States(fit(suffixes(docs.filter(~out), depth, max(1.0, p_min * read), buckets), depth, p_min, divergence, BYTES, 0))

    blocks = max(1, math.ceil(total / block_bytes))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select("doc_id", "text", out.alias("held_out"), block.alias("block"))

    def distinct(group: pa.Table) -> pa.Table:
        found: set[bytes] = {END}
        for text in utf8(group.column("text").combine_chunks()):
            found.update(text.lower().split())
        return pa.table({"block": pa.array([group.column("block")[0].as_py()] * len(found), pa.int32()), "word": pa.array(list(found), pa.binary())})

    used = dealt.groupBy("block").applyInArrow(distinct, "block int, word binary").join(words, "word")

    def summed(group: pa.Table, known: pa.Table) -> pa.Table:
        where = {w: i for i, w in enumerate(known.column("word").to_pylist())}
        c = known.column("c").to_numpy()
        base = np.log10((c + 1) / (n + v + 1))
        rows = []
        for part in slices(group.select(["text"]).combine_chunks().to_batches(), 0, WINDOW):
            texts = tokens(part.column(0))
            for words_of, own in zip(texts, scores(states, texts, depth).tolist(), strict=True):
                at = np.fromiter(map(where.__getitem__, words_of), np.int64, len(words_of))
                rows.append((len(at), int((c[at] > 0).sum()), n, float(base[at].sum()), own))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        names = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
        return pa.table({"doc_id": group.column("doc_id"), "held_out": group.column("held_out")} | {k: pa.array(x, t) for k, x, t in zip(names, zip(*rows, strict=True), kinds, strict=True)})

    return dealt.groupBy("block").cogroup(used.groupBy("block")).applyInArrow(
        summed, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
