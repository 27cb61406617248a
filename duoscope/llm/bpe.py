"""BPE encoding and decoding with content-defined reuse.

A rolling hash over 16 bytes cuts each text where the content says so, hence texts that share a
passage share its chunks. A Python worker encodes a chunk once and keeps its ids in a bounded store,
which serves all documents of all its tasks. A cut may fall inside a word: the ids at the ends of a
chunk are not used then, and the join is repaired by encoding again what stands between the last
white space before it and the first one after it, over as many chunks as that takes. Each new join is
then encoded once more with the words on either side of it: where the ids of the three are not those
of each alone, the text is encoded as a whole instead. A tokenizer that doesn't drop white space, or
merges across it, is refused. Inside a new chunk, stretches between white space that the worker has met are taken
from a second bounded store; only new ones reach the tokenizer.

Nothing is shuffled: sharing chunks between workers by a shuffle would move every text and its ids,
several times the cost of encoding a chunk once in each worker.

Defined cases: a null or empty text has no tokens and decodes to an empty text; a text without white
space is one piece; ids that are null or unknown decode to nothing; repeated rows and further columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.llm.common import slices, utf8

WINDOW = 16
SPACE = re.compile(rb"[\x09-\x0d\x20]+")
_WORKERS: dict[tuple, "ReusingEncoder"] = {}


class Chunk:
    """Pieces of a chunk; ids are those of the pieces that white space ends on both sides, of which first and last stay known."""

    __slots__ = ("first", "head", "ids", "last", "tail", "words")

    def __init__(self, head: bytes, words: list[bytes], tail: bytes):
        self.head, self.words, self.tail, self.ids = head, words, tail, b""
        self.first, self.last = (words[0], words[-1]) if words else (b"", b"")


def cut(data: np.ndarray, starts: np.ndarray, gear: np.ndarray, bits: int) -> np.ndarray:
    """Ends of chunks: where the hash of the last 16 bytes has `bits` zero bits, and at the end of each text."""
    h = gear[data]
    for shift in (1, 2, 4, 8):
        h[shift:] += h[:-shift] << np.uint32(shift)
    at = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    text = np.searchsorted(starts, at - 1, side="right") - 1
    return np.union1d(at[at - starts[text] >= WINDOW], np.append(starts[1:], len(data)))


class ReusingEncoder:
    """chunk_bits: chunks have 2 ** chunk_bits bytes on average. max_*: entries of either store, which starts anew when full."""

    def __init__(self, path: str, chunk_bits: int = 10, max_chunks: int = 8_000, max_words: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.gear = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)
        self.bits, self.max_chunks, self.max_words = chunk_bits, max_chunks, max_words
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        # Without a decoder of its own the tokenizer joins its tokens by spaces, done here by table.
        self.tokens = None if self.tokenizer.decoder else dict(zip(vocabulary.values(), vocabulary, strict=True))
        for x, y in (("a", "b"), ("word", "1"), ("é", "_x"), ("the", "the")):
            for space in (" ", "\n", "\t ", " \r\n\x0b\x0c "):
                if self.plain(f"{x}{space}{y}") != self.plain(x) + self.plain(y) or self.plain(f"{space}{x}{space}") != self.plain(x):
                    raise ValueError("the tokenizer keeps white space or merges across it, so texts can't be encoded in chunks")
        self.chunks: dict[bytes, Chunk | None] = {}
        self.words: dict[bytes, bytes] = {}

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as 32-bit integers."""
        if len(self.chunks) > self.max_chunks:
            self.chunks.clear()
        if len(self.words) > self.max_words:
            self.words.clear()
        whole = b"".join(texts)
        if not whole:
            return [b""] * len(texts)
        starts = np.cumsum([0, *map(len, texts)])
        full = starts[:-1][np.diff(starts) > 0]
        ends = iter(cut(np.frombuffer(whole, np.uint8), full, self.gear, self.bits).tolist())
        fresh: list[Chunk] = []
        wanted: set[bytes] = set()
        plans = []
        at = 0
        for stop in starts[1:].tolist():
            plan: list[bytes | Chunk] = []
            open_piece: list[bytes] = []
            while at < stop:
                end = next(ends)
                piece, at = whole[at:end], end
                chunk = self.chunks.get(piece, False)
                if chunk is False:
                    chunk = self.chunks[piece] = self.split(piece)
                    if chunk:
                        fresh.append(chunk)
                        wanted.update(chunk.words)
                if chunk is None:
                    open_piece.append(piece)
                    continue
                open_piece.append(chunk.head)
                if join := b"".join(open_piece):
                    plan.append(join)
                    wanted.add(join)
                plan.append(chunk)
                open_piece = [chunk.tail]
            if join := b"".join(open_piece):
                plan.append(join)
                wanted.add(join)
            plans.append(plan)
        missing = [w for w in wanted if w not in self.words]
        for word, code in zip(missing, self.tokenizer.encode_batch_fast([w.decode() for w in missing], add_special_tokens=False), strict=True):
            self.words[word] = array("i", code.ids).tobytes()
        known = self.words.__getitem__
        for chunk in fresh:
            chunk.ids = b"".join(map(known, chunk.words))
            chunk.words = []
        coded = [b"".join([known(x) if isinstance(x, bytes) else x.ids for x in plan]) for plan in plans]
        for k in self.disagreeing(plans, set(missing)):
            coded[k] = array("i", self.plain(texts[k].decode())).tobytes()
        return coded

    def disagreeing(self, plans: list[list[bytes | Chunk]], new: set[bytes]) -> set[int]:
        """Numbers of the texts with a new join whose ids change beside the words around it."""
        at, sides = [], []
        for k, plan in enumerate(plans):
            for i, x in enumerate(plan):
                if isinstance(x, bytes) and x in new:
                    before, after = plan[i - 1].last if i else b"", plan[i + 1].first if i + 1 < len(plan) else b""
                    if before or after:
                        at.append(k)
                        sides.append([w for w in (before, x, after) if w])
        found = self.tokenizer.encode_batch_fast([b" ".join(w).decode() for w in sides], add_special_tokens=False)
        alone = lambda w: self.words[w] if w in self.words else array("i", self.plain(w.decode())).tobytes()
        return {k for k, words, code in zip(at, sides, found, strict=True) if array("i", code.ids).tobytes() != b"".join(map(alone, words))}

    @staticmethod
    def split(piece: bytes) -> Chunk | None:
        """None if there is no white space in it."""
        parts = SPACE.split(piece)
        return Chunk(parts[0], parts[1:-1], parts[-1]) if len(parts) > 1 else None

    def decode(self, ids: list[int]) -> str:
        if self.tokens:
            return " ".join(x for x in map(self.tokens.get, ids) if x is not None)
        return self.tokenizer.decode([i for i in ids if i is not None], skip_special_tokens=False)


#: A task that has read so much gives its stores back to those that come after it in the worker.
RELEASE_BYTES = 4 << 20


def worker(path: str, **settings) -> ReusingEncoder:
    """The encoder of this Python worker, kept between tasks."""
    key = (path, *sorted(settings.items()))
    if key not in _WORKERS:
        _WORKERS[key] = ReusingEncoder(path, **settings)
    return _WORKERS[key]


def encode(docs: DataFrame, path: str, with_text: bool = True, **settings) -> DataFrame:
    """doc_id, ids, and decoded: the text that the ids decode to (null without with_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = worker(path, **settings), 0
        for batch in slices(batches, 1):
            seen += batch.nbytes
            codes = encoder.encode(utf8(batch.column(1)))
            sizes = np.array([len(x) // 4 for x in codes])
            ids = np.frombuffer(b"".join(codes), np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids))
            texts = [encoder.decode(np.frombuffer(x, np.int32).tolist()) for x in codes] if with_text else [None] * len(codes)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])
        if seen > RELEASE_BYTES:
            encoder.chunks.clear()
            encoder.words.clear()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of doc_id and ids; a null list decodes to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker(path)
        for batch in batches:
            texts = [encoder.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what encode() returns."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
