"""Line dedup that can be undone: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without ASCII white space at its ends, A-Z in lower case; keys of at least
`least_chars` code points count. The store has three tables: `refs`, a row for each document and key;
`counts`, the number of documents and the best id by key; and `filters`, one cuckoo filter (Fan et al.,
2014) for each shard of the keys. An insertion asks the filters first: keys that no filter knows are
new and are added to the filters and the counts without a look at the old counts; only the others are
merged with them, and those that the counts then don't have are added to the filters as well, so that
every key in the counts has a mark of its own. A deletion takes a document's rows out of refs, counts the affected keys anew and
takes those that nobody holds any more out of the filters, so inserting and deleting a document leaves
the exact tables as they were. Filters only save work: results come from the exact tables.

A key that every document holds is counted by partial sums before it is shuffled, and is one row of its
shard after that.

Defined cases: a null or empty text is one empty line; each row counts as a document, and a key within
one row once; rows that share the id which stays all stay; a null id never is the one that stays; very
long lines are keyed whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.llm.common import checkpointed, slices, utf8

STRIP = b" \t\n\x0b\x0c\r"


def key_of(line: bytes, least_chars: int) -> bytes | None:
    """128 bits of the key's hash; None if it is too short to count."""
    line = line.strip(STRIP)
    if len(line) < least_chars or len(line) < 4 * least_chars and len(line.decode()) < least_chars:
        return None
    return hashlib.md5(line.lower()).digest()


class CuckooFilter:
    """Fingerprints of 128-bit keys, four to a bucket, each in one of two buckets; supports deletion."""

    SLOTS, KICKS = 4, 500

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets  # a power of two
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, keys) / (0.8 * cls.SLOTS))))))

    def dump(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        table = np.frombuffer(raw, np.uint16).reshape(-1, cls.SLOTS).copy()
        return cls(len(table), table)

    def _places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and fingerprint, from the key's first 8 and next 2 bytes."""
        words = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
        return (words[:, 0] % np.uint64(self.buckets)).astype(np.int64), np.maximum(1, words[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)

    def _other(self, bucket, fingerprint):
        return bucket ^ ((fingerprint.astype(np.int64) * 0x5BD1E995) & (self.buckets - 1))

    def contains(self, keys: list[bytes]) -> np.ndarray:
        bucket, mark = self._places(keys)
        return ((self.table[bucket] == mark[:, None]) | (self.table[self._other(bucket, mark)] == mark[:, None])).any(axis=1)

    def insert(self, keys: list[bytes]) -> bool:
        """False if some key found no place; the filter then has to be built anew in a larger size."""
        bucket, mark = self._places(keys)
        rnd = np.random.default_rng(1)
        for kick in range(self.KICKS):
            if not len(mark):
                return True
            for slot in range(self.SLOTS):  # each free slot takes the first that asks for it
                free = self.table[bucket, slot] == 0
                at, first = np.unique(bucket[free], return_index=True)
                chosen = np.flatnonzero(free)[first]
                self.table[at, slot] = mark[chosen]
                left = np.ones(len(mark), bool)
                left[chosen] = False
                bucket, mark = bucket[left], mark[left]
                if not len(mark):
                    return True
            if kick == 0:
                bucket = self._other(bucket, mark)
                continue
            at, first = np.unique(bucket, return_index=True)  # both full: throw one out of each bucket
            slot = rnd.integers(0, self.SLOTS, len(at))
            out, self.table[at, slot] = self.table[at, slot].copy(), mark[first]
            bucket, mark = bucket.copy(), mark.copy()
            mark[first] = out
            bucket[first] = self._other(at, out)
        return not len(mark)

    def delete(self, keys: list[bytes]) -> None:
        for bucket, mark in zip(*self._places(keys), strict=True):
            for b in (bucket, self._other(bucket, mark)):
                slots = np.flatnonzero(self.table[b] == mark)
                if len(slots):
                    self.table[b, slots[0]] = 0
                    break


@dataclass
class LineStore:
    """refs: (key, doc_id); counts: (shard, key, n_docs, keep_id); filters: (shard, keys, filter)."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    least_chars: int = 20

    @classmethod
    def empty(cls, spark: SparkSession, shards: int = 64, least_chars: int = 20) -> LineStore:
        make = lambda schema: spark.createDataFrame([], schema)
        return cls(make("key binary, doc_id long"), make("shard int, key binary, n_docs long, keep_id long"), make("shard int, keys long, filter binary"), shards, least_chars)

    def keyed(self, docs: DataFrame) -> DataFrame:
        """(key, doc_id) of each document's distinct keys."""
        least = self.least_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1):
                found = [{k for line in raw.split(b"\n") if (k := key_of(line, least))} for raw in utf8(batch.column(1))]
                rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array([k for x in found for k in x], pa.binary()), batch.column(0).take(pa.array(rows))], ["key", "doc_id"])

        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "key binary, doc_id long")

    def _count(self, refs: DataFrame) -> DataFrame:
        shard = F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")
        return refs.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keep_id")).select(shard.alias("shard"), "key", "n_docs", "keep_id")

    def insert(self, docs: DataFrame) -> LineStore:
        added = checkpointed(self.keyed(docs))
        fresh = checkpointed(self._count(added))

        def probe(new: pa.Table, old: pa.Table) -> pa.Table:
            """A row (shard, key, known) for each key that the filter may know, and the shard's new filter."""
            keys = new.column("key").to_pylist()
            held = CuckooFilter.load(old.column("filter")[0].as_py()) if old.num_rows else CuckooFilter.sized(len(keys))
            size = old.column("keys")[0].as_py() if old.num_rows else 0
            known = held.contains(keys) if keys else np.zeros(0, bool)
            absent = [k for k, x in zip(keys, known, strict=True) if not x]
            full = size + len(absent) > 0.85 * held.buckets * held.SLOTS or not held.insert(absent)
            shard = (new if new.num_rows else old).column("shard")[0].as_py()
            maybe = [k for k, x in zip(keys, known, strict=True) if x]
            return pa.table({
                "shard": pa.array([shard] * (len(maybe) + 1), pa.int32()),
                "key": pa.array([*maybe, None], pa.binary()),
                "keys": pa.array([*[None] * len(maybe), size + len(absent)], pa.int64()),
                "filter": pa.array([*[None] * len(maybe), None if full else held.dump()], pa.binary()),
            })

        probed = checkpointed(fresh.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(probe, "shard int, key binary, keys long, filter binary"))
        maybe = probed.filter("key is not null").select("key")
        new = fresh.join(maybe, "key", "left_anti").select("shard", "key", "n_docs", "keep_id")
        again = fresh.join(maybe, "key", "left_semi").unionByName(self.counts.join(maybe, "key", "left_semi"))
        again = again.groupBy("shard", "key").agg(F.sum("n_docs").alias("n_docs"), F.max("keep_id").alias("keep_id"))
        counts = checkpointed(self.counts.join(maybe, "key", "left_anti").select("shard", "key", "n_docs", "keep_id").unionByName(new).unionByName(again))
        filters = probed.filter("key is null and filter is not null").select("shard", "keys", "filter")
        false = checkpointed(fresh.join(maybe, "key", "left_semi").join(self.counts, "key", "left_anti").select("shard", "key"))
        outgrown = probed.filter("key is null and filter is null").select("shard")
        if not false.isEmpty():

            def mark(old: pa.Table, false: pa.Table) -> pa.Table:
                if not old.num_rows or not false.num_rows:  # without a filter: outgrown, and built anew from the counts
                    return old
                held, keys = CuckooFilter.load(old.column("filter")[0].as_py()), false.column("key").to_pylist()
                size = old.column("keys")[0].as_py() + len(keys)
                full = size > 0.85 * held.buckets * held.SLOTS or not held.insert(keys)
                return pa.table({"shard": old.column("shard"), "keys": pa.array([size], pa.int64()), "filter": pa.array([None if full else held.dump()], pa.binary())})

            marked = checkpointed(filters.groupBy("shard").cogroup(false.groupBy("shard")).applyInArrow(mark, "shard int, keys long, filter binary"))
            filters = marked.filter("filter is not null")
            outgrown = outgrown.unionByName(marked.filter("filter is null").select("shard"))
        outgrown = checkpointed(outgrown)
        if not outgrown.isEmpty():
            filters = filters.unionByName(self._filters(counts.join(outgrown, "shard", "left_semi")))
        return LineStore(self.refs.unionByName(added), counts, checkpointed(filters), self.shards, self.least_chars)

    @staticmethod
    def _filters(counts: DataFrame) -> DataFrame:
        """Filters built anew, with room to grow, from the keys of whole shards."""

        def build(group: pa.Table) -> pa.Table:
            keys, room = group.column("key").to_pylist(), 2
            while not (made := CuckooFilter.sized(room * len(keys))).insert(keys):
                room *= 2
            return pa.table({"shard": group.column("shard")[:1], "keys": pa.array([len(keys)], pa.int64()), "filter": pa.array([made.dump()], pa.binary())})

        return counts.select("shard", "key").groupBy("shard").applyInArrow(build, "shard int, keys long, filter binary")

    def delete(self, doc_ids: DataFrame) -> LineStore:
        """Without the documents whose doc_id is in `doc_ids`."""
        ids = doc_ids.select("doc_id").distinct()
        refs = checkpointed(self.refs.join(ids, "doc_id", "left_anti").select("key", "doc_id"))
        touched = checkpointed(self.refs.join(ids, "doc_id", "left_semi").select("key").distinct())
        again = checkpointed(self._count(refs.join(touched, "key", "left_semi")))
        counts = checkpointed(self.counts.join(touched, "key", "left_anti").select("shard", "key", "n_docs", "keep_id").unionByName(again))
        shard = F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")
        gone = touched.join(again, "key", "left_anti").select(shard.alias("shard"), "key")

        def forget(old: pa.Table, gone: pa.Table) -> pa.Table:
            if not old.num_rows:
                return old
            held, keys = CuckooFilter.load(old.column("filter")[0].as_py()), gone.column("key").to_pylist()
            if keys:
                held.delete(keys)
            return pa.table({"shard": old.column("shard"), "keys": pa.array([old.column("keys")[0].as_py() - len(keys)], pa.int64()), "filter": pa.array([held.dump()], pa.binary())})

        filters = checkpointed(self.filters.groupBy("shard").cogroup(gone.groupBy("shard")).applyInArrow(forget, "shard int, keys long, filter binary"))
        return LineStore(refs, counts, filters, self.shards, self.least_chars)

    def apply(self, docs: DataFrame, least_docs: int = 3) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept (text): without the lines whose key at least least_docs documents hold, but in the one of the largest id."""
        repeated = checkpointed(self.counts.filter(F.col("n_docs") >= least_docs).select("key", "keep_id"))
        drop = self.refs.join(repeated, "key").filter("not (doc_id <=> keep_id)").select("doc_id", "key")
        drop = drop.groupBy("doc_id").agg(F.collect_set("key").alias("drop"))  # at most a document's own lines
        least = self.least_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1):
                rows = []
                for raw, keys in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                    lines = raw.split(b"\n")
                    keys = set(keys or ())
                    kept = [x for x in lines if key_of(x, least) not in keys] if keys else lines
                    rows.append((len(lines), len(lines) - len(kept), b"\n".join(kept)))
                n, dropped, text = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

        given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        with_drop = given.join(drop.hint("shuffle_hash"), given["doc_id"].eqNullSafe(drop["doc_id"]), "left").select(given["doc_id"], "text", "drop")
        return with_drop.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept string")


def shards_for(lines: int, per_shard: int = 50_000) -> int:
    return max(16, -(-lines // per_shard))


def line_dedup(docs: DataFrame, least_docs: int = 3, least_chars: int = 20) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept of all documents against each other."""
    lines = docs.agg(F.coalesce(F.sum(F.length(F.col("text").cast("string"))), F.lit(0))).first()[0] // 300
    store = LineStore.empty(docs.sparkSession, shards_for(lines), least_chars).insert(docs)
    return store.apply(docs, least_docs)
