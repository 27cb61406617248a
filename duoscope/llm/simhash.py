"""SimHash near-dedup with covering locality-sensitive hashing (Pagh, 2016).

Each of the 64 bits gets a random vector of radius + 1 bits; each non-zero vector v of radius + 1 bits
gives a mask of the bits whose vector has an odd product with v. If two fingerprints differ in at most
`radius` bits, some v is orthogonal to all vectors of those bits, so they agree under that mask: every
pair within the radius collides in one of the 2 ** (radius + 1) - 1 tables.

Documents with one fingerprint are one node, so copies cost nothing. Colliding nodes are compared in
tiles of bounded size, which return the edges of a spanning forest instead of all pairs.

Defined cases: null counts as empty; texts without words have fingerprint zero and link like others;
rows with a null id get a fingerprint and a null component and link nothing; repeated rows are reported
as often as they occur; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoscope.llm.common import checkpointed, digests, slices, to_each_task, utf8
from duoscope.llm.components import connected_components
from duoscope.llm.tiles import sides, spanning_roots, tile_pairs

BITS = 64
PARITIES = 2048


def fingerprint(text: bytes, words_per_shingle: int = 3, seed: int = 42) -> int:
    """A bit is set if it is set in over half of the hashes of the shingles, repeats included."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends]
    k = min(words_per_shingle, len(words))
    digest = xxhash.xxh64_digest
    return majority([digest(line[s : e - 1], seed) for s, e in zip(starts, ends[k - 1 :], strict=False)])


def majority(hashes: list[bytes]) -> int:
    """The bits that are set in over half of the 64-bit hashes."""
    bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            fp = np.array([fingerprint(x, words_per_shingle, seed) for x in utf8(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int, bits: int = BITS, seed: int = 7) -> list[int]:
    """2 ** (radius + 1) - 1 masks; any two words of `bits` bits that differ in at most `radius` agree under one of them."""
    vectors = np.random.default_rng(seed).integers(0, 1 << (radius + 1), bits)
    odd = lambda v: [bin(int(x) & v).count("1") % 2 for x in vectors]
    return [sum(bit << i for i, bit in enumerate(odd(v))) for v in range(1, 1 << (radius + 1))]


def table_keys(fp: Column, radius: int, first: int = 0) -> list[Column]:
    """(t, fp, key) of a fingerprint in each of its tables, numbered from `first`."""
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in covering_masks(radius)]
    return [F.struct(F.lit(first + i).alias("t"), fp.alias("fp"), fp.bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)]


def near_edges(nodes: DataFrame, radius: int = 3, tile_rows: int = 1024, few: int = 8) -> DataFrame:
    """Edges (a, b) of (node, fp), distinct fingerprints: those of forests that join what all pairs at `radius` or fewer bits would join.

    Buckets of at most `few` rows give their pairs by a join, larger ones are compared in tiles.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.select("node", "fp").repartition(parts, "fp").select("node", F.inline(F.array(*table_keys(F.col("fp"), radius))))
    counts = checkpointed(rows.groupBy("t", "key").agg(F.count("*").alias("in_bucket")).filter("in_bucket > 1"))

    def compare(group: pa.Table) -> pa.Table:
        node, fp, tile = (group.column(c).to_numpy() for c in ("node", "fp", "tile"))
        x, y = sides(tile, group.column("lo")[0].as_py(), group.column("hi")[0].as_py())
        fp = fp.view(np.uint64)
        i, j = np.nonzero(np.bitwise_count(fp[x, None] ^ fp[None, y]) <= radius)
        root = spanning_roots(len(node), x[i], y[j])
        at = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": node[at], "b": node[root[at]]})

    small = checkpointed(rows.join(counts.filter(f"in_bucket <= {few}"), ["t", "key"]).select("t", "key", "node", "fp"))
    other = small.select("t", "key", F.col("node").alias("b"), F.col("fp").alias("b_fp"))
    pairs = small.join(other, ["t", "key"]).filter("node > b").filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("b_fp"))) <= radius)
    large = tile_pairs(rows, ["t", "key"], "fp", tile_rows, counts.filter(f"in_bucket > {few}").withColumn("sizes", F.lit(0)))
    tiled = large.groupBy("t", "key", "lo", "hi").applyInArrow(compare, "a long, b long")
    return pairs.select(F.col("node").alias("a"), "b").unionByName(tiled)


def near_duplicates(docs: DataFrame, radius: int = 3, words_per_shingle: int = 3, seed: int = 42, tile_rows: int = 1024) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links), one row per document."""
    prints = checkpointed(fingerprints(docs, words_per_shingle, seed))
    nodes = checkpointed(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    components = connected_components(near_edges(nodes, radius, tile_rows))
    named = checkpointed(nodes.join(components, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")))
    of_null = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), of_null.alias("component_id"))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the words and their lengths in bytes."""
    words = text.lower().split()
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64), np.fromiter(map(len, words), np.int64, len(words))


def shingle_hashes(words: np.ndarray, words_per_shingle: int) -> np.ndarray:
    """The distinct 64-bit hashes of the shingles of a row of words, ascending; of all words where they are fewer; none without words."""
    k = min(words_per_shingle, len(words))
    found = np.zeros(len(words) - k + 1 if k else 0, np.uint64)
    for i in range(k):
        found = (found + words[i : i + len(found)]) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(32)
    return np.unique(found)


def word_fingerprint(words: np.ndarray, lengths: np.ndarray, least_bytes: int = 5) -> int:
    """Of the distinct words of at least least_bytes bytes (of all words where none is so long): a few edits move a few bits."""
    if not len(words):
        return 0
    long = words[lengths >= least_bytes]
    return majority([np.unique(long if len(long) else words).astype(">u8").tobytes()])


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two ascending sets of hashes have at least that Jaccard similarity; two empty ones do."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    if not len(x):
        return True
    both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
    return both >= similarity * (len(x) + len(y) - both)


def parities(hashes: np.ndarray, places: int) -> np.ndarray:
    """Parities of the hashes in a power of two of places, by their lowest bits, as 64-bit words. XORing its halves gives that of half the places."""
    odd = np.bincount((hashes & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def wide_places(n: int) -> int:
    """Places for n hashes: 2 n or more, so that sets short of the similarity rarely pass for alike however large they are."""
    return max(PARITIES, 1 << (2 * n - 1).bit_length())


def are_alike(similarity: float) -> Column:
    """alike() of the columns a_hashes and b_hashes."""
    x, y, both = F.size("a_hashes"), F.size("b_hashes"), F.size(F.array_intersect("a_hashes", "b_hashes"))
    return (F.least(x, y) >= similarity * F.greatest(x, y)) & (both >= similarity * (x + y - both))


def common_shingles(texts: DataFrame, words_per_shingle: int, sample_docs: int, most: int) -> np.ndarray:
    """Hashes of shingles that several documents of a sample hold, rarest first; at most `most`."""
    count = texts.count()
    chosen = texts if count <= sample_docs else texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * sample_docs / count) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            found = [shingle_hashes(word_hashes(x)[0], words_per_shingle) for x in utf8(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["shingle"])

    held = chosen.select("text").mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 2")
    top = held.orderBy(F.desc("n"), "shingle").limit(most).toArrow().column("shingle").to_numpy()
    return top[::-1].astype(np.int64).view(np.uint64)


def profiles(texts: DataFrame, similarity: float, words_per_shingle: int, common: np.ndarray) -> DataFrame:
    """node (a number of the row), doc_id, digest, fp, n (shingles), bits (parities of their hashes in PARITIES places), keys.

    keys: the first n - similarity * n + 1 hashes in an order that is the same for all documents, common
    ones last, so that two sets of the similarity or more have a key in common, whatever `common` holds.
    Two parities differ in no more places than the sets differ in shingles. Texts without words share a
    key of their own.
    """
    order = np.argsort(common)
    listed = common[order]

    def of(text: bytes) -> tuple[int, int, list[int], list[int]]:
        words, lengths = word_hashes(text)
        x = shingle_hashes(words, words_per_shingle)
        if not len(x):
            return 0, 0, [0] * (PARITIES // 64), [0]
        rank = np.zeros(len(x), np.int64)
        if len(listed):
            i = np.minimum(np.searchsorted(listed, x), len(listed) - 1)
            rank = np.where(listed[i] == x, order[i] + 1, 0)
        first = len(x) - math.ceil(similarity * len(x) - 1e-6) + 1
        return word_fingerprint(words, lengths), len(x), parities(x, PARITIES).tolist(), x[np.lexsort((x, rank))[:first]].view(np.int64).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 19):
            fp, n, bits, keys = zip(*map(of, utf8(batch.column(1))), strict=True)
            columns = [batch.column(0), digests(batch.column(1)), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "fp", "n", "bits", "keys"])

    return texts.mapInArrow(run, "doc_id long, digest binary, fp long, n long, bits array<long>, keys array<long>").withColumn("node", F.monotonically_increasing_id())


def may_be_alike(similarity: float) -> Column:
    """Whether two sets can be so similar, by their sizes (a_n, b_n) and parities (a_bits, b_bits), whose places differ by a factor of two at most if the sizes fit."""
    words = F.least(F.size("a_bits"), F.size("b_bits"))
    differing = lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))
    halved = lambda x: F.when(F.size(x) > words, differing(F.slice(x, 1, words), F.slice(x, words + 1, words))).otherwise(F.col(x))
    apart = F.aggregate(F.transform(differing(halved("a_bits"), halved("b_bits")), F.bit_count), F.lit(0), lambda s, x: s + x)
    sizes = F.least("a_n", "b_n") >= similarity * F.greatest("a_n", "b_n") - 1e-6
    return sizes & (apart <= (1 - similarity) / (1 + similarity) * (F.col("a_n") + F.col("b_n")) + 1e-6)


def near_in_tile(group: pa.Table, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs of a pair of tiles that may be alike and are of two components, nearest first, in blocks."""
    size, component, tile = (group.column(c).to_numpy() for c in ("n", "component", "tile"))
    bits = group.column("bits").to_numpy(zero_copy_only=False)
    words = np.fromiter(map(len, bits), np.int64, len(bits))
    rows, others = sides(tile, group.column("lo")[0].as_py(), group.column("hi")[0].as_py())

    def folded(at: np.ndarray, width: int) -> np.ndarray:
        found = np.stack(bits[at]).view(np.uint64)
        return found if found.shape[1] == width else found[:, :width] ^ found[:, width:]

    for p, q in itertools.product(np.unique(words[rows]), np.unique(words[others])):
        width = min(p, q)
        if max(p, q) > 2 * width:
            continue  # of sizes too far apart
        left, right = rows[words[rows] == p], others[words[others] == q]
        b = folded(right, width)
        for start in range(0, len(left), 128):
            x = left[start : start + 128]
            a = folded(x, width)
            apart = sum(np.bitwise_count(a[:, None, k] ^ b[None, :, k]).astype(np.int32) for k in range(width))
            near = apart <= (1 - similarity) / (1 + similarity) * (size[x, None] + size[right]) + 1e-6
            near &= np.minimum(size[x, None], size[right]) >= similarity * np.maximum(size[x, None], size[right]) - 1e-6
            near &= component[x, None] != component[right]
            i, j = np.nonzero(near)
            order = np.argsort(apart[i, j], kind="stable")
            yield x[i[order]], right[j[order]]


def bucket_sizes(rows: DataFrame) -> DataFrame:
    return checkpointed(rows.groupBy("bucket").agg(F.count("*").alias("in_bucket"), F.sum("n").alias("sizes")).filter("in_bucket > 1"))


def promising(rows: DataFrame, similarity: float, tile_rows: int, tile_shingles: int) -> DataFrame:
    """(bucket, node) of (bucket, node, component, n, bits): those that may be alike to another of their bucket and not of their component."""

    def compare(group: pa.Table) -> pa.Table:
        seen = np.zeros(group.num_rows, bool)
        for i, j in near_in_tile(group, similarity):
            seen[i] = seen[j] = True
        return group.filter(pa.array(seen)).select(["bucket", "node"])

    paired = tile_pairs(rows, ["bucket"], "node", tile_rows, bucket_sizes(rows.select("bucket", "n")), tile_shingles)
    return paired.groupBy("bucket", "lo", "hi").applyInArrow(compare, "bucket long, node long").distinct()


def linked_in_tiles(rows: DataFrame, similarity: float, tile_rows: int, tile_shingles: int) -> DataFrame:
    """Links (a, b) of (bucket, node, component, n, bits, hashes), rows of a bucket compared with each other.

    Those of a forest that joins what all links between components would join: a pair that is joined
    already needs no look. So what comes out grows with the rows, not with the pairs.
    """

    def compare(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        sets = [x.view(np.uint64) for x in group.column("hashes").to_numpy(zero_copy_only=False)]
        root = np.unique(group.column("component").to_numpy(), return_inverse=True)[1]
        links = []
        for i, j in near_in_tile(group, similarity):
            for x, y in zip(i, j, strict=True):
                if root[x] != root[y] and alike(sets[x], sets[y], similarity):
                    root[root == root[y]] = root[x]
                    links.append((x, y))
        at = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": node[at[:, 0]], "b": node[at[:, 1]]})

    paired = tile_pairs(rows, ["bucket"], "node", tile_rows, bucket_sizes(rows.select("bucket", "n")), tile_shingles)
    return paired.groupBy("bucket", "lo", "hi").applyInArrow(compare, "a long, b long")


def joined(components: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) after further links (a, b)."""
    if links.isEmpty():
        return components
    return checkpointed(connected_components(components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)))


def similar_documents(docs: DataFrame, similarity: float = 0.8, words_per_shingle: int = 5, radius: int = 3, tile_rows: int = 1024, tile_shingles: int = 1 << 19, sample_docs: int = 5_000, most_common: int = 20_000, few: int = 8) -> DataFrame:
    """One row for each doc_id and digest (MD5 of the text, A-Z in lower case): kept, copies (rows that repeat both).

    Of each component of documents whose sets of shingles are similar, the one with the smallest id is
    kept. Covering SimHash joins most copies at little cost: pairs within the radius in a fingerprint of
    the long words, and equal fingerprints. An exact prefix filter on the shingles gives all others:
    the documents of a key that at most `few` share are compared with each other, others with the first
    of them, and where a key then still holds two components, its documents are compared in full, in
    tiles. Every pair is checked on its sets of 64-bit hashes. The sample only orders the shingles; no
    result depends on it.

    Defined cases: null texts and texts without words are alike; a null id is an id like others, and comes
    last; an empty table gives no rows; further columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = checkpointed(profiles(texts, similarity, words_per_shingle, common_shingles(texts, words_per_shingle, sample_docs, most_common)))
    rows = found.select("node", "doc_id", "digest")

    def hashed(nodes: DataFrame) -> DataFrame:
        """(node, n, bits, hashes) of nodes, from the texts; bits: parities in wide_places."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1, 1 << 19):
                held = [shingle_hashes(word_hashes(x)[0], words_per_shingle) for x in utf8(batch.column(1))]
                bits, hashes = ([parities(x, wide_places(len(x))) for x in held], [x.view(np.int64) for x in held])
                columns = [pa.array([len(x) for x in held], pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (bits, hashes))]
                yield pa.RecordBatch.from_arrays([batch.column(0), digests(batch.column(1)), *columns], ["doc_id", "digest", "n", "bits", "hashes"])

        wanted = rows.join(nodes, "node", "left_semi")
        ids = to_each_task(checkpointed(wanted.select(F.col("doc_id").alias("id")).distinct()))
        held = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
        sets = held.mapInArrow(run, "doc_id long, digest binary, n long, bits array<long>, hashes array<long>").dropDuplicates(["doc_id", "digest"])
        return checkpointed(wanted.join(sets, wanted["doc_id"].eqNullSafe(sets["doc_id"]) & (wanted["digest"] == sets["digest"])).select("node", "n", "bits", "hashes"))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are alike."""
        sets = hashed(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        side = lambda x, *columns: sets.select(F.col("node").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in columns))
        pairs = checkpointed(pairs.join(side("a", "n", "bits"), "a").join(side("b", "n", "bits"), "b").filter(may_be_alike(similarity)).select("a", "b"))
        both = pairs.join(side("a", "hashes"), "a").join(side("b", "hashes"), "b")
        return checkpointed(both.filter(are_alike(similarity)).select("a", "b"))

    first = checkpointed(found.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("n")))
    near = near_edges(first.select("node", "fp"), radius, tile_rows)
    same = found.select("node", "fp").join(first.filter("n > 1").select("fp", F.col("node").alias("b")), "fp").filter("node != b").select(F.col("node").alias("a"), "b")
    components = checkpointed(connected_components(verified(checkpointed(near.unionByName(same).distinct()))))

    own = F.coalesce("component", "node").alias("component")
    keyed = found.select("node", F.explode("keys").alias("bucket"))
    owned = found.select("node", "keys").join(components, "node", "left").select(own, F.explode("keys").alias("bucket"))
    mixed = owned.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select("bucket")
    shared = checkpointed(keyed.join(checkpointed(mixed), "bucket").join(components, "node", "left").select("bucket", "node", own))
    marks = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"mark{i}") for i in range(2)]  # equal where the documents are
    held = shared.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("count"), *marks)
    held = held.groupBy("count", "hub", "mark0", "mark1").agg(F.min("bucket").alias("bucket")).select("bucket", "hub", "count")  # of keys with the same documents, one
    shared = checkpointed(shared.join(checkpointed(held), "bucket"))
    small = shared.filter(f"count <= {few}")
    all_of_few = small.join(small.select("bucket", F.col("node").alias("b"), F.col("component").alias("other")), "bucket").filter("node > b and component != other")
    stars = shared.filter(f"count > {few} and node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    stars = stars.unionByName(all_of_few.select(F.col("node").alias("a"), "b")).distinct()
    side = lambda x: found.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits")).join(components.select(F.col("node").alias(x), F.col("component").alias(f"{x}_component")), x, "left")
    apart = ~F.coalesce("a_component", "a").eqNullSafe(F.coalesce("b_component", "b"))
    stars = checkpointed(stars.join(side("a"), "a").join(side("b"), "b").filter(apart & may_be_alike(similarity)).select("a", "b"))
    if not stars.isEmpty():
        components = joined(components, verified(stars))

    many = shared.filter(f"count > {few}").select("bucket", "node").join(components, "node", "left").select("bucket", "node", own)
    mixed = many.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select("bucket")
    many = many.join(checkpointed(mixed), "bucket").join(found.select("node", "n", "bits"), "node")
    bit_shingles = 16 * tile_shingles  # parities take a sixteenth of the hashes or less
    left = checkpointed(promising(many, similarity, tile_rows, bit_shingles))
    if not left.isEmpty():
        chosen = left.groupBy("bucket").agg(F.count("*").alias("count"), *marks).groupBy("count", "mark0", "mark1").agg(F.min("bucket").alias("bucket"))
        left = checkpointed(left.join(checkpointed(chosen.select("bucket")), "bucket"))
        sets = hashed(left.select("node").distinct())
        many = many.drop("n", "bits").join(left, ["bucket", "node"])
        left = checkpointed(promising(many.join(sets.drop("hashes"), "node"), similarity, tile_rows, bit_shingles))  # parities in more places
        rest = many.join(left, ["bucket", "node"]).join(sets, "node")
        components = joined(components, checkpointed(linked_in_tiles(rest, similarity, tile_rows, tile_shingles)))

    named = rows.join(components, "node", "left").select("doc_id", "digest", "node", "component")
    grouped = named.filter("component is not null")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    best = grouped.groupBy("component").agg(F.min(order).alias("best"))
    kept = F.col("component").isNull() | F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.digest") == F.col("digest"))
    decided = named.join(best, "component", "left").withColumn("kept", kept)
    return decided.groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count("*").alias("copies"))
