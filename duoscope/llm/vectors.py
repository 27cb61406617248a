"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are scaled to unit length and rotated to principal axes, largest variance first. Different
vectors are sorted by width, label and the cell of a grid on the leading axes and packed into blocks of
bounded size, one written row each. Every two blocks that share a label are compared by a Cartesian
product of the written blocks: its tasks read them again, so a vector is shuffled and written once
however many others it meets. In two blocks, tiles whose boxes on the leading axes are too far apart are
passed over (unit vectors of cosine at least c are at most sqrt(2 - 2c) apart along any axes). In two
tiles the products of the leading dimensions come first, what is left is bounded by the product of the
suffix norms, and a pair is given up as soon as the bound falls below the threshold. Pairs close to the
threshold are computed again from the vectors as given.

The axes are fitted on a bounded sample (`sample_rows`); they change the order of work, never a result.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components, or whose
label is null, links with nothing; vectors of different width never link; equal vectors are compared
once and their links counted for each; labels are compared as they are, of any type that can be grouped
(-0.0 is 0.0, NaN is NaN); rows that share an id are rows of their own; a row with a null id links nothing and is its own null
component; an empty table gives no rows; further columns are ignored. Rows find the block row of their
vector by label and a 128-bit hash of the vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.llm.common import checkpointed, to_each_task
from duoscope.llm.components import connected_components
from duoscope.llm.tiles import spanning_roots

STEPS = (32, 64, 128, 256, 512)
#: Rounding of products in single precision, which sort out pairs but never decide.
SLACK = 1e-4
BOX_DIMS = 16


def principal_axes(vectors: DataFrame, sample_rows: int = 8192) -> dict[int, np.ndarray]:
    """Axes by width, from at most sample_rows vectors, those with the smallest hashes."""
    rows = vectors.select("embedding").orderBy(F.xxhash64("embedding")).limit(sample_rows).toArrow().column(0).to_pylist()
    axes = {}
    for width in {len(x) for x in rows}:
        x = units(np.array([r for r in rows if len(r) == width], np.float64))
        axes[width] = np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1])
    return axes


def scaled(raw: np.ndarray) -> np.ndarray:
    """Rows in double precision, their largest components 1."""
    x = raw.astype(np.float64)
    return x / np.abs(x).max(axis=1, keepdims=True)


def units(raw: np.ndarray) -> np.ndarray:
    x = scaled(raw)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def turned(raw: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Unit rows by axis; as they are where the sample had none of their width."""
    x = units(raw)
    return x @ axes[x.shape[1]] if x.shape[1] in axes else x


class Block:
    """Rows of one width, sorted by label and cell: those given, the same as unit rows by axis, and their tiles."""

    def __init__(self, start: int, of: np.ndarray, copies: np.ndarray, raw: np.ndarray, axes: dict[int, np.ndarray], tile_rows: int):
        self.start, self.of, self.copies, self.raw = start, of, copies, raw
        self.x = turned(raw, axes)
        self.leading: dict[int, np.ndarray] = {}
        self.at = np.arange(0, len(of), tile_rows)
        self.tiles = [slice(a, a + tile_rows) for a in self.at]
        box = self.x[:, :BOX_DIMS]
        self.low, self.high = np.minimum.reduceat(box, self.at), np.maximum.reduceat(box, self.at)
        self.of_low, self.of_high = of[self.at], np.maximum.reduceat(of, self.at)

    def first(self, step: int) -> np.ndarray:
        """The first dimensions and the norm of the others, in single precision: products of two such rows bound the cosine."""
        if step not in self.leading:
            rest = np.linalg.norm(self.x[:, step:], axis=1)
            self.leading[step] = np.column_stack([self.x[:, :step], rest]).astype(np.float32)
        return self.leading[step]


def tiles_in_reach(a: Block, b: Block, threshold: float) -> np.ndarray:
    """Pairs of a tile of a and one of b that share a label and whose boxes are near enough; each pair once where both blocks are one."""
    gap = np.maximum(0, np.maximum(a.low[:, None] - b.high[None], b.low[None] - a.high[:, None]))
    near = (gap * gap).sum(axis=2) <= max(0.0, 2 - 2 * threshold) + 1e-9
    near &= (a.of_low[:, None] <= b.of_high[None]) & (b.of_low[None] <= a.of_high[:, None])
    return np.argwhere(np.triu(near) if a is b else near)


def linked_pairs(a: Block, p: slice, b: Block, q: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i in tile p of a, j in tile q of b) of the pairs with one label and cosine at or over the threshold; each pair once where both tiles are one."""
    width = a.x.shape[1]
    for step in [s for s in STEPS if s < width] + [width]:
        product = a.first(step)[p] @ b.first(step)[q].T if step < width else a.x[p] @ b.x[q].T
        near = product >= (np.float32(threshold - SLACK) if step < width else threshold - 1e-9)
        if a is b and p == q:
            near = np.triu(near, 1)
        if np.count_nonzero(near) <= near.size // 64:
            break
    i, j = np.divmod(np.flatnonzero(near), near.shape[1])
    same = a.of[p][i] == b.of[q][j]
    i, j = i[same], j[same]
    total = product[i, j] if step == width else np.einsum("ij,ij->i", a.x[p][i], b.x[q][j])
    close = np.flatnonzero(np.abs(total - threshold) < 1e-8)
    if len(close):
        u, v = scaled(a.raw[p][i[close]]), scaled(b.raw[q][j[close]])
        total[close] = np.einsum("ij,ij->i", u, v) / (np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1))
    keep = total >= threshold
    return i[keep], j[keep]


def compared(a: Block, b: Block, threshold: float) -> pa.RecordBatch:
    """node, links, root of the rows with links between two blocks or inside one: root is a node that they are linked with over such links."""
    nodes = [np.arange(len(x.of)) + x.start for x in ([a] if a is b else [a, b])]
    node, shift = np.concatenate(nodes), len(nodes[0]) if a is not b else 0
    links, edges = np.zeros(len(node), np.int64), [np.zeros((2, 0), np.int64)]
    rows = np.arange(len(node))
    for s, t in tiles_in_reach(a, b, threshold):
        p, q = a.tiles[s], b.tiles[t]
        i, j = linked_pairs(a, p, b, q, threshold)
        if len(i):
            left, right = rows[: len(a.of)][p], rows[shift:][q]
            links[left] += np.bincount(i, b.copies[q][j], len(left)).astype(np.int64)
            links[right] += np.bincount(j, a.copies[p][i], len(right)).astype(np.int64)
            both, beyond = (left, 0) if a is b and s == t else (np.concatenate([left, right]), len(left))
            to = both[spanning_roots(len(both), i, j + beyond)]
            edges.append(np.stack([both, to])[:, both != to])
    root = spanning_roots(len(node), *np.concatenate(edges, axis=1))
    at = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (node[at], links[at], node[root[at]])], ["node", "links", "root"])


def near_vectors(vectors: DataFrame, threshold: float = 0.93, sample_rows: int = 8192, grid_dims: int = 3, tile_rows: int = 1024, block_bytes: int = 8 << 20) -> DataFrame:
    """vec_id, n_links, component_id, kept: links inside a label at cosine >= threshold, one row per vector."""
    sc = vectors.sparkSession.sparkContext
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    kind, size = (np.float32, 4) if single else (np.float64, 8)
    given = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{'float' if single else 'double'}>"), "label")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    labels = to_each_task(checkpointed(given.select("label").filter("label is not null").distinct().withColumn("of", F.monotonically_increasing_id())))
    axes = principal_axes(given.filter(usable), sample_rows)
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9

    @F.arrow_udf("array<int>")
    def cell(embedding: pa.Array) -> pa.Array:
        """Where a vector lies on a grid on the leading axes."""
        out: list = [None] * len(embedding)
        lengths = embedding.value_lengths().to_numpy(zero_copy_only=False)
        for width in np.unique(lengths):
            at = np.flatnonzero(lengths == width)
            raw = embedding.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), width)
            for k, c in zip(at, np.floor(turned(raw, axes)[:, :grid_dims] / reach).astype(int).tolist(), strict=True):
                out[k] = c
        return pa.array(out, pa.list_(pa.int32()))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order as blocks of one width and of about block_bytes at most; nodes are numbered over the task's rows."""
        node, held, rows = TaskContext.get().partitionId() << 33, [], 0

        def block(parts: list[pa.RecordBatch], start: int) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            of, *numbers = (table.column(c).to_numpy() for c in ("of", "first", "copies", "one", "two"))
            raw = np.concatenate([b.column("embedding").flatten().to_numpy() for b in parts])
            values = [start, parts[0].column("width")[0].as_py(), int(of[0]), int(of[-1]), *(x.tobytes() for x in (of, *numbers, raw))]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            width = batch.column("width").to_numpy()
            at = 0
            while at < len(width):
                if held and held[0].column("width")[0].as_py() != width[at] or rows and rows * width[at] * size >= block_bytes:
                    yield block(held, node)
                    node, held, rows = node + rows, [], 0
                same = int(np.argmax(np.append(width[at:] != width[at], True)))
                take = min(same, max(1, block_bytes // (int(width[at]) * size) - rows))
                held.append(batch.slice(at, take))
                at, rows = at + take, rows + take
        if held:
            yield block(held, node)

    schema = pa.schema([("start", pa.int64()), ("width", pa.int32()), ("of_low", pa.int64()), ("of_high", pa.int64()), *((c, pa.binary()) for c in ("of", "first", "copies", "one", "two", "raw"))])
    n_rows, mean_width = given.count(), sum(axes) / max(1, len(axes))
    parts = max(math.ceil(n_rows * mean_width * size / block_bytes), min(math.ceil(n_rows / 4096), math.ceil(8 * math.sqrt(sc.defaultParallelism))), 1)
    hashes = [F.xxhash64("embedding").alias("one"), F.xxhash64(F.lit(1), "embedding").alias("two")]
    held = given.filter(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).join(labels, "label")
    order = ["width", "of", "cell", "one"]
    rows = held.select("of", F.size("embedding").alias("width"), cell("embedding").alias("cell"), "first", "copies", *hashes, "embedding")
    rows = rows.repartitionByRange(parts, *order).coalesce(parts).sortWithinPartitions(*order)
    blocks = checkpointed(rows.drop("cell").mapInArrow(packed, "start long, width int, of_low long, of_high long, of binary, first binary, copies binary, one binary, two binary, raw binary"))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                value = lambda c: batch.column(c)[r].as_py()  # noqa: B023, E731
                array = lambda c, t: np.frombuffer(batch.column(c)[r].as_buffer(), t)  # noqa: B023, E731
                a, b = (Block(value(f"{s}_start"), array(f"{s}_of", np.int64), array(f"{s}_copies", np.int64), array(f"{s}_raw", kind).reshape(-1, value("a_width")), axes, tile_rows) for s in "ab")
                yield compared(a, a if a.start == b.start else b, threshold)

    a, b = (blocks.select(*(F.col(c).alias(f"{s}_{c}") for c in ("start", "width", "of_low", "of_high", "of", "copies", "raw"))) for s in "ab")
    shared = (F.col("a_width") == F.col("b_width")) & (F.col("a_start") <= F.col("b_start")) & (F.col("a_of_low") <= F.col("b_of_high")) & (F.col("b_of_low") <= F.col("a_of_high"))
    found = checkpointed(a.join(b.hint("shuffle_replicate_nl"), shared).mapInArrow(met, "node long, links long, root long"))

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                columns = [np.frombuffer(v, np.int64) for v in values]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.arange(len(columns[0])) + start, *columns)], ["node", "of", "first", "copies", "one", "two"])

    nodes = blocks.select("start", "of", "first", "copies", "one", "two").mapInArrow(unpacked, "node long, of long, first long, copies long, one long, two long")
    components = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = checkpointed(found.groupBy("node").agg(F.sum("links").alias("links")).join(components, "node"))
    grouped = nodes.join(to_each_task(linked), "node", "left").filter("copies > 1 or links is not null")  # others are alone
    grouped = checkpointed(grouped.select("of", "one", "two", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")))
    names = grouped.groupBy("component").agg(F.min("first").alias("component_id"))  # the smallest id of its vectors
    named = checkpointed(grouped.join(names, "component").select("of", "one", "two", "copies", "links", "component_id"))
    return (
        given.select("vec_id", "label", *(F.when(usable, h).alias(n) for h, n in zip(hashes, ("one", "two"), strict=True)))
        .join(labels, "label", "left")
        .join(named, ["of", "one", "two"], "left")
        .select(
            "vec_id",
            F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
            F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"),
        )
    )
