"""Embedding near-dedup by lattice hashing.

Each unit vector is projected at random to a number of times 8 dimensions, and each eight are decoded to the nearest point of the E8 lattice; the
points together name a cell, in each of several independent tables. A vector is stored in its own cell and probes the neighbouring cells that
come from the runner-up point (of the other coset of D8) in one of its blocks. Vectors that meet in a cell, one of them stored there, are
verified by their cosine in double precision, so no pair below the threshold is ever linked; a pair of cosine 0.95 meets in some table with a
chance of about 0.97, one of 0.97 with over 0.99.

Cells get smaller as there are more distinct vectors (`LADDER`), with as many more tables as keep that chance, so that a vector is compared with a few
hundred unlike ones at most, however many there are.

Equal vectors are one class with a multiplicity, so copies never form pairs; classes are told by a 128-bit digest of the vector's bytes, and rows get their
results by it. Vectors of a cell are compared in bounded blocks; a pair that meets in several cells counts only in the cell with the smallest key that they share, which
both rows tell from the keys they carry, so each link is found once; for components a large block gives a spanning forest only.

Defined cases: null, empty or zero vectors and those with null or non-finite components link with nothing; vectors of different lengths
never link; rows with the same vector link, also when they share an id; rows that share an id are one node of the components, but each has the links of its own
vector; rows with a null id take no part and have a null component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from fixlake.functions.graph import checkpointed, connected_components
from fixlake.llm.blocks import blocks, bounds, spanning
from fixlake.llm.common import bounded

THRESHOLD = 0.95
#: (distinct vectors up to this number, blocks of 8 dimensions, scale of the projections, tables). Each line finds pairs of cosine 0.95 with a
#: chance of 0.97, as measured on random pairs.
LADDER = (
    (100_000, 2, 0.5, 8), (1_000_000, 2, 0.6, 12), (5_000_000, 2, 0.7, 18), (100_000_000, 3, 0.6, 30), (1 << 62, 3, 0.7, 56),
)
#: Vectors of a tile, and pairs that are compared at once.
TILE = 4096
STEP = 200_000
#: Blocks of up to so many vectors are compared all at once.
SMALL = 16


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points of D8: whole coordinates with an even sum."""
    points = np.rint(x)
    error = x - points
    odd = np.flatnonzero(points.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(error[odd]).argmax(axis=1)
    points[odd, worst] += np.where(error[odd, worst] >= 0, 1.0, -1.0)
    return points


def nearest_e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest points of E8, and the runners-up from the other coset of D8; doubled, so that they are whole."""
    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    first = (((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1))[:, None]
    return (2 * np.where(first, whole, half)).astype(np.int64), (2 * np.where(first, half, whole)).astype(np.int64)


def projections(size: int, tables: int, blocks_: int) -> np.ndarray:
    return np.random.default_rng(zlib.crc32(f"{size}:{tables}:{blocks_}".encode())).normal(size=(tables, blocks_, 8, size))


def cell_keys(unit: np.ndarray, tables: int, blocks_: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the own cells (n, tables) and of the probed ones (n, tables * blocks)."""
    rng = np.random.default_rng(zlib.crc32(f"keys:{unit.shape[1]}:{tables}:{blocks_}".encode()))
    weights = rng.integers(1, 1 << 62, size=(tables, blocks_, 8), dtype=np.int64).view(np.uint64) | np.uint64(1)
    salt = rng.integers(1, 1 << 62, size=tables, dtype=np.int64).view(np.uint64)
    own, probes = [], []
    for t, matrix in enumerate(projections(unit.shape[1], tables, blocks_)):
        best, other = [], []
        for b in range(blocks_):
            for out, points in zip((best, other), nearest_e8(scale * (unit @ matrix[b].T)), strict=True):
                out.append((points.view(np.uint64) * weights[t, b]).sum(axis=1, dtype=np.uint64))
        total = sum(best) + salt[t]
        own.append(_mixed(total))
        probes += [_mixed(total - best[b] + other[b]) for b in range(blocks_)]
    return np.stack(own, axis=1), np.stack(probes, axis=1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _matrix(column: pa.Array, at: np.ndarray, double: bool) -> np.ndarray:
    """The unit vectors, in double precision, of rows with vectors of one length."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = int(offsets[at[0] + 1] - offsets[at[0]])
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    found = np.lib.stride_tricks.sliding_window_view(data, size)[offsets[at]].view("<f8" if double else "<f4").astype(np.float64)
    found /= np.abs(found).max(axis=1)[:, None]  # so that squares stay finite
    return found / np.sqrt((found * found).sum(axis=1))[:, None]


def _lengths(column: pa.Array) -> np.ndarray:
    return np.diff(np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1])


def _longs(column: pa.Array) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def _vectors(df: DataFrame, key: str, vector: str, double: bool) -> DataFrame:
    """(vec_id, vec) of all rows: the vector as bytes of its floats, null where it links with nothing."""
    kind = "<f8" if double else "<f4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            out = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = None
                if i is not None and v.is_valid and len(v) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(kind) + 0.0  # no negative zeros
                out.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    wanted = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>" if double else "array<float>").alias("vec"))
    return wanted.mapInArrow(run, "vec_id long, vec binary")


def _coded(classes: DataFrame, tables: int, blocks_: int, scale: float, double: bool) -> DataFrame:
    """Add the cells' keys: own array<long>, probes array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            vec, n = batch.column(1), batch.num_rows
            own = np.zeros((n, tables), dtype=np.int64)
            probes = np.zeros((n, tables * blocks_), dtype=np.int64)
            sizes = _lengths(vec)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                own[at], probes[at] = cell_keys(_matrix(vec, at, double), tables, blocks_, scale)
            lists = [pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * x.shape[1], x.reshape(-1)) for x in (own, probes)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=["id", "vec", "mult", "own", "probes"])

    return classes.select("id", "vec", "mult").mapInArrow(run, "id long, vec binary, mult long, own array<long>, probes array<long>")


def _least_shared(own_a: np.ndarray, probes_a: np.ndarray, own_b: np.ndarray, probes_b: np.ndarray) -> np.ndarray:
    """The smallest key of a cell in which the rows' vectors meet, one of them stored; arrays (n, tables), (n, tables, blocks)."""
    most = np.int64((1 << 63) - 1)
    a = np.where((own_a == own_b) | (own_a[:, :, None] == probes_b).any(axis=2), own_a, most).min(axis=1)
    return np.minimum(a, np.where((own_b[:, :, None] == probes_a).any(axis=2), own_b, most).min(axis=1))


class _Cells:
    """Rows of whole blocks, whose vectors have one length."""

    def __init__(self, table: pa.RecordBatch, at: np.ndarray, tables: int, threshold: float, double: bool):
        column = lambda c: table.column(table.schema.get_field_index(c))
        self.key, self.i, self.j, self.side, self.id, self.mult = (column(c).to_numpy()[at] for c in ("k", "_i", "_j", "_side", "id", "mult"))
        self.units = _matrix(column("vec"), at, double)
        self.own = _longs(column("own"))[at]
        self.probes = _longs(column("probes"))[at].reshape(len(at), tables, -1)
        self.threshold = threshold
        self.counts = np.zeros(len(at), dtype=np.int64)
        self.src: list[np.ndarray] = []
        self.dst: list[np.ndarray] = []

    def counted(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those pairs of rows, alike enough, that meet in no cell with a smaller key; they count as links."""
        other = self.id[x] != self.id[y]
        x, y = x[other], y[other]
        if len(x):
            first = _least_shared(self.own[x], self.probes[x], self.own[y], self.probes[y]) == self.key[x]
            x, y = x[first], y[first]
            np.add.at(self.counts, x, self.mult[y])
            np.add.at(self.counts, y, self.mult[x])
        return x, y

    def kept(self, x: np.ndarray, y: np.ndarray) -> None:
        self.src.append(self.id[x])
        self.dst.append(self.id[y])

    def small(self, starts: np.ndarray, sizes: np.ndarray) -> None:
        """All small blocks at once, by the rows' places in their blocks."""
        for b in range(1, SMALL):
            begin = starts[sizes > b]
            for a in range(b):
                for at in range(0, len(begin), STEP // 4):
                    x, y = begin[at : at + STEP // 4] + a, begin[at : at + STEP // 4] + b
                    near = np.einsum("ij,ij->i", self.units[x], self.units[y]) >= self.threshold
                    self.kept(*self.counted(x[near], y[near]))

    def large(self, start: int, end: int) -> None:
        two = bool(self.i[start] != self.j[start])
        side = self.side[start:end]
        left = start + (np.flatnonzero(side == side[0]) if two else np.arange(end - start))
        right = start + np.flatnonzero(side != side[0]) if two else left
        step = max(1, STEP // max(1, len(right)))

        def links() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for a in range(0, len(left), step):
                x, y = np.nonzero(self.units[left[a : a + step]] @ self.units[right].T >= self.threshold)
                x, y = left[a + x], right[y]
                once = two | (x < y)
                x, y = self.counted(x[once], y[once])
                yield x - start, y - start

        tree = np.array(spanning(end - start, links()), dtype=np.int64).reshape(-1, 2) + start
        self.kept(tree[:, 0], tree[:, 1])

    def run(self) -> pa.RecordBatch:
        ends = bounds([self.key, self.i, self.j])
        starts, sizes = ends[:-1], np.diff(ends)
        few = (sizes <= SMALL) & (self.i[starts] == self.j[starts])
        self.small(starts[few], sizes[few])
        for start, size in zip(starts[~few].tolist(), sizes[~few].tolist(), strict=True):
            self.large(start, start + size)
        hit = np.flatnonzero(self.counts)
        src, dst = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (self.src, self.dst))
        nothing = lambda n: pa.nulls(n, pa.int64())
        both = lambda x, y: pa.concat_arrays([pa.array(v, pa.int64()) if isinstance(v, np.ndarray) else v for v in (x, y)])
        return pa.RecordBatch.from_arrays(
            [both(self.id[hit], src), both(self.counts[hit], nothing(len(src))), both(nothing(len(hit)), dst)], names=["a", "n", "b"]
        )


def links_of(coded: DataFrame, tables: int, threshold: float, tile: int, double: bool) -> DataFrame:
    """Rows (a, n, null): links counted for class a; and (a, null, b): links, of large blocks those of a spanning forest."""
    keys = coded.select("id", F.explode(F.concat(
        F.transform("own", lambda x: F.struct(x.alias("k"), F.lit(1).alias("stored"))), F.transform("probes", lambda x: F.struct(x.alias("k"), F.lit(0).alias("stored")))
    )).alias("c")).select("id", "c.k", "c.stored")
    sizes = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("stored").alias("s")).where("n > 1 AND s = 1").select("k", "n")
    met = keys.join(sizes, "k").select("id", "k", "n")
    rows = met.join(coded, "id")
    spread = _dealt(rows, tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, ["k", "_i", "_j"]):
            whole = table.combine_chunks().to_batches()[0]
            lengths = _lengths(whole.column(whole.schema.get_field_index("vec")))
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                if len(at) > 1:
                    yield _Cells(whole, at, tables, threshold, double).run()

    return spread.mapInArrow(run, "a long, n long, b long")


def _dealt(rows: DataFrame, tile: int) -> DataFrame:
    """As blocks.dealt, with the keys' sizes in a column n."""
    tiled = rows.withColumn("_k", F.ceil(F.col("n") / tile).cast("int")).withColumn("_side", F.pmod(F.xxhash64(F.lit(17), "id"), "_k").cast("int"))
    tiled = tiled.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    tiled = tiled.withColumn("_i", F.least("_side", "_o")).withColumn("_j", F.greatest("_side", "_o")).drop("_k", "_o", "n")
    return tiled.repartition("k", "_i", "_j").sortWithinPartitions("k", "_i", "_j", "_side")


def _digest() -> list[Column]:
    return [F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(29), "vec").alias("h2")]


def embedding_dedup(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, ladder: tuple = LADDER, tile: int = TILE
) -> DataFrame:
    """(key, n_links, component_id, kept) of each row."""
    double = not isinstance(df.schema[vector].dataType.elementType, FloatType)
    every = checkpointed(_vectors(df, key, vector, double))
    rows = every.where("vec IS NOT NULL").select("vec_id", "vec", *_digest())
    named = rows.groupBy("h1", "h2").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("mult"), F.min("vec_id").alias("least"))
    classes = checkpointed(named.withColumn("id", F.monotonically_increasing_id()))  # numbers of classes, fixed by the checkpoint
    _, blocks_, scale, tables = next(line for line in ladder if classes.count() <= line[0])
    found = checkpointed(links_of(checkpointed(_coded(classes, tables, blocks_, scale, double)), tables, threshold, tile, double))
    counts = found.where("n IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    # an id with several vectors ties their classes together
    several = rows.groupBy("vec_id").agg(F.min(F.struct("h1", "h2")).alias("x"), F.max(F.struct("h1", "h2")).alias("y")).where("x <> y").select("vec_id")
    tied = rows.join(several, "vec_id").select("vec_id", "h1", "h2").distinct().join(classes.select("h1", "h2", "id"), ["h1", "h2"])
    ends = tied.groupBy("vec_id").agg(F.min("id").alias("a"))
    links = found.where("b IS NOT NULL").select("a", "b").union(tied.join(ends, "vec_id").where("a <> id").select("a", F.col("id").alias("b")))
    parts = connected_components(links, "a", "b").withColumnRenamed("node", "id")
    members = classes.select("id", "least").join(parts, "id")
    heads = members.groupBy("component").agg(F.min("least").alias("head"))
    result = (
        classes.select("h1", "h2", "id", "mult", "least").join(counts, "id", "left").join(members.join(heads, "component").select("id", "head"), "id", "left")
        .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("head", "least").alias("component_id"))
    )
    good = rows.select("vec_id", "h1", "h2").join(result, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    # a row without a vector is in the component of its id, if that has vectors in other rows
    bad = every.where("vec IS NULL").select("vec_id")
    placed = good.join(bad.where("vec_id IS NOT NULL").distinct(), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("component_id").alias("component_id"))
    bad = bad.join(placed, "vec_id", "left").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return good.unionByName(bad).select(
        F.col("vec_id").alias(key), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(False)).alias("kept")
    )
