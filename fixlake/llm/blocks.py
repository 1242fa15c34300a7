"""Deal rows that share a key into bounded blocks, and hand each block to a function.

A key with up to `tile` rows is one block. A larger one is split into k tiles by a hash of the row's id, and each pair of
tiles is a block, so that any two rows of a key meet in exactly one block, no block has many more than two tiles and no task
holds all of a hot key. A row of such a key is sent k times, which is what an exact comparison of its rows costs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiled(df: DataFrame, key: str, row_id: str, tile: int, sizes: DataFrame | None = None) -> DataFrame:
    """Add _i and _j (the block's tiles; i <= j) and _side (which of the two the row belongs to). `sizes` (key, n) gives the keys' sizes if they are known already; rows of keys that it lacks are dropped."""
    keep = sizes is not None
    sizes = (sizes if keep else df.groupBy(key).count().withColumnRenamed("count", "n")).select(
        key, F.ceil(F.col("n") / tile).cast("int").alias("_k")
    )
    if not keep:
        sizes = sizes.where("_k > 1")  # usually none
    found = df.join(sizes, key, "inner" if keep else "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    found = found.withColumn("_side", F.pmod(F.xxhash64(F.lit(17), row_id), "_k").cast("int"))
    found = found.withColumn("_o", F.explode(F.when(F.col("_k") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_k") - 1))))
    return found.withColumn("_i", F.least("_side", "_o")).withColumn("_j", F.greatest("_side", "_o")).drop("_k", "_o")


def gathered(df: DataFrame, key: str) -> DataFrame:
    """Tiled rows, repartitioned and sorted by block."""
    return df.repartition(key, "_i", "_j").sortWithinPartitions(key, "_i", "_j", "_side")


def dealt(df: DataFrame, key: str, row_id: str, tile: int) -> DataFrame:
    """The rows with _i, _j and _side, repartitioned and sorted by block."""
    return gathered(tiled(df, key, row_id, tile), key)


def blocks(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables of whole blocks: rows in a row with the same key columns always come in the same table. Each table holds many small
    blocks or one large one."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in key]
        if rest and all(rest[-1].column(rest[-1].schema.get_field_index(k))[-1].as_py() == c[0] for k, c in zip(key, cols, strict=True)):
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            if not len(change):
                rest.append(batch)
                continue
            yield pa.Table.from_batches([*rest, batch.slice(0, change[0])])
            batch, cols = batch.slice(change[0]), [c[change[0] :] for c in cols]
        elif rest:
            yield pa.Table.from_batches(rest)
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if batch.num_rows > 1 else []
        last = int(change[-1]) if len(change) else 0
        if last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        rest = [batch.slice(last)]
    if rest:
        yield pa.Table.from_batches(rest)


def bounds(cols: list[np.ndarray]) -> np.ndarray:
    """Where blocks begin, and the end."""
    n = len(cols[0])
    if n == 0:
        return np.zeros(1, dtype=np.int64)
    change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
    return np.concatenate(([0], change, [n])).astype(np.int64)


class Forest:
    """Union-find over row numbers; the smaller number is the root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def spanning(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Of links that come in arrays of row numbers, those that a spanning forest needs."""
    forest, kept = Forest(n), []
    for left, right in links:
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            if forest.join(a, b):
                kept.append((a, b))
    return kept


Work = Callable[[pa.Table], pa.Table]
