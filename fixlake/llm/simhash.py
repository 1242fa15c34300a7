"""SimHash near-dedup: 64-bit fingerprints of word shingles, compared exactly in tiles.

Distinct fingerprints are compared by exclusive-or and bit counts in numpy. The grid of tiles is laid over equal blocks of
bits: two fingerprints within a radius of 3 agree on one of four 16-bit bands, and on one of four 12-bit parts of the rest, so each
pair within the radius meets in a tile of one of 16 such keys and no pair is lost. Within a key, rows are ordered by
population count, and a pair of tiles whose population counts differ by more than the radius is skipped. A key with more than
`TILE` fingerprints is spread over tasks tile pair by tile pair. Each block gives a spanning forest of its links only, so a group of n
near copies gives about n rows, not n squared; components are found from those.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero and links like any other; fewer words than
a shingle's make one shingle; equal fingerprints link; a document id that is repeated stands for one node and each of its
rows is returned; a row with a null id keeps its fingerprint and links with nothing (component null); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixlake.functions.graph import checkpointed, connected_components
from fixlake.llm.blocks import blocks, bounds, dealt, spanning
from fixlake.llm.common import per_row

SHINGLE = 3
RADIUS = 3
SEED = 42
TILE = 8192
#: Rows of a tile that are compared at once.
STEP = 1024
#: Shingles hashed at a time.
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits that are set in over half of the hashes of all shingles of lower-cased words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    total, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=True)], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.flatnonzero(2 * total > len(starts)).tolist()
    return sum(1 << b for b in set_bits)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp): fp holds the 64 bits as a signed long."""
    return per_row(df, [key, text], lambda k, t: (k, _signed(fingerprint(t, shingle))), f"{key} long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(fp: str) -> F.Column:
    """The 16 block keys of a fingerprint: which band and part, and their bits."""
    every = []
    for band in range(4):
        rest = [b for b in range(4) if b != band]
        bits = lambda b: F.shiftrightunsigned(F.col(fp), 16 * b).bitwiseAND(F.lit(0xFFFF))
        joined = bits(rest[0]).bitwiseOR(F.shiftleft(bits(rest[1]), 16)).bitwiseOR(F.shiftleft(bits(rest[2]), 32))
        for part in range(4):
            value = F.shiftrightunsigned(joined, 12 * part).bitwiseAND(F.lit(0xFFF))
            every.append(F.shiftleft(bits(band), 12).bitwiseOR(value).bitwiseOR(F.lit((band * 4 + part) << 28)))
    return F.array(*every)


def tile_links(fps: np.ndarray, sides: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs within the radius; of two sides, only pairs across."""
    bits = np.bitwise_count(fps).astype(np.int64)
    two = bool(sides[0] != sides[-1])
    left = np.flatnonzero(sides == sides[0]) if two else np.arange(len(fps))
    right = np.flatnonzero(sides == sides[-1]) if two else left
    left, right = (x[np.argsort(bits[x], kind="stable")] for x in (left, right))
    for a in range(0, len(left), STEP):
        rows = left[a : a + STEP]
        for b in range(0 if two else a, len(right), STEP):
            cols = right[b : b + STEP]
            if bits[cols[0]] - bits[rows[-1]] > radius or bits[rows[0]] - bits[cols[-1]] > radius:
                continue
            near = np.bitwise_count(fps[rows][:, None] ^ fps[cols][None, :]) <= radius
            i, j = np.nonzero(near if two or a != b else np.triu(near, 1))
            yield rows[i], cols[j]


def _block_links(table: pa.Table, radius: int) -> pa.RecordBatch:
    key, i, j, side, fp = (table.column(c).to_numpy() for c in ("k", "_i", "_j", "_side", "fp"))
    node = table.column("node").to_numpy()
    ends = bounds([key, i, j])
    size, fps = np.diff(ends), fp.view(np.uint64)
    src, dst = [], []
    small = ends[:-1][(size > 1) & (size <= 16)]
    count = dict(zip(ends[:-1].tolist(), size.tolist(), strict=True))
    counts = np.array([count[s] for s in small.tolist()], dtype=np.int64)
    for a in range(16):  # all small blocks at once, by the rows' places in their blocks
        for b in range(a + 1, 16):
            at = small[counts > b]
            if len(at) == 0:
                break
            x, y = at + a, at + b
            hit = np.bitwise_count(fps[x] ^ fps[y]) <= radius
            hit &= (i[x] == j[x]) | (side[x] != side[y])
            src.append(node[x[hit]])
            dst.append(node[y[hit]])
    for start in ends[:-1][size > 16].tolist():
        part = slice(start, start + count[start])
        if i[start] != j[start] and side[part][0] == side[part][-1]:
            continue
        pairs = spanning(count[start], tile_links(fps[part], side[part], radius))
        if pairs:
            ab = np.array(pairs) + start
            src.append(node[ab[:, 0]])
            dst.append(node[ab[:, 1]])
    both = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (src, dst)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in both], names=["src", "dst"])


def near_links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(src, dst) of nodes (node, fp with distinct fingerprints): a spanning forest of each block's links within the radius (3
    at most)."""
    if radius > 3:
        raise ValueError("the blocks of bits hold for a radius of 3 at most")
    keyed = nodes.select("node", "fp", F.explode(_keys("fp")).alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, ["k", "_i", "_j"]):
            if table.num_rows > 1:
                yield _block_links(table, radius)

    return dealt(keyed, "k", "node", tile).mapInArrow(run, "src long, dst long")


def near_components(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(key, fp, component) of each row; the component is the smallest key reachable."""
    marked = checkpointed(fingerprints(df, key, text, shingle))
    nodes = checkpointed(marked.where(F.col(key).isNotNull()).groupBy("fp").agg(F.min(key).alias("node")))
    # a key with two texts ties their fingerprints together
    ties = marked.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b")
    tied = marked.join(ties.select(key), key).join(nodes, "fp").select(F.col("node").alias("src"), F.col(key).alias("dst"))
    links = near_links(nodes, radius).union(tied)
    found = connected_components(links)
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    joined = marked.join(named, "fp", "left")
    return joined.select(key, "fp", F.when(F.col(key).isNotNull(), F.col("component")).alias("component"))


def simhash_dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) of each row."""
    found = near_components(df, key, text)
    return found.select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows, with all their columns, whose key is the smallest of their component; of rows that share it one stays, and
    all with a null key stay."""
    return keep_smallest(df, near_components(df, key, text, shingle, radius), key)


def keep_smallest(df: DataFrame, marked: DataFrame, key: str) -> DataFrame:
    """The rows that `keep_first` keeps, by the components in marked (key, component)."""
    dropped = marked.where(F.col(key).isNotNull() & (F.col(key) != F.col("component"))).select(F.col(key).alias("__drop")).distinct()
    kept = df.join(dropped, df[key] == dropped["__drop"], "left_anti")
    keyed = kept.where(F.col(key).isNotNull())
    repeated = keyed.groupBy(key).count().where("count > 1").select(F.col(key).alias("__many"))
    single = keyed.join(repeated, keyed[key] == repeated["__many"], "left_anti")
    first = keyed.join(repeated, keyed[key] == repeated["__many"], "left_semi").dropDuplicates([key])
    return single.unionByName(first).unionByName(kept.where(F.col(key).isNull()))
