"""SimHash near-dedup by similarity: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

At that similarity 64 bits differ in about ten places, which no small radius covers and no few bands separate. Fingerprints here
have 1,024 bits of the distinct shingles, compared exactly in tiles by exclusive-or and bit counts as in `simhash`; a pair of tiles
whose population counts differ by more than the radius is skipped. Two sets of Jaccard similarity s differ in about
acos(2 s / (1 + s)) / pi of the bits: 155 of 1,024 at 0.8, with a standard deviation of 11.5. Fingerprints only propose pairs; a pair
is linked if the Jaccard similarity of its two sets of 64-bit shingle hashes is 0.8 or more. Pairs are proposed in two rounds: first a
spanning forest of each block's pairs within `RADIUS`, which are verified by their texts, then all pairs of a block within the wide radius (five standard
deviations above what any sizes of two sets at 0.8 are expected to differ in) that the links so far leave in different components. The rows of such blocks bring their sets along, so these pairs are
verified where they are proposed: a pair that is not alike makes no row, and one whose components other links of the block have joined is not looked at.
A row none of whose keys another one has is in no pair: fingerprints and texts are sent on of the other rows only, and their texts are gathered once for both rounds.

The tiles of the grid are laid over `KEYS` keys, each a hash of three of the set's 16 least permuted hashes. Two sets share a key with
probability s cubed, so at 0.8 about one pair in a hundred shares none. A passage that is a share f of a text makes a key hot for a share f cubed
only. Within a block, a few pivot rows are compared with all others first; tiles whose rows are all joined to one pivot already need
no comparison, so a block of copies costs its size and not its square. A key with more than `TILE` fingerprints is spread over
tasks tile pair by tile pair.

Defined cases: texts are lower-cased (A-Z) and split at ASCII white space; fewer words than a shingle's are one shingle; null and
empty texts and those of white space only have the empty set and are alike; equal sets link; a document id that is repeated
stands for one node; a row with a null id links with nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixlake.functions.graph import checkpointed, connected_components
from fixlake.llm.blocks import Forest, blocks, bounds, dealt, gathered, spanning, tiled
from fixlake.llm.common import Saved, bounded, per_row
from fixlake.llm.simhash import keep_smallest

SHINGLE = 5
#: 64-bit words of a fingerprint.
WORDS = 16
RADIUS = 166
#: The wide radius, for sets of fewer than `FEW` shingles and for others.
FEW, WIDE_FEW, WIDE = 5, 256, 226
#: The least Jaccard similarity of a link, as a fraction of whole numbers.
SIMILAR = (4, 5)
KEYS = 8
TILE = 32768
#: Rows of a tile that bring their sets of hashes along, and sets that are taken apart at once.
SET_TILE, HELD = 4096, 1024
#: Rows of a tile that are compared at once.
STEP = 512
#: Rows that are compared with a whole block before its tiles are.
PIVOTS = 8
#: Shingles whose bits are counted at a time: votes of 255 rows fit in a byte.
CHUNK = 16 * 255

_GOLDEN = 0x9E3779B97F4A7C15
_SALTS = np.array([(i + 1) * _GOLDEN & (2**64 - 1) for i in range(WORDS)], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, in order."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(shingle, len(words))
    found = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        found = _mix(found * np.uint64(_GOLDEN) + each[k : len(words) - size + 1 + k])
    return np.unique(found)


def wide_fingerprint(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint of WORDS 64-bit words, the least of each word's hashes)."""
    votes, least = np.zeros(64 * WORDS, dtype=np.int64), np.full(WORDS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), CHUNK):
        x = _mix(hashes[at : at + CHUNK, None] ^ _SALTS)
        least = np.minimum(least, x.min(axis=0))
        for row in range(0, len(x), 255):
            bits = np.unpackbits(x[row : row + 255].view(np.uint8), axis=1, bitorder="little")
            votes += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8").astype(np.uint64), least


def block_keys(least: np.ndarray) -> list[int]:
    """KEYS hashes, each of three of the least hashes."""
    at = 2 * np.arange(KEYS)
    a, b, c = least[at % WORDS], least[(at + 5) % WORDS], least[(at + 11) % WORDS]
    return _mix(a ^ _mix(b ^ _mix(c + at.astype(np.uint64)))).view(np.int64).tolist()


def describe(text: str | None) -> tuple[bytes, bytes, list[int], int]:
    """(digest of the set of shingles, fingerprint, block keys, shingles)."""
    hashes = shingle_hashes(text)
    fp, least = wide_fingerprint(hashes)
    return xxhash.xxh3_128_digest(hashes.tobytes()), fp.astype("<u8").tobytes(), block_keys(least), len(hashes)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of distinct hashes are alike enough."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(x) + len(y) - both)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints row by row."""
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def _near(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and y within the radius. Half of the words rule most pairs out, the rest are compared in full."""
    half = WORDS // 2
    differ = np.zeros((len(x), len(y)), dtype=np.uint16)
    for w in range(half):
        differ += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
    i, j = np.nonzero(differ <= radius)
    for at in range(half, WORDS, 4):
        if not len(i):
            break
        more = differ[i, j] + np.bitwise_count(x[i, at : at + 4] ^ y[j, at : at + 4]).sum(axis=1, dtype=np.uint16)
        differ[i, j] = more
        i, j = i[more <= radius], j[more <= radius]
    return i, j


def block_pairs(fps: np.ndarray, sides: np.ndarray, radius: int, step: int = STEP, pivots: int = PIVOTS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of pairs within the radius whose components are those of all such pairs (of two sides, all pairs across)."""
    joined = np.full(len(fps), -1)
    for _ in range(pivots):
        free = np.flatnonzero(joined < 0)
        if not len(free):
            break
        pivot = free[0]
        near = free[distances(fps[free], fps[pivot]) <= radius]
        joined[near] = pivot
        yield np.full(len(near) - 1, pivot), near[near != pivot]
    bits = np.bitwise_count(fps).sum(axis=1, dtype=np.int64)
    two = bool(sides.min() != sides.max())
    order = lambda rows: rows[np.lexsort((bits[rows], joined[rows]))]
    left = order(np.flatnonzero(sides == sides.min()))
    right = order(np.flatnonzero(sides == sides.max())) if two else left
    for a in range(0, len(left), step):
        rows = left[a : a + step]
        for b in range(0 if two else a, len(right), step):
            cols = right[b : b + step]
            one = joined[rows[0]]
            if one >= 0 and (joined[rows] == one).all() and (joined[cols] == one).all():
                continue
            if bits[cols].min() - bits[rows].max() > radius or bits[rows].min() - bits[cols].max() > radius:
                continue
            i, j = _near(fps[rows], fps[cols], radius)
            i, j = rows[i], cols[j]
            new = (i != j) & ((joined[i] != joined[j]) | (joined[i] < 0))
            yield i[new], j[new]


def _links(table: pa.Table, radius: int) -> pa.RecordBatch:
    key, i, j, side, node = (table.column(c).to_numpy() for c in ("k", "_i", "_j", "_side", "node"))
    fps = np.frombuffer(b"".join(table.column("fp").to_pylist()), dtype="<u8").astype(np.uint64, copy=False).reshape(-1, WORDS)
    ends = bounds([key, i, j])
    src, dst = [], []
    starts, sizes = ends[:-1], np.diff(ends)
    pairs = starts[sizes == 2]  # most blocks, all at once
    near = distances(fps[pairs], fps[pairs + 1]) <= radius
    src.append(node[pairs[near]])
    dst.append(node[pairs[near] + 1])
    for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        part = slice(start, start + size)
        tree = spanning(size, block_pairs(fps[part], side[part], radius))
        if tree:
            ab = np.array(tree) + start
            src.append(node[ab[:, 0]])
            dst.append(node[ab[:, 1]])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (src, dst)], names=["src", "dst"])


def near_links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(src, dst) of nodes (node, fp, keys): a spanning forest of each block's links within the radius."""
    keyed = nodes.select("node", "fp", F.explode(F.array_distinct("keys")).alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, ["k", "_i", "_j"]):
            if table.num_rows > 1:
                yield _links(table, radius)

    return dealt(keyed, "k", "node", tile).mapInArrow(run, "src long, dst long")


def cross_pairs(fps: np.ndarray, sides: np.ndarray, sizes: np.ndarray, groups: np.ndarray, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs of different groups within the wide radius whose sizes allow the similarity (of two sides, across)."""
    two = bool(sides.min() != sides.max())
    order = lambda rows: rows[np.lexsort((groups[rows], sizes[rows]))]
    left = order(np.flatnonzero(sides == sides.min()))
    right = order(np.flatnonzero(sides == sides.max())) if two else left
    num, den = SIMILAR
    for a in range(0, len(left), step):
        rows = left[a : a + step]
        for b in range(0 if two else a, len(right), step):
            cols = right[b : b + step]
            if den * sizes[rows[-1]] < num * sizes[cols[0]] or den * sizes[cols[-1]] < num * sizes[rows[0]]:
                continue
            if groups[rows].min() == groups[cols].max() and groups[rows].max() == groups[cols].min():
                continue
            i, j = _near(fps[rows], fps[cols], WIDE_FEW if min(sizes[rows[0]], sizes[cols[0]]) < FEW else WIDE)
            i, j = rows[i], cols[j]
            less, more = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
            new = (groups[i] != groups[j]) & (den * less >= num * more)
            new &= (less < FEW) | (distances(fps[i], fps[j]) <= WIDE)
            if not two and a == b:
                new &= i < j
            yield i[new], j[new]


def hash_sets(texts: DataFrame) -> DataFrame:
    """(node, set): the distinct shingle hashes of each text (node, text), in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            sets = [shingle_hashes(t).astype("<u8").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    return texts.select("node", "text").mapInArrow(run, "node long, set binary")


def block_links(fps: np.ndarray, sides: np.ndarray, sizes: np.ndarray, groups: np.ndarray, sets: list) -> Iterator[tuple[int, int]]:
    """Row numbers of links between different groups of a block: of the pairs that fingerprints propose, those whose sets are alike enough, unless other links join their groups already."""
    forest, number = Forest(len(fps)), {}
    group = [number.setdefault(g, i) for i, g in enumerate(groups.tolist())]
    own: dict[int, np.ndarray] = {}

    def hashes(row: int) -> np.ndarray:
        if row not in own:
            if len(own) >= HELD:
                own.pop(next(iter(own)))
            own[row] = np.frombuffer(sets[row].as_buffer(), dtype="<u8")
        return own[row]

    for left, right in cross_pairs(fps, sides, sizes, groups):
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            if forest.find(group[a]) != forest.find(group[b]) and similar(hashes(a), hashes(b)):
                forest.join(group[a], group[b])
                yield a, b


def wide_links(nodes: DataFrame, texts: DataFrame, tile: int = SET_TILE) -> DataFrame:
    """(src, dst) of nodes (node, fp, keys, size, group) with texts (node, text): links that join the groups of each block which any of its pairs joins. Rows of blocks with several groups bring their sets along, so that
    pairs are verified where they are found and those that are not alike make no rows."""
    keyed = nodes.select("node", "group", F.explode(F.array_distinct("keys")).alias("k"))
    mixed = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("group").alias("a"), F.max("group").alias("b")).where("a < b").select("k", "n")
    mixed = checkpointed(mixed)
    rows = checkpointed(keyed.join(mixed.select("k"), "k", "left_semi").select("node", "k").distinct())
    wanted = rows.select("node").distinct()
    # a node's id can have several texts, any of which may link: they are the same node in any case
    sets = hash_sets(texts.join(wanted, "node", "left_semi").distinct())
    rows = tiled(rows, "k", "node", tile, mixed)  # before the sets come, which are sent on once
    rows = rows.join(nodes.select("node", "fp", "size", "group").join(sets, "node"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, ["k", "_i", "_j"]):
            key, i, j, side, node, size, group = (table.column(c).to_numpy() for c in ("k", "_i", "_j", "_side", "node", "size", "group"))
            ends = bounds([key, i, j])
            fps, sets = np.frombuffer(b"".join(table.column("fp").to_pylist()), dtype="<u8").astype(np.uint64, copy=False).reshape(-1, WORDS), table.column("set")
            for start, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                part = slice(start, end)
                if group[part].min() == group[part].max():
                    continue
                found = list(block_links(fps[part], side[part], size[part], group[part], sets.slice(start, end - start)))
                if found:
                    ab = np.array(found) + start
                    yield pa.RecordBatch.from_arrays([pa.array(node[ab[:, 0]]), pa.array(node[ab[:, 1]])], names=["src", "dst"])

    return gathered(rows, "k").mapInArrow(run, "src long, dst long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The distinct pairs (src, dst) that have texts (node, text) whose sets of shingles are alike enough."""
    pairs = checkpointed(pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src < dst").distinct())
    wanted = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
    texts = texts.join(wanted, "node", "left_semi").distinct()
    first, second = (texts.select(F.col("node").alias(c), F.col("text").alias(t)) for c, t in (("src", "a"), ("dst", "b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}  # of the texts seen last, as pairs come in the order of one end

        def hashes(text: str | None) -> np.ndarray:
            text = text or ""
            if text not in kept:
                if len(kept) >= 64:
                    kept.pop(next(iter(kept)))
                kept[text] = shingle_hashes(text)
            return kept[text]

        for batch in batches:
            good = [similar(hashes(a), hashes(b)) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            yield batch.select(["src", "dst"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(first, "src").join(second, "dst").select("src", "dst", "a", "b")
    return checkpointed(joined.mapInArrow(run, "src long, dst long"))


def meeting(nodes: DataFrame) -> DataFrame:
    """The nodes (node, keys, ...) that share a key with another one."""
    keyed = nodes.select("node", F.explode(F.array_distinct("keys")).alias("k"))
    shared = keyed.groupBy("k").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("k")
    return checkpointed(nodes.join(keyed.join(shared, "k", "left_semi").select("node").distinct(), "node", "left_semi"))


def near_components(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(key, component) of each row; the component is the smallest key reachable, null for a null key."""
    marked = checkpointed(per_row(df, [key, text], lambda k, t: (k, *describe(t)), f"{key} long, same binary, fp binary, keys array<long>, size long"))
    named = marked.where(F.col(key).isNotNull())
    # equal sets have equal fingerprints, keys and sizes
    nodes = named.groupBy("same").agg(F.min(key).alias("node"), *[F.first(c).alias(c) for c in ("fp", "keys", "size")])
    nodes = checkpointed(nodes)
    met = meeting(nodes)
    # copies never become edges, they are attached by their sets in the end; a key with several texts ties their sets together
    several = named.groupBy(key).agg(F.min("same").alias("x"), F.max("same").alias("y")).where("x <> y").select(key)
    tied = named.join(several, key).select(key, "same").distinct().join(nodes.select("same", "node"), "same").select(F.col(key).alias("src"), F.col("node").alias("dst"))
    with Saved(df.sparkSession, "near-copies") as saved:
        # a node's id can have several texts; its sets are tied together in any case, so any of them may link
        texts = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("node"), F.col(text).alias("text"))
        texts = saved("texts", texts.join(met.select("node").distinct(), "node", "left_semi").distinct())
        links = checkpointed(verified(near_links(met, radius), texts).union(tied))
        found = connected_components(links)
        grouped = met.join(found, "node", "left").select("node", "fp", "keys", "size", F.coalesce("component", "node").alias("group"))
        more = checkpointed(wide_links(grouped, texts))
    if not more.isEmpty():
        found = connected_components(links.union(more))
    placed = nodes.select("same", "node").join(found, "node", "left").select("same", F.coalesce("component", "node").alias("component"))
    joined = marked.select(key, "same").join(placed, "same", "left")
    return joined.select(key, F.when(F.col(key).isNotNull(), F.col("component")).alias("component"))


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows, with all their columns, whose key is the smallest of their component; of rows that share it one stays, and
    all with a null key stay."""
    return keep_smallest(df, near_components(df, key, text, radius), key)
