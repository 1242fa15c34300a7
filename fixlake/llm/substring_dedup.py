"""Removal of repeated byte strings by suffix arrays.

Each byte that is covered by a string of `WINDOW` bytes which also begins earlier is removed; matches never cross texts, overlaps count, and strings are judged on the input.

Equal strings have to meet in one shard of the suffix array, wherever they are. So each window of `WINDOW` bytes belongs to its anchor, the least hash of the `GRAM`-byte strings in it, which
depends on the window's bytes only. A run of windows with the same anchor is a chunk, a string that overlaps the next one. An anchor that occurs once in all texts has no repeated window. Of the others'
chunks, equal ones are one string that is owned by its first occurrence. Shards are the different strings of an anchor, put together with a separator: their suffix array is sorted by induction,
permuted common prefixes tell the classes of equal windows, and each class is owned by the first of its windows. A window of a text is removed unless it is its class's owner. An anchor with one string, in which
it occurs once, has nothing to be compared with.

Anchors with strings of over `HOT` bytes are not gathered. Their strings are compared where they are, a few at a time, by suffix arrays of up to about `LOCAL` bytes twice over: windows that repeat there
are removed spans already, which is what nearly all of a long line of few symbols or of a passage with changing neighbours is. Each window that is left goes to a shard of its own hash, with all windows
that are equal to it: one of each suffix array at most.

Equal chunks are told by their anchor, their length and a 64-bit digest, so texts could be mistaken only if two 64-bit hashes agree at once.

Defined cases: a null text is empty; texts that are shorter than a window stay; documents are ordered by id, null ids last; rows that share an id are ordered by a hash of their texts, and equal ones are
the same document and keep the same bytes; an empty table gives an empty result; other columns are kept, but for ones with the names of the new columns, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from fixlake.llm.blocks import blocks
from fixlake.llm.common import Saved, bounded
from fixlake.llm.suffix_array import common_prefixes, suffix_array

WINDOW = 100
#: Bytes of the strings whose hashes are anchors; a power of two.
GRAM = 32
#: Bytes of an anchor's different strings beyond which its windows are spread over shards.
HOT = 2_000_000
#: Windows of a hot anchor's string that are compared at once where they are.
LOCAL = 1 << 17
#: Pieces that are made at a time.
STEP = 1 << 13
#: Bytes that are hashed at a time.
SEGMENT = 1 << 16

_FACTORS = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x9FB21C651E98DF25]


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram bytes from each place."""
    h, size = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    for factor in _FACTORS[: gram.bit_length() - 1]:
        h = h[:-size] * np.uint64(factor) + h[size:]
        h ^= h >> np.uint64(29)
        size *= 2
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def _sliding(x: np.ndarray, size: int, better: np.ufunc) -> np.ndarray:
    """The least or greatest of each `size` values in a row."""
    n, done = len(x) - size + 1, 1
    while 2 * done <= size:
        x = better(x[:-done], x[done:])
        done *= 2
    return better(x[:n], x[size - done : size - done + n])


def _segments(offsets: np.ndarray, window: int, most: int = SEGMENT) -> Iterator[tuple[int, int, np.ndarray]]:
    """(begin, end, first text) of parts of the data: whole texts together, or parts of a long one that overlap by a window less one byte."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        if j > i:
            yield int(offsets[i]), int(offsets[j]), offsets[i + 1 : j]
            i = j
            continue
        for at in range(int(offsets[i]), max(int(offsets[i + 1]) - window + 1, int(offsets[i]) + 1), most):
            yield at, min(at + most + window - 1, int(offsets[i + 1])), offsets[:0]
        i += 1


def chunks(data: np.ndarray, offsets: np.ndarray, window: int, gram: int, twice: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """(place of the first window, number of windows, anchor, and with twice whether an anchor occurs more than once there) of chunks of the texts
    between the offsets; places are those in data."""
    width = window - gram + 1
    for begin, end, inner in _segments(offsets, window):
        if end - begin < window:
            continue
        h = _gram_hashes(data[begin:end], gram)
        least = _sliding(h, width, np.minimum)
        valid = np.ones(len(least), dtype=bool)
        for cut in inner.tolist():  # windows must not cross from text to text
            valid[max(0, cut - begin - window + 1) : cut - begin] = False
        new = np.ones(len(least), dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
        begins = np.flatnonzero(new | ~valid)
        sizes = np.diff(np.append(begins, len(least)))
        keep = valid[begins]
        begins, sizes = begins[keep], sizes[keep]
        out = [begins + begin, sizes, least[begins].view(np.int64)]
        if twice:
            # a hash is an anchor where it is the greatest of the least hashes of the windows around it
            around = np.concatenate((np.zeros(width - 1, dtype=np.uint64), least, np.zeros(width - 1, dtype=np.uint64)))
            places = np.flatnonzero(_sliding(around, width, np.maximum) == h)
            again = places[1:][(h[places[1:]] == h[places[:-1]]) & (np.diff(places) <= width)]
            out.append(np.searchsorted(again, begins + sizes + width - 1) > np.searchsorted(again, begins))
        yield tuple(out)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch's texts and where each begins."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    return (np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)), offsets


def _based(df: DataFrame, key: str, text: str) -> DataFrame:
    """df with __d and __t, which name a document and have its order."""
    df = df.withColumn("__d", F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)))
    several = df.groupBy("__d").count().where("count > 1").select("__d")
    if several.isEmpty():
        return df.withColumn("__t", F.lit(0).cast("long"))
    several = several.withColumn("__many", F.lit(True))
    return df.join(several, "__d", "left").withColumn("__t", F.when(F.col("__many"), F.xxhash64(F.coalesce(text, F.lit("")))).otherwise(0)).drop("__many")


def _anchor_counts(docs: DataFrame, text: str, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            found = [x[2] for x in chunks(*_bytes_of(batch.column(0)), window, gram)]
            if found:
                anchors, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(counts)], names=["a", "c"])

    return docs.select(text).mapInArrow(run, "a long, c long")


def _occurrences(docs: DataFrame, text: str, window: int, gram: int) -> DataFrame:
    """(document, place, windows, anchor, digest, whether its anchor occurs twice in it) of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            data, offsets = _bytes_of(batch.column(2))
            view = memoryview(data)
            d, t = (batch.column(i).to_numpy() for i in (0, 1))
            for begins, sizes, anchors, again in chunks(data, offsets, window, gram, twice=True):
                row = np.searchsorted(offsets, begins, side="right") - 1
                digests = np.fromiter(
                    (xxhash.xxh3_64_intdigest(view[b : b + n]) for b, n in zip(begins.tolist(), (sizes + window - 1).tolist(), strict=True)), dtype=np.uint64, count=len(begins)
                ).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (d[row], t[row], begins - offsets[row], sizes.astype(np.int64), anchors, digests, again)], names=["d", "t", "s", "n", "a", "h", "twice"]
                )

    return docs.select("__d", "__t", text).mapInArrow(run, "d long, t long, s long, n long, a long, h long, twice boolean")


def _ranks(d: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Documents by their order; rows of the same one share a rank."""
    order = np.lexsort((t, d))
    new = np.append(True, (d[order][1:] != d[order][:-1]) | (t[order][1:] != t[order][:-1]))
    ranks = np.empty(len(d), dtype=np.int64)
    ranks[order] = np.cumsum(new[: len(d)])
    return ranks


def _runs(found: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first place in it, number) of runs of places, in order, of strings that begin at begins."""
    string = np.searchsorted(begins, found, side="right") - 1
    first = np.flatnonzero(np.append(True, (np.diff(found) > 1) | (string[1:] != string[:-1]))[: len(found)])
    own = string[first]
    return own, found[first] - begins[own], np.diff(np.append(first, len(found)))


def local_runs(view: memoryview, at: np.ndarray, n: np.ndarray, owners: np.ndarray, places: np.ndarray, window: int, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(string, first window in it, number of windows, whether they are repeated) of runs of the windows of strings with n windows at `at`: repeated ones have an equal window that is earlier among those compared at once."""
    parts = -(-n // most)
    string = np.repeat(np.arange(len(n)), parts)
    skip = (np.arange(len(string)) - np.repeat(np.cumsum(parts) - parts, parts)) * most
    size = np.minimum(n[string] - skip, most)
    total, i = np.cumsum(size + window), 0
    while i < len(string):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + 2 * most, side="right")))
        own, held = string[i:j], size[i:j] + window - 1
        data = np.frombuffer(b"\0".join([bytes(view[b : b + k]) for b, k in zip((at[own] + skip[i:j]).tolist(), held.tolist(), strict=True)]) + b"\0", dtype=np.uint8)
        found = repeated_windows(data, held, owners[own], places[own] + skip[i:j], window)
        begins = np.cumsum(held + 1) - held - 1
        first = np.ones(len(data), dtype=bool)
        first[found] = False
        for back in range(window):  # the separator and what is too near to it begin no window
            first[begins + held - back] = False
        for which, again in ((np.flatnonzero(first), False), (found, True)):
            part, begin, count = _runs(which, begins)
            yield own[part], skip[i:j][part] + begin, count, np.full(len(part), again)
        i = j


def _pieces(docs: DataFrame, text: str, wanted: DataFrame, window: int, local: int = LOCAL) -> DataFrame:
    """(shard's key, document, place, end, bytes) of the wanted chunks; of hot ones each window that is not repeated nearby. Rows without bytes are spans that are."""
    lists = wanted.groupBy(F.col("d").alias("__d"), F.col("t").alias("__t")).agg(F.collect_list(F.struct("s", "n", "a", "hot")).alias("__c"))

    def made(view: memoryview, begins: np.ndarray, d: np.ndarray, t: np.ndarray, s: np.ndarray, e: np.ndarray, keys: np.ndarray | None, bare: bool = False) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(s), STEP):
            part = slice(i, i + STEP)
            texts = [None] * len(s[part]) if bare else [bytes(view[b : b + k]) for b, k in zip(begins[part].tolist(), (e[part] - s[part]).tolist(), strict=True)]
            of = keys[part] if keys is not None else np.array([xxhash.xxh3_64_intdigest(x) for x in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (d, t, s, e)] + [pa.array(of), pa.array(texts, pa.binary())], names=["d", "t", "s", "e", "k", "piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            data, offsets = _bytes_of(batch.column(2))
            view = memoryview(data)
            d, t = (batch.column(i).to_numpy() for i in (0, 1))
            listed = batch.column(3)
            ends = listed.offsets.to_numpy()
            fields = listed.values.flatten()
            row = np.repeat(np.arange(len(d)), np.diff(ends))
            s, n, a, hot = (x.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]] for x in fields)
            at, whole = offsets[row] + s, np.flatnonzero(~hot)
            yield from made(view, at[whole], d[row[whole]], t[row[whole]], s[whole], (s + n)[whole] + window - 1, a[whole])
            if len(whole) == len(s):
                continue
            row, s, n, at = (x[hot] for x in (row, s, n, at))
            for string, first, count, again in local_runs(view, at, n, _ranks(d, t)[row], s, window, local):
                if not len(string):
                    continue
                if again[0]:
                    begins = s[string] + first
                    spread = (d[row[string]] * -7046029254386353131 + begins) * -4658895280553007687  # no shard's key, only dealt to tasks
                    yield from made(view, begins, d[row[string]], t[row[string]], begins, begins + count + window - 1, spread, bare=True)
                    continue
                string, first = np.repeat(string, count), np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                begins = s[string] + first
                yield from made(view, at[string] + first, d[row[string]], t[row[string]], begins, begins + window, None)

    joined = docs.select("__d", "__t", text).join(lists, ["__d", "__t"])
    return joined.select("__d", "__t", text, "__c").mapInArrow(run, "d long, t long, s long, e long, k long, piece binary")


def repeated_windows(data: np.ndarray, sizes: np.ndarray, owners: np.ndarray, places: np.ndarray, window: int) -> np.ndarray:
    """For strings of the given sizes in a row in data, each with a separating zero byte behind it, the places in data of windows that are not the first of their class. owners are the
    strings' documents by rank, places where they begin in them."""
    string = np.repeat(np.arange(len(sizes)), sizes + 1)
    begins = np.cumsum(sizes + 1) - sizes - 1
    within = np.arange(len(data)) - begins[string]
    left = sizes[string] - within
    # symbols: 0 the end, 1 separators, then bytes
    symbols = np.append(np.where(left > 0, data.astype(np.int16) + 2, 1), 0).astype(np.int16)
    array = suffix_array(symbols, 258)[1:]
    same = common_prefixes(data, array, left)[array] >= window
    full = left[array] >= window
    array, same = array[full], same[full]
    if not len(array):
        return array
    first = np.flatnonzero(~same)
    place = places[string[array]] + within[array]
    least = np.minimum.reduceat(owners[string[array]], first)
    size = np.diff(np.append(first, len(array)))
    owned = owners[string[array]] == np.repeat(least, size)
    least = np.repeat(np.minimum.reduceat(np.where(owned, place, np.iinfo(np.int64).max), first), size)
    return np.sort(array[~owned | (place != least)])


def _shards(pieces: DataFrame, window: int) -> DataFrame:
    """(document, begin, end) of what the suffix arrays of the shards find repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, ["k"]):
            bare = table.column("piece").is_null()
            if pc.any(bare).as_py():
                yield from table.filter(bare).select(["d", "t", "s", "e"]).rename_columns(["d", "t", "b", "e"]).combine_chunks().to_batches()
                table = table.filter(pc.invert(bare))
                if not table.num_rows:
                    continue
            d, t, s = (table.column(c).to_numpy() for c in ("d", "t", "s"))
            texts = table.column("piece").to_pylist()
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            data = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
            found = repeated_windows(data, sizes, _ranks(d, t), s, window)
            if not len(found):
                continue
            own, first, count = _runs(found, np.cumsum(sizes + 1) - sizes - 1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d[own], t[own], s[own] + first, s[own] + first + count - 1 + window)], names=["d", "t", "b", "e"])

    return pieces.repartition("k").sortWithinPartitions("k").mapInArrow(run, "d long, t long, b long, e long")


def _merged(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans that overlap or touch."""
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.append(True, begins[1:] > ends[:-1])[: len(begins)]
    first = np.flatnonzero(new)
    return begins[first], ends[np.append(first[1:], len(begins)) - 1] if len(first) else ends


def repeated_spans(docs: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(d, t, b, e): spans of bytes, which may overlap, that are covered by repeated windows of the documents named by __d and __t."""
    if gram & (gram - 1) or not 1 < gram <= window:
        raise ValueError("gram has to be a power of two and no larger than the window")
    with Saved(docs.sparkSession, "substrings") as saved:
        counts = _anchor_counts(docs, text, window, gram)
        repeated = saved("anchors", counts.groupBy("a").agg(F.sum("c").alias("c")).where("c > 1").select("a", F.lit(True).alias("r")))
        found = _occurrences(docs, text, window, gram).join(repeated.hint("shuffle_hash"), "a", "left").where("r OR twice").drop("r")
        found = saved("chunks", found)
        strings = saved("strings", found.groupBy("a", "h", "n").agg(F.min(F.struct("d", "t", "s")).alias("o"), F.max("twice").alias("twice")))
        sizes = strings.groupBy("a").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("n") + window - 1).alias("size"), F.max("twice").alias("again")).where("c > 1 OR again")
        wanted = strings.join(sizes.select("a", (F.col("size") > hot).alias("hot")), "a").select("o.*", "n", "a", "hot")
        within = saved("within", _shards(_pieces(docs, text, wanted, window), window))
        copies = (
            found.join(strings.select("a", "h", "n", "o"), ["a", "h", "n"]).where(F.struct("d", "t", "s") != F.col("o"))
            .select("d", "t", F.col("s").alias("b"), (F.col("s") + F.col("n") + window - 1).alias("e"))
        )
        return saved.last("spans", copies.union(within).groupBy("d", "t").agg(F.collect_list(F.struct("b", "e")).alias("spans")))


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """The rows with `kept`, the text's bytes without the repeated ones (binary, as a cut may fall within a character), and `removed`, the maximal runs of removed bytes."""
    df = df.drop("kept", "removed")
    docs = _based(df, key, text)
    spans = repeated_spans(docs, text, window, gram, hot)
    joined = docs.join(spans.select(F.col("d").alias("__d"), F.col("t").alias("__t"), F.col("spans").alias("__s")), ["__d", "__t"], "left")
    runs = ArrayType(StructType([StructField("begin", LongType()), StructField("end", LongType())]))
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
        for batch in bounded(batches):
            data, offsets = _bytes_of(batch.column(at))
            kept, removed = [], []
            for i, listed in enumerate(batch.column(batch.num_columns - 1)):
                whole = data[offsets[i] : offsets[i + 1]]
                if not listed.is_valid:
                    kept.append(whole.tobytes())
                    removed.append([])
                    continue
                b, e = (x.to_numpy() for x in listed.values.flatten())
                b, e = _merged(b, e)
                change = np.zeros(len(whole) + 1, dtype=np.int8)
                change[b] += 1
                change[e] -= 1
                kept.append(whole[np.cumsum(change[:-1], dtype=np.int8) == 0].tobytes())
                removed.append([{"begin": x, "end": y} for x, y in zip(b.tolist(), e.tolist(), strict=True)])
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pair))], names=[*batch.schema.names[:-1], "kept", "removed"])

    schema = StructType([*df.schema.fields, StructField("kept", BinaryType()), StructField("removed", runs)])
    return joined.select(*df.columns, "__s").mapInArrow(run, schema)


def removed_bytes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    kept = remove_repeats(df.select(key, text), key, text)
    size: Column = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return kept.select(
        key, size.alias("n_bytes"), (size - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
