"""Benchmark decontamination by spaced-seed hashing.

Texts become sequences of lower-cased words (letters and digits). A few fixed masks select some of the positions in a window and ignore the others, so a
window still hashes alike when an ignored word was substituted. The hashes of all benchmark windows are joined with those of all training
windows by binary search in a sorted array; a hit fixes an alignment, along which the words are compared: a document is
contaminated if a stretch of `MIN_WORDS` words or more (of the whole item, if that is shorter) agrees in at least `SHARE` of its words.

The masks were searched so that none of these is missed at the default `MIN_WORDS` and `SHARE`: wherever a fifth of the words of a stretch of 12 to 23
words are substituted, one mask has a place between them. A longer stretch has a half that agrees as well, and so has one of those lengths in it.
Items of 5 to 11 words have masks by their length, for which the same holds over the whole item; shorter ones can't lose a word.

The benchmark is read in parts of at most `PART_BYTES` of text, which are written to the session's shared folder. A task takes a bounded group of documents and
holds it against one part after the other, of which it keeps `KEPT` at a time. Documents are never shuffled, and there is one pass over them however many parts there are.

Defined cases: a null or empty text is clean; items without words match nothing; items of fewer than five words match as whole sequences of
words; a repeated item counts under its smallest id; items with a null id are ignored; rows are independent; an empty table gives an empty result,
an empty benchmark leaves all documents clean; other columns are ignored.
"""

from __future__ import annotations

import functools
import pickle
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixlake.functions.graph import shared_folder
from fixlake.llm.common import bounded

#: 1: the word counts; 0: it is ignored.
MASKS = ("1110111", "11100001011", "110110011")
#: Those of items of fewer than `MIN_WORDS` words, by words.
SHORT_MASKS = {
    5: ("1111", "11101", "11011", "10111"), 6: ("11111", "111101", "111011", "110111", "101111"), 7: ("11111", "111011", "110111"),
    8: ("11111", "111011"), 9: ("111011",), 10: ("11111", "111011", "11010011"), 11: ("1101011", "1110011"),
}
MIN_WORDS = 12
SHARE = 0.8
PART_BYTES = 4 << 20
#: Parts that a worker keeps, and bytes of documents that are held against a part before the next one is taken.
KEPT, GROUP_BYTES = 2, 32 << 20
#: Hits that are expanded at a time.
HITS = 1 << 20
#: Words a task remembers the hashes of; a full memory is emptied.
MEMORY = 500_000
#: Words hashed at a time in a long text.
CHUNK = 1 << 17
_WORDS = re.compile(r"[^\W_]+")
_ODD = 0x9E3779B97F4A7C15
_BIT = (1 << np.arange(8)).astype(np.uint8)


class Words:
    """Hashes of words, with a bounded memory."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def hashes(self, text: str | None) -> np.ndarray:
        words = _WORDS.findall((text or "").lower())
        if len(self.known) > MEMORY:
            self.known.clear()
        known, digest = self.known, xxhash.xxh3_64_intdigest
        for word in set(words).difference(known):
            known[word] = digest(word)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window under a mask."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, xxhash.xxh3_64_intdigest(mask), dtype=np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            total = (total ^ words[i : i + n]) * np.uint64(_ODD)
            total ^= total >> np.uint64(32)
    return total


class Benchmark:
    """A bounded part of the benchmark: its words, and all windows' hashes in sorted order."""

    def __init__(self, items: list[tuple[int, str]], masks: tuple[str, ...] = MASKS, min_words: int = MIN_WORDS, share: float = SHARE):
        hasher, seen = Words(), set()
        self.min_words, self.share = min_words, share
        self.ids, self.words, keys, item_of, offset_of = [], [], [], [], []
        self.masks: set[str] = set()
        for item, text in sorted(items):
            words = hasher.hashes(text)
            if len(words) == 0 or words.tobytes() in seen:
                continue
            seen.add(words.tobytes())
            own = masks if len(words) >= MIN_WORDS else SHORT_MASKS.get(len(words), ("1" * len(words),))
            self.masks |= set(own)
            for mask in own:
                found = seeds(words, mask)
                keys.append(found)
                item_of.append(np.full(len(found), len(self.ids)))
                offset_of.append(np.arange(len(found)))
            self.ids.append(item)
            self.words.append(words)
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, dtype=kind)
        keys = join(keys, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.item_of, self.offset_of = keys[order], join(item_of, np.int64)[order], join(offset_of, np.int64)[order]
        #: One bit for each value that the low bits of a key can have, 64 to 128 a key: a quick first test.
        self.bits = max(16, int(np.ceil(np.log2(len(self.keys) + 1))) + 6)
        self.filter = np.zeros(1 << (self.bits - 3), dtype=np.uint8)
        low = self._low(self.keys)
        np.bitwise_or.at(self.filter, low >> 3, _BIT[low & 7])

    def _low(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def alignments(self, words: np.ndarray, ends: np.ndarray) -> set[tuple[int, int, int]]:
        """(text's number, item's number, where its first word would be) of each hit in texts that stand one behind the other and end at `ends`. A window that spans two
        texts can only propose an alignment, which is then checked within one."""
        found: set[tuple[int, int, int]] = set()
        for mask in sorted(self.masks):
            for at in range(0, max(1, len(words)), CHUNK):
                keys = seeds(words[at : at + CHUNK + len(mask) - 1], mask)
                low = self._low(keys)
                maybe = np.flatnonzero(self.filter[low >> 3] & _BIT[low & 7])
                if len(maybe) == 0:
                    continue
                first, last = (np.searchsorted(self.keys, keys[maybe], side=s) for s in ("left", "right"))
                real = last > first
                if not real.any():
                    continue
                first, hits, places = first[real], (last - first)[real], maybe[real] + at
                total = np.cumsum(hits)
                cuts = np.searchsorted(total, np.arange(HITS, int(total[-1]) + HITS, HITS))  # words that repeat have many hits
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(hits)], strict=True):
                    n = hits[a:b]
                    k = np.repeat(first[a:b] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    place = np.repeat(places[a:b], n)
                    pairs = np.stack([np.searchsorted(ends, place, side="right"), self.item_of[k], place - self.offset_of[k]], axis=1)
                    found.update(map(tuple, np.unique(pairs, axis=0).tolist()))
        return found

    def longest(self, words: np.ndarray, item: int, start: int) -> tuple[int, int]:
        """(words, agreeing words) of the longest stretch along an alignment that agrees in a large enough share."""
        own = self.words[item]
        a, b = max(0, -start), min(len(own), len(words) - start)
        same = own[a:b] == words[start + a : start + b]
        sums = np.concatenate(([0.0], np.cumsum(same - self.share)))
        lowest = np.minimum.accumulate(sums)  # the longest stretch with a sum of 0 at least, by two pointers
        highest = np.maximum.accumulate(sums[::-1])[::-1]
        i = j = best = at = 0
        while i < len(sums) and j < len(sums):
            if highest[j] >= lowest[i] - 1e-9:
                if j - i > best:
                    best, at = j - i, i
                j += 1
            else:
                i += 1
        return best, int(same[at : at + best].sum())

    def check(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(item id, words, agreeing words) of each item that the text overlaps, by item."""
        return self.check_all([words])[0]

    def check_all(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
        """The same of several texts, whose windows are looked up together."""
        sizes = np.array([len(w) for w in texts], dtype=np.int64)
        ends = np.cumsum(sizes)
        found: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        for text, item, start in sorted(self.alignments(np.concatenate(texts), ends) if texts else ()):
            best = found[text].get(item, (0, 0))
            if best[1] == len(self.words[item]):
                continue  # the whole item has been found
            length, same = self.longest(texts[text], item, start - int(ends[text] - sizes[text]))
            if length >= min(self.min_words, len(self.words[item])) and (length, same) > best:
                found[text][item] = (length, same)
        return [sorted((self.ids[i], n, same) for i, (n, same) in f.items()) for f in found]


def _parts(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in parts of bounded size, one at a time on the driver."""
    part, size = [], 0
    rows = benchmark.select(F.col(item).cast("long"), F.col(text)).where(F.col(item).isNotNull() & F.col(text).isNotNull())
    for i, t in rows.toLocalIterator():
        if part and size + len(t) > PART_BYTES:
            yield part
            part, size = [], 0
        part.append((i, t))
        size += len(t)
    yield part


def _written(spark: SparkSession, benchmark: DataFrame, item: str, text: str, limits: dict) -> list[str]:
    """The parts of the benchmark as files (URIs) in the session's shared folder."""
    shared = shared_folder(spark)
    files, at = pafs.FileSystem.from_uri(shared if ":" in shared else f"file://{shared}")
    folder = f"{at}/benchmark-{uuid.uuid4().hex}"
    files.create_dir(folder, recursive=True)
    out = []
    for i, part in enumerate(_parts(benchmark, item, text)):
        with files.open_output_stream(f"{folder}/{i}", compression=None) as stream:
            stream.write(pickle.dumps(Benchmark(part, **limits), protocol=5))
        out.append(f"{shared if ':' in shared else 'file://' + shared}/{folder.removeprefix(at).strip('/')}/{i}")
    return out


@functools.lru_cache(maxsize=KEPT)
def _part(uri: str) -> Benchmark:
    files, at = pafs.FileSystem.from_uri(uri)
    with files.open_input_stream(at, compression=None) as stream:
        return pickle.loads(stream.read())


def overlaps(
    df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", **limits
) -> DataFrame:
    """The rows of df with __items, the benchmark ids that a row overlaps, and __longest, the longest overlap in words."""
    parts = _written(df.sparkSession, benchmark, item, item_text, limits)
    schema = df.withColumns({"__items": F.lit(None).cast("array<bigint>"), "__longest": F.lit(0).cast("bigint")}).schema
    place = df.columns.index(text)

    def found_in(group: list[pa.RecordBatch], hasher: Words) -> Iterator[pa.RecordBatch]:
        words = [[hasher.hashes(t) for t in batch.column(place).to_pylist()] for batch in group]
        every = [[[] for _ in w] for w in words]
        for part in parts:
            held = _part(part)
            for w, found in zip(words, every, strict=True):
                for x, more in zip(found, held.check_all(w), strict=True):
                    x += more
        for batch, found in zip(group, every, strict=True):
            items, longest = [sorted({i for i, _, _ in f}) for f in found], [max((n for _, n, _ in f), default=0) for f in found]
            new = [pa.array(items, pa.list_(pa.int64())), pa.array(longest, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size, hasher = [], 0, Words()
        for batch in bounded(batches):
            group.append(batch)
            size += batch.nbytes
            if size > GROUP_BYTES or len(parts) == 1:
                yield from found_in(group, hasher)
                group, size = [], 0
        if group:
            yield from found_in(group, hasher)

    return df.mapInArrow(run, schema)


def find_contaminated(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """(key, contaminated, n_items, items, longest) of each row."""
    found = overlaps(df.select(key, text), benchmark, key, text, **limits)
    return found.select(
        key, (F.size("__items") > 0).alias("contaminated"), F.size("__items").cast("long").alias("n_items"),
        F.array_join(F.transform("__items", lambda x: x.cast("string")), ",").alias("items"), F.col("__longest").alias("longest"),
    )


def decontaminate(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """The rows that overlap no benchmark item, with all their columns."""
    found = overlaps(df, benchmark, key, text, **limits)
    return found.where(F.size("__items") == 0).select(*[F.col(f"`{c}`") for c in df.columns])

