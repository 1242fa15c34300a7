"""Groups of spelling variants by PartEnum signatures.

Words that differ by one inserted, deleted or replaced letter have multisets of letters that differ in one or two places, if a multiset is taken as a binary vector with a place for the first, second, ...
occurrence of each letter. So places are dealt by a hash to `PARTS` parts, of which two words can differ in two at most: they agree on one at least of the sets of PARTS - 2
parts. Each word's signatures are its contents of each such set, which is partition and enumeration in one level. As an edit leaves the first or the last letters of a word of `LEAST` letters or more alone, each signature is
taken once with the first and once with the last (LEAST - 1) / 2 letters, which keeps chance meetings few.

Words that share a signature meet in bounded blocks and are compared letter by letter; what differs in a near pair tells the first signature that it shares, and only there it counts, so each
pair is found once. Blocks give near pairs only.

A word's form is the near word that is most frequent by far, its root the last of the forms of forms. Each has at least RATIO times the occurrences of the one before, so chains have few links and
are followed by joins of doubling reach.

Defined cases: a null text has no words; a null id is the empty text before the colon; rows that share an id are counted each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixlake.llm.blocks import blocks, dealt
from fixlake.llm.common import Saved, bounded

#: Code points that a word has at least, and its occurrences.
LEAST, OCCURRENCES = 7, 2
#: Times the occurrences of a word that its form has at least.
RATIO = 10
#: One run in so many loses a code point.
DELETED = 31
PARTS = 5
#: Words of a block, and of one that is compared together with others.
TILE = 4096
SMALL = 24
#: Bytes of a text that are split at once, and entries of a task's counts.
PIECE = 1 << 22
ENTRIES = 400_000

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_END = re.compile(rb"[\x00-`{-\x7f]")
#: Bytes of runs stay, others become spaces; texts with bytes that runs can have only in other characters are searched by _RUN.
_LETTERS = bytes(range(97, 123)) + bytes(range(0x80, 0xC0)) + b"\xc3"
_SPACES = bytes(c if c in _LETTERS else 32 for c in range(256))
_ASCII = bytes(range(128))
_LATIN = bytes([*range(128), *range(0x80, 0xC0), 0xC3])


def _runs(text: bytes) -> list[bytes]:
    """Runs of letters of a text whose A-Z are in lower case."""
    if not text.translate(None, _ASCII):
        return text.translate(_SPACES).split()
    if text.translate(None, _LATIN):
        return _RUN.findall(text)
    return text.translate(_SPACES).split()  # each byte from 0x80 on belongs to a letter


def _parts_of(text: bytes) -> Iterator[bytes]:
    """The text in parts that no run crosses, unless it is longer than PIECE."""
    at = 0
    while len(text) - at > PIECE:
        end = _END.search(text, at + PIECE)
        if not end:
            break
        yield text[at : end.start()]
        at = end.start()
    yield text[at:] if at else text


def _noted(word: bytes, h: int, least: int) -> str | None:
    """The run without its code point h % length where DELETED divides h; None if fewer than `least` code points are left."""
    run = word.decode()
    if h % DELETED == 0:
        at = h % len(run)
        run = run[:at] + run[at + 1 :]
    return run if len(run) >= least else None


def words(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of the words of all texts that occur often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()  # runs that lose nothing
        others: Counter[str] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            for word, n in counts.items():
                if (whole := word.decode()) and len(whole) >= least:
                    others[whole] += n
            items = list(others.items())
            for i in range(0, len(items), 1 << 14):
                part = items[i : i + (1 << 14)]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["word", "n"])
            counts.clear()
            others.clear()

        held = 0
        for batch in bounded(batches):
            for doc, whole in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                if not whole:
                    continue
                seed = zlib.crc32(b"%s:" % str("" if doc is None else doc).encode())
                for part in _parts_of(whole.lower()):
                    for word, n in Counter([w for w in _runs(part) if len(w) >= least]).items():
                        h = zlib.crc32(word, seed)
                        if h % DELETED:
                            counts[word] += n
                        elif noted := _noted(word, h, least):
                            others[noted] += n
                    held += len(part)
                if len(counts) + len(others) > ENTRIES or held > 64 * PIECE:
                    yield from flush()
                    held = 0
        yield from flush()

    found = df.select(key, text).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(letter: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """A hash of a multiset's place: the occurrence, from 1 on, of a letter."""
    return _mix((letter.astype(np.uint64) << np.uint64(32)) + occurrence.astype(np.uint64))


def _subsets(parts: int) -> list[tuple[int, ...]]:
    return list(itertools.combinations(range(parts), parts - 2))


def signatures(letters: np.ndarray, parts: int, side: int) -> np.ndarray:
    """Signatures of words of one length, given as rows of code points: for each subset of parts with the first `side` letters, then with the last."""
    rows, length = letters.shape
    ordered = np.sort(letters, axis=1)
    at = np.broadcast_to(np.arange(length), ordered.shape)
    first = np.zeros_like(at)
    first[:, 1:] = np.where(ordered[:, 1:] != ordered[:, :-1], at[:, 1:], 0)
    place = _places(ordered, at - np.maximum.accumulate(first, axis=1) + 1)
    part = (place >> np.uint64(40)) % np.uint64(parts)
    contents = [np.where(part == p, place, 0).sum(axis=1, dtype=np.uint64) for p in range(parts)]
    ends = []
    for end, cut in enumerate((letters[:, :side], letters[:, length - side :])):
        total = np.full(rows, end + 1, dtype=np.uint64)
        for k in range(side):
            total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + cut[:, k].astype(np.uint64))
        ends.append(total)
    found = np.empty((rows, 2 * len(_subsets(parts))), dtype=np.uint64)
    for q, subset in enumerate(_subsets(parts)):
        total = np.full(rows, q, dtype=np.uint64)
        for p in subset:
            total = _mix(total + contents[p])
        for end in (0, 1):
            found[:, q + end * len(_subsets(parts))] = _mix(total ^ ends[end])
    return found.view(np.int64)


def _code_points(listed: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and the words' lengths."""
    points = np.frombuffer("".join(listed).encode("utf-32-le"), dtype=np.uint32)
    return points, np.fromiter(map(len, listed), dtype=np.int64, count=len(listed))


def _signed(vocabulary: DataFrame, parts: int, side: int) -> DataFrame:
    """(signature k, its number q, word, n) of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1 << 18):
            points, lengths = _code_points(batch.column(0).to_pylist())
            begins = np.cumsum(lengths) - lengths
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                found = signatures(points[begins[rows][:, None] + np.arange(length)], parts, side)
                many = found.shape[1]
                own = batch.take(pa.array(np.repeat(rows, many)))
                numbers = np.tile(np.arange(many, dtype=np.int32), len(rows))
                yield pa.RecordBatch.from_arrays([pa.array(found.reshape(-1)), pa.array(numbers), own.column(0), own.column(1)], names=["k", "q", "word", "n"])

    return vocabulary.select("word", "n").mapInArrow(run, "k long, q int, word string, n long")


def _alike(points: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray, step: int) -> np.ndarray:
    """How many code points of points from x and from y on, up to size, are equal; step -1 goes back."""
    equal = np.zeros(len(x), dtype=np.int64)
    go, at = np.flatnonzero(size > 0), 0
    while len(go):
        go = go[points[x[go] + step * at] == points[y[go] + step * at]]
        at += 1
        equal[go] = at
        go = go[size[go] > at]
    return equal


def _count(points: np.ndarray, begins: np.ndarray, lengths: np.ndarray, letter: np.ndarray) -> np.ndarray:
    total = np.zeros(len(begins), dtype=np.int64)
    for at in range(int(lengths.max(initial=0))):
        go = np.flatnonzero(lengths > at)
        total[go] += points[begins[go] + at] == letter[go]
    return total


def near_in(points: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray, q: np.ndarray, parts: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (a, b) of words that share the signature of number q, those that are near and share none of a smaller number."""
    begins = np.cumsum(lengths) - lengths
    longer = lengths[a] >= lengths[b]
    a, b = np.where(longer, a, b), np.where(longer, b, a)
    keep = lengths[a] - lengths[b] <= 1
    a, b, q = a[keep], b[keep], q[keep]
    same = _alike(points, begins[a], begins[b], lengths[b], 1)
    replaced = lengths[a] == lengths[b]
    rest = lengths[b] - same - replaced
    keep = rest >= 0  # else the words are equal
    a, b, q, same, replaced, rest = (v[keep] for v in (a, b, q, same, replaced, rest))
    keep = _alike(points, begins[a] + lengths[a] - 1, begins[b] + lengths[b] - 1, rest, -1) == rest
    a, b, q, same, replaced = (v[keep] for v in (a, b, q, same, replaced))
    if not len(a):
        return a, b
    # the parts that hold the places in which the multisets differ
    x = points[begins[a] + same]
    differ = np.left_shift(1, ((_places(x, _count(points, begins[a], lengths[a], x)) >> np.uint64(40)) % np.uint64(parts)).astype(np.int64))
    y = points[begins[b] + np.minimum(same, lengths[b] - 1)]
    other = np.left_shift(1, ((_places(y, _count(points, begins[b], lengths[b], y)) >> np.uint64(40)) % np.uint64(parts)).astype(np.int64))
    differ |= np.where(replaced, other, 0)
    subsets = _subsets(parts)
    masks = [sum(1 << p for p in s) for s in subsets]
    first = np.array([next((i for i, m in enumerate(masks) if not m & d), 0) for d in range(1 << parts)])
    own = q == first[differ] + np.where(same >= side, 0, len(subsets))
    return a[own], b[own]


def bigrams(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A bit for each two letters in a row of each word. An edit takes two such pairs away at most and adds two, so near words differ in four bits or fewer."""
    if not len(points):
        return np.zeros(len(lengths), dtype=np.uint64)
    pair = points.astype(np.uint64)
    pair[:-1] = pair[:-1] * np.uint64(0x9E3779B97F4A7C15) + pair[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    bits = np.left_shift(np.uint64(1), pair >> np.uint64(58))
    ends = np.cumsum(lengths)
    bits[ends - 1] = 0  # a word's last letter has none behind it
    return np.bitwise_or.reduceat(bits, ends - lengths)


def _candidates(marks: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b), a first, of rows of one block whose bigrams allow that they are near. ends: for each row where its block ends. Small blocks are taken all at once, a distance after the
    other; a larger one by itself, some of its rows against all behind them."""
    rows = np.arange(len(marks))
    first = np.flatnonzero(np.append(True, ends[1:] != ends[:-1]))
    sizes = ends[first] - first
    small = rows[np.repeat(sizes <= SMALL, sizes)]
    for off in range(1, SMALL):
        small = small[small + off < ends[small]]
        if not len(small):
            break
        a = small[np.bitwise_count(marks[small] ^ marks[small + off]) <= 4]
        yield a, a + off
    for start, size in zip(first[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        own = marks[start : start + size]
        for at in range(0, size, 256):
            i, j = np.nonzero(np.bitwise_count(own[at : at + 256, None] ^ own[None, at:]) <= 4)
            later = j > i
            yield i[later] + start + at, j[later] + start + at


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs in fewer arrays."""
    held, n = [], 0
    for a, b in pairs:
        held.append((a, b))
        n += len(a)
        if n > most:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _pairs(signed: DataFrame, parts: int, side: int, tile: int, tiled: bool) -> DataFrame:
    """(word, near, n) of near words, n the near one's, both ways. tiled: whether some signature has more than `tile` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, keys):
            if table.num_rows < 2:
                continue
            cols = [table.column(c).to_numpy() for c in keys]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            ends = np.repeat(np.append(change, len(cols[0])), np.diff(np.concatenate(([0], change, [len(cols[0])]))))
            q = table.column("q").to_numpy()
            half = table.column("_side").to_numpy() if tiled else None
            points, lengths = _code_points(listed := table.column("word").to_pylist())
            found = []
            for a, b in _gathered(_candidates(bigrams(points, lengths), ends)):
                if half is not None:
                    keep = (cols[1][a] == cols[2][a]) | (half[a] != half[b])
                    a, b = a[keep], b[keep]
                found.append(near_in(points, lengths, a, b, q[a], parts, side))
            a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            if len(a):
                n = table.column("n").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([listed[i] for x in (a, b) for i in x.tolist()]), pa.array([listed[i] for x in (b, a) for i in x.tolist()]), pa.array(np.concatenate((n[b], n[a])))], names=["word", "near", "n"]
                )

    keys = ["k", "_i", "_j"] if tiled else ["k"]
    placed = dealt(signed, "k", "word", tile) if tiled else signed.repartition("k").sortWithinPartitions("k")
    return placed.mapInArrow(run, "word string, near string, n long")


def spelling_forms(vocabulary: DataFrame, least: int = LEAST, ratio: int = RATIO, parts: int = PARTS, tile: int = TILE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n) of at least `least` code points."""
    if parts < 3 or least < 3 or ratio <= 1:
        raise ValueError("three parts and three code points at least, and a ratio over 1")
    side = (least - 1) // 2
    with Saved(vocabulary.sparkSession, "spelling") as saved:
        known = saved.last("words", vocabulary.select("word", "n"))
        signed = _signed(known, parts, side)
        large = saved("large", signed.groupBy("k").count().where(F.col("count") > tile).select("k"))
        pairs = _pairs(signed, parts, side, tile, not large.isEmpty())
        near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "near")).alias("best"))
        noted = known.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best.near", (-F.col("best.n")).alias("near_n"))
        good = F.col("near_n") >= ratio * F.col("n")
        noted = saved.last("near", noted.select("word", "n", "n_near", F.when(good, F.col("near")).alias("form"), F.when(good, F.col("near_n")).alias("form_n")))
        most = known.agg(F.max("n")).first()[0] or 1
        steps = noted.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
        for i in range(math.ceil(math.log2(math.log(most, ratio) + 1))):  # after i joins a root is up to 2 ** i forms away
            further = steps.select(F.col("word").alias("root"), F.col("root").alias("__far"))
            steps = saved.last(f"roots{i}", steps.join(further, "root", "left").select("word", F.coalesce("__far", "root").alias("root")))
        return noted.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The forms and roots of the words of all texts."""
    return spelling_forms(words(df, key, text))
