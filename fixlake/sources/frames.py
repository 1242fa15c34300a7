"""Framing: messages out of bytes.

A message begins at the marker `8=FIX`; its second field, BodyLength, says where its CheckSum field has to stand, and it ends behind that. A valid message is
skipped as a whole; after an error the search goes on behind the marker, so one damaged message costs only itself. Checksums are not required to be right.

`scan` reads byte ranges of files in tasks: a range owns the messages that begin in it, a gzip file is one range. Blocks are framed by array operations over their
separators, without a Python object for each message; only what these do not find in order is looked at by itself. A message that is not whole within `LOOK_AHEAD` bytes is
an error, so that a damaged BodyLength never makes a task hold more. `native_frames` does the same for records that are rows already, with Column expressions only.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixlake.functions.values import u32

MARKER = b"8=FIX"
#: Bytes of a range, and of a read.
RANGE = 64 << 20
READ = 4 << 20
#: Bytes that are held for a message that has not ended.
LOOK_AHEAD = 8 << 20
FRAMES = "source_idx int, source string, range_start long, seq long, offset long, raw binary, code string"
#: Codes of damaged messages.
CODES = ("UnexpectedEof", "InvalidTag", "InvalidBodyLength", "InvalidBeginString")


# Digits of an unsigned 32-bit integer
_TAG = (
    "0*(?:[0-9]{1,9}|[1-3][0-9]{9}|4[01][0-9]{8}|42[0-8][0-9]{7}|429[0-3][0-9]{6}|4294[0-8][0-9]{5}|42949[0-5][0-9]{4}|429496[0-6][0-9]{3}"
    "|4294967[01][0-9]{2}|42949672[0-8][0-9]|429496729[0-5])"
)


@dataclass
class Block:
    """What a piece of a source holds: where valid messages begin and end in `data`, which stands at `base` in the source, and (offset, code) of damaged ones."""

    data: bytes
    base: int
    starts: np.ndarray
    ends: np.ndarray
    errors: list[tuple[int, str]] = field(default_factory=list)

    def raw(self) -> pa.BinaryArray:
        return gathered(np.frombuffer(self.data, dtype=np.uint8), self.starts, self.ends - self.starts)


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, valid: np.ndarray | None = None) -> pa.BinaryArray:
    """Slices of bytes as a binary array; nulls where not valid."""
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    places = np.repeat(starts - offsets[:-1], sizes) + np.arange(int(offsets[-1]))
    mask = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    buffers = [mask, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data[places].tobytes())]
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), buffers)


def _numbers(data: np.ndarray, at: np.ndarray, end: int, most: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Decimal numbers of up to `most` digits that stand at these places before the byte `end`, and how many digits they have: 0 where there is no such number."""
    number, size, left = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64), np.arange(len(at))
    value = np.zeros(len(at), dtype=np.int64)
    for k in range(most + 1):
        c = data.take(at[left] + k, mode="clip")
        if k:
            done = c == end
            number[left[done]], size[left[done]] = value[done], k
        digit = (c - np.uint8(48)) < 10
        left, value = left[digit], value[digit] * 10 + (c[digit] - np.uint8(48))
        if not len(left):
            break
    return number, size


class Framer:
    """Takes messages from blocks of bytes."""

    def __init__(self, separator: str, look_ahead: int = LOOK_AHEAD):
        self.sep, self.look_ahead = separator.encode(), look_ahead
        s = re.escape(self.sep)
        self.fields = re.compile(rb"(?:[0-9]{1,9}=[^" + s + rb"]*" + s + rb")+")
        self.field = re.compile(rb"([0-9]+)=[^" + s + rb"]*" + s)

    def _field(self, data: bytes, at: int) -> tuple[int, int, int] | str:
        """(tag, where the value begins, where the next field begins), or a code."""
        eq = data.find(b"=", at)
        if eq < 0:
            return "UnexpectedEof"
        tag = data[at:eq]
        if not tag.isdigit() or int(tag) > 4294967295:
            return "InvalidTag"
        end = data.find(self.sep, eq + 1)
        return (int(tag), eq + 1, end + 1) if end >= 0 else "UnexpectedEof"

    def message(self, data: bytes, at: int) -> int | str:
        """Where the message that begins at the marker ends, or a code."""
        first = self._field(data, at)
        if isinstance(first, str):
            return first
        if first[0] != 8:
            return "InvalidBeginString"
        second = self._field(data, first[2])
        if isinstance(second, str):
            return second
        length = data[second[1] : second[2] - 1]
        if second[0] != 9 or not length.isdigit() or int(length) > 4294967295:
            return "InvalidBodyLength"
        body_end = second[2] + int(length)
        if body_end > len(data):
            return "UnexpectedEof"
        last = self._field(data, body_end)
        if isinstance(last, str):
            return last
        if last[0] != 10:
            return "InvalidBodyLength"
        if not self.fields.fullmatch(data, at, last[2]) and not self._long_tags(data, at, last[2]):
            return "InvalidTag"
        return last[2]

    def _long_tags(self, data: bytes, at: int, end: int) -> bool:
        while at < end:
            m = self.field.match(data, at, end)
            if not m or int(m[1]) > 4294967295:
                return False
            at = m.end()
        return True

    def _plain(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where the messages that begin at these markers end, as far as their fields are like those of most messages; else -1."""
        n = len(data)
        sep = np.flatnonzero(data == self.sep[0])
        # fields begin behind separators: up to nine digits, then an equals sign
        bad = np.zeros(len(sep) + 1, dtype=np.int64)
        np.cumsum(_numbers(data, sep + 1, 61)[1] == 0, out=bad[1:])
        ends = np.full(len(starts), -1, dtype=np.int64)
        first = np.searchsorted(sep, starts)
        use = np.flatnonzero(first + 1 < len(sep))
        one = sep[first[use]]
        value, size = _numbers(data, one + 3, self.sep[0])
        good = (size > 0) & (data.take(one + 1, mode="clip") == 57) & (data.take(one + 2, mode="clip") == 61)
        use, body = use[good], (one + 4 + size + value)[good]
        inside = body + 3 < n
        use, body = use[inside], body[inside]
        good = (data[body] == 49) & (data[body + 1] == 48) & (data[body + 2] == 61)
        use, body = use[good], body[good]
        last = np.searchsorted(sep, body)
        whole = last < len(sep)
        use, last = use[whole], last[whole]
        good = bad[last] == bad[first[use]]
        ends[use[good]] = sep[last[good]] + 1
        return ends

    def take(self, data: bytes, base: int, more: bool, stop: int | None) -> tuple[Block, int]:
        """The messages of `data` that begin before `stop` (a place in it), and the place from which on nothing is decided yet."""
        view = np.frombuffer(data, dtype=np.uint8)
        mark = np.flatnonzero(view[: max(0, len(view) - 4)] == 56)
        for k, c in enumerate(MARKER[1:], 1):
            mark = mark[view[mark + k] == c]
        if stop is not None:
            mark = mark[mark < stop]
        rest = max(0, len(data) - len(MARKER) + 1) if more else len(data)
        if not len(mark):
            return Block(data, base, mark, mark), rest
        ends = self._plain(view, mark)
        if (ends > 0).all() and (mark[1:] >= ends[:-1]).all():
            return Block(data, base, mark, ends), max(rest, int(ends[-1]))
        starts, stops, errors, at = [], [], [], 0
        for start, end in zip(mark.tolist(), ends.tolist(), strict=True):
            if start < at:
                continue
            found = end if end > 0 else self.message(data, start)
            if found == "UnexpectedEof" and more and len(data) - start <= self.look_ahead:
                rest = start  # the message may go on
                break
            if isinstance(found, str):
                errors.append((base + start, found))
                at = start + 1
            else:
                starts.append(start)
                stops.append(found)
                at = found
        else:
            rest = max(rest, at)
        return Block(data, base, np.array(starts, dtype=np.int64), np.array(stops, dtype=np.int64), errors), rest

    def read(self, blocks: Iterator[bytes], base: int, stop: int | None) -> Iterator[Block]:
        """All markers from `base` up to `stop` (places in the source), block by block."""
        data, more = b"", True
        while more:
            block = next(blocks, None)
            more, data = block is not None, data + (block or b"")
            found, rest = self.take(data, base, more, None if stop is None else stop - base)
            yield found
            if stop is not None and base + rest >= stop:
                return
            data, base = data[rest:], base + rest

    def scan(self, blocks: Iterator[bytes], base: int, stop: int | None) -> Iterator[tuple[int, bytes | None, str | None]]:
        """(offset, message, None) or (offset, None, code) of all markers from `base` up to `stop`."""
        for b in self.read(blocks, base, stop):
            rows = [(b.base + x, b.data[x:y], None) for x, y in zip(b.starts.tolist(), b.ends.tolist(), strict=True)] + [(x, None, code) for x, code in b.errors]
            yield from sorted(rows, key=lambda r: r[0])


class Promoter:
    """Takes the first occurrence of chosen tags, and any further ones, from blocks of framed messages."""

    def __init__(self, separator: str, tags: tuple[int, ...]):
        self.sep, self.tags = separator.encode()[0], tags

    def columns(self, block: Block) -> list[pa.Array]:
        """A binary array for each tag, then the further occurrences as list<struct<tag, value>>, null for messages without any."""
        data, n = np.frombuffer(block.data, dtype=np.uint8), len(block.starts)
        sep = np.flatnonzero(data == self.sep)
        # a message's fields: its own beginning, and what follows each of its separators but the last
        low, high = np.searchsorted(sep, block.starts), np.searchsorted(sep, block.ends - 1)
        count = high - low
        of = np.repeat(np.arange(n), count + 1)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(count + 1) - (count + 1), count + 1)
        place = np.repeat(low, count + 1) + inner  # the separator that ends the field
        begin = np.where(inner == 0, np.repeat(block.starts, count + 1), sep[np.maximum(place - 1, 0)] + 1) if len(of) else np.zeros(0, dtype=np.int64)
        end = sep[place] if len(of) else begin
        tag, size = _numbers(data, begin, 61)
        for k in np.flatnonzero(size == 0).tolist():  # many digits, of which most are leading zeros
            size[k] = block.data.index(b"=", begin[k]) - begin[k]
            tag[k] = int(block.data[begin[k] : begin[k] + size[k]])
        eq = begin + size
        out, more = [], []
        for number in self.tags:
            chosen = np.flatnonzero(tag == number)
            first = np.ones(len(chosen), dtype=bool)
            first[1:] = of[chosen[1:]] != of[chosen[:-1]]
            more.append(chosen[~first])
            chosen = chosen[first]
            starts, sizes, valid = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
            starts[of[chosen]], sizes[of[chosen]], valid[of[chosen]] = eq[chosen] + 1, end[chosen] - eq[chosen] - 1, True
            out.append(gathered(data, starts, sizes, valid))
        more = np.sort(np.concatenate(more)) if more else np.zeros(0, dtype=np.int64)
        sizes = np.bincount(of[more], minlength=n) if n else np.zeros(0, dtype=np.int64)
        values = pa.StructArray.from_arrays([pa.array(tag[more]), gathered(data, eq[more] + 1, end[more] - eq[more] - 1)], names=["tag", "value"])
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), mask=np.append(sizes == 0, False))
        return [*out, pa.ListArray.from_arrays(offsets, values)]


def _blocks(path: str, start: int) -> Iterator[bytes]:
    files, at = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    with files.open_input_file(at) if not path.lower().endswith(".gz") else files.open_input_stream(at, compression=None) as stream:
        if not path.lower().endswith(".gz"):
            stream.seek(start)
            while block := stream.read(READ):
                yield block
            return
        gzip = zlib.decompressobj(wbits=31)
        while block := stream.read(READ):
            while block:
                if gzip.eof:
                    gzip = zlib.decompressobj(wbits=31)
                if data := gzip.decompress(block):
                    yield data
                block = gzip.unused_data
        if not gzip.eof:
            raise EOFError(f"{path}: the gzip stream ends early")


def plain_path(uri: str) -> str:
    """A path as Spark names it, in a form that pyarrow takes too."""
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def file_sizes(spark: SparkSession, paths: list[str]) -> list[tuple[str, int]]:
    """(path, bytes) of each path in order, by the session's file system. A pattern stands for the files that match it and a folder for its files, by name; names that
    begin with a dot or an underscore are left out."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        files = p.getFileSystem(conf)
        matched = [files.getFileStatus(p)] if files.exists(p) else list(files.globStatus(p) or [])
        if not matched:
            raise FileNotFoundError(path)
        for status in sorted(matched, key=lambda x: x.getPath().toString()):
            inner = list(files.listStatus(status.getPath())) if status.isDirectory() else [status]
            for one in sorted(inner, key=lambda x: x.getPath().toString()):
                if one is status or not one.isDirectory() and one.getPath().getName()[0] not in "._":
                    found.append((plain_path(one.getPath().toString()), one.getLen()))
    return found


def ranges(spark: SparkSession, paths: list[str], size: int = RANGE, bases: DataFrame | None = None) -> DataFrame:
    """(source_idx, source, start, stop): each file in ranges, in order, a task each; with bases (source_idx, start, base), also the range's base."""
    rows = []
    for i, (path, length) in enumerate(file_sizes(spark, paths)):
        if path.lower().endswith(".gz"):
            rows.append((i, path, 0, None))
        else:
            rows += [(i, path, a, a + size if a + size < length else None) for a in range(0, max(1, length), size)]
    every = spread(spark, rows)
    if bases is not None:
        every = every.join(bases, ["source_idx", "start"]).select("source_idx", "source", "start", "stop", "base").repartitionByRange(len(rows), "source_idx", "start")
    return every


def spread(spark: SparkSession, spans: list[tuple[int, str, int, int | None]]) -> DataFrame:
    """Spans (source_idx, source, start, stop) of files, a task each."""
    return spark.createDataFrame(spans, "source_idx int, source string, start long, stop long").repartitionByRange(max(1, len(spans)), "source_idx", "start")


def scan(spark: SparkSession, paths: list[str], separator: str, size: int = RANGE, bases: DataFrame | None = None, tags: tuple[int, ...] = ()) -> DataFrame:
    """All frames of the files: (source_idx, source, range_start, seq, offset, raw, code); seq counts the valid messages of a range, from its base or 0. With `tags`, also
    t<tag> (binary), the first occurrence, and repeats, further ones; then damaged messages have a row too."""
    return framed(ranges(spark, paths, size, bases), separator, tags)


def framed(spans: DataFrame, separator: str, tags: tuple[int, ...] = ()) -> DataFrame:
    """As `scan`, of spans (source_idx, source, start, stop) of files."""
    schema = FRAMES + "".join(f", t{t} binary" for t in tags) + (", repeats array<struct<tag:bigint,value:binary>>" if tags else "")
    names = [c.split(" ")[0] for c in FRAMES.split(", ")] + [f"t{t}" for t in tags] + (["repeats"] if tags else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        framer, promoter = Framer(separator), Promoter(separator, tags)
        for part in batches:
            for row in part.to_pylist():
                seq = row.get("base", 0)
                for block in framer.read(_blocks(row["source"], row["start"]), row["start"], row["stop"]):
                    n = len(block.starts)
                    if n:
                        more = promoter.columns(block) if tags else []
                        yield out(row, n, np.arange(seq, seq + n), block.starts + block.base, block.raw(), pa.nulls(n, pa.string()), more)
                        seq += n
                    if k := len(block.errors):
                        offsets, codes = zip(*block.errors, strict=True)
                        more = [pa.nulls(k, pa.binary()) for _ in tags] + ([pa.nulls(k, pa.list_(pa.struct([("tag", pa.int64()), ("value", pa.binary())])))] if tags else [])
                        yield out(row, k, pa.nulls(k, pa.int64()), offsets, pa.nulls(k, pa.binary()), codes, more)

    def out(row: dict, n: int, seq, offset, raw, code, more: list) -> pa.RecordBatch:
        same = [pa.repeat(pa.scalar(row[c], t), n) for c, t in (("source_idx", pa.int32()), ("source", pa.string()), ("start", pa.int64()))]
        columns = [*same, pa.array(seq, pa.int64()), pa.array(offset, pa.int64()), raw, pa.array(code, pa.string()), *more]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return spans.mapInArrow(run, schema)


def native_frames(df: DataFrame, record: str = "record", separator: Column | str = "\x01") -> DataFrame:
    """Add raw (the message as a string of its bytes) or code to rows whose `record` holds at most one message, behind any prefix. A
    message that runs past its record is UnexpectedEof."""
    sep = F.lit(separator) if isinstance(separator, str) else separator
    text = F.col(record)
    plain = F.octet_length(text) == F.length(text)
    wide = F.decode(text.cast("binary"), "ISO-8859-1")  # one character for each byte
    out = df.withColumn("_w", F.when(plain, text).otherwise(wide)).withColumn("_b", F.expr("locate('8=FIX', _w)"))
    out = out.withColumn("_w", F.expr("substring(_w, _b)")).withColumn("sep", sep)
    out = out.withColumn("_p1", F.expr("locate(sep, _w)"))
    out = out.withColumn("_e2", F.expr("IF(_p1 > 0, locate('=', _w, _p1 + 1), 0)")).withColumn("_p2", F.expr("IF(_e2 > 0, locate(sep, _w, _e2 + 1), 0)"))
    out = out.withColumn("_t2", F.expr("substring(_w, _p1 + 1, _e2 - _p1 - 1)")).withColumn("_n", u32(F.expr("substring(_w, _e2 + 1, _p2 - _e2 - 1)")))
    out = out.withColumn("_end", F.expr("_p2 + _n")).withColumn("_e3", F.expr("IF(_p2 > 0 AND _end < length(_w), locate('=', _w, int(_end) + 1), 0)"))
    out = out.withColumn("_p3", F.expr("IF(_e3 > 0, locate(sep, _w, _e3 + 1), 0)")).withColumn("_t3", F.expr("substring(_w, int(_end) + 1, _e3 - int(_end) - 1)"))
    number_2, number_3 = (F.col(c).rlike(f"^{_TAG}$") for c in ("_t2", "_t3"))
    code = (
        F.when(text.isNull() | (F.col("_b") == 0), F.lit("InvalidBeginString"))
        .when((F.col("_p1") == 0) | (F.col("_e2") == 0), F.lit("UnexpectedEof"))
        .when(~number_2, F.lit("InvalidTag"))
        .when(F.col("_p2") == 0, F.lit("UnexpectedEof"))
        .when(~F.col("_t2").rlike("^0*9$") | F.col("_n").isNull(), F.lit("InvalidBodyLength"))
        .when(F.col("_e3") == 0, F.lit("UnexpectedEof"))
        .when(~number_3, F.lit("InvalidTag"))
        .when(F.col("_p3") == 0, F.lit("UnexpectedEof"))
        .when(~F.col("_t3").rlike("^0*10$"), F.lit("InvalidBodyLength"))
    )
    whole = F.expr("left(_w, _p3)")
    # one pass by a regular expression that never backtracks into a field
    field = F.concat(F.lit(f"^(?:{_TAG}=[^"), F.when(F.col("sep") == "^", F.lit("\\^")).otherwise(F.col("sep")), F.lit("]*+\\Q"), F.col("sep"), F.lit("\\E)++$"))
    good_fields = F.rlike(whole, field)
    code = F.coalesce(code, F.when(~good_fields, F.lit("InvalidTag")))
    raw = F.when(F.octet_length("_w") == F.length("_w"), whole).otherwise(F.encode(whole, "ISO-8859-1").cast("string"))
    out = out.withColumn("_code", code).withColumn("_raw", F.when(F.col("_code").isNull(), raw))
    # what a generator makes is not computed again below it, which filters on these columns else would do many times over
    return out.select(*df.columns, "sep", F.inline_outer(F.array(F.struct(F.col("_raw").alias("raw"), F.col("_code").alias("code")))))


def count(spark: SparkSession, paths: list[str], separator: str, size: int = RANGE) -> DataFrame:
    """(source_idx, range_start, n): valid messages of each range, which make no rows here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        framer = Framer(separator)
        for part in batches:
            rows = part.to_pylist()
            n = [sum(len(b.starts) for b in framer.read(_blocks(r["source"], r["start"]), r["start"], r["stop"])) for r in rows]
            columns = [pa.array([r["source_idx"] for r in rows], pa.int32()), pa.array([r["start"] for r in rows], pa.int64()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["source_idx", "range_start", "n"])

    return ranges(spark, paths, size).mapInArrow(run, "source_idx int, range_start long, n long")
