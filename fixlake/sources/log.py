"""Logs as DataFrames of messages.

Columns: source_idx, source, ordinal (of valid messages over all sources in the order given, from 0), offset (in the uncompressed source), raw_len, raw, sep.
Tags are read from raw with fixlake.functions.tokens. Sources are given oldest first; the first one's layout holds for all.

A log that is looked at more than once is saved: `save` frames it and writes Parquet in which the tags that analyses read have columns of their own, so that filters are pushed to
the scan and an analysis reads the columns that it needs only. `read_saved` gives the same messages and errors, with those columns added.
"""

from __future__ import annotations

import sys
import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixlake.functions.tokens import PROMOTED, fields, with_stored
from fixlake.sources.frames import RANGE, READ, _blocks, count, file_sizes, native_frames, scan
from fixlake.sources.layout import SNIFF_WINDOW, LogFormat, sniff


@dataclass
class Log:
    """`messages` holds the valid messages, `errors` (source_idx, source, offset, code) the damaged ones."""

    messages: DataFrame
    errors: DataFrame
    format: LogFormat
    #: For logs of files: their frames with the promoted tags, errors among them.
    frames: DataFrame | None = None

    def with_tags(self) -> DataFrame:
        return self.messages.withColumn("tags", fields())

    def save(self, folder: str) -> Log:
        """Write the log below a folder that all executors share, and read it from there."""
        spark = self.messages.sparkSession
        if self.frames is None:
            bad = self.errors.withColumn("ordinal", F.lit(None).cast("long"))
            frames = with_stored(self.messages).withColumn("code", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)
        else:
            frames = self.frames
        frames.write.parquet(f"{folder}/frames")
        spark.createDataFrame([(self.format.separator, self.format.prefix_len, self.format.line_ending)], "separator string, prefix_len int, line_ending string").write.json(f"{folder}/format")
        return read_saved(spark, folder)


def read_saved(spark: SparkSession, folder: str) -> Log:
    """A log that `Log.save` has written."""
    frames, told = spark.read.parquet(f"{folder}/frames"), spark.read.json(f"{folder}/format").first()
    messages = frames.where("code IS NULL").drop("code")
    return Log(messages, frames.where("code IS NOT NULL").select("source_idx", "source", "offset", "code"), LogFormat(told["separator"], told["prefix_len"], told["line_ending"]))


def head(spark: SparkSession, path: str, n: int = SNIFF_WINDOW) -> bytes:
    """The first bytes of a source, of a folder's first file, uncompressed."""
    path = file_sizes(spark, [path])[0][0]
    data = b""
    for block in _blocks(path, 0):
        data += block[: n - len(data)]
        if len(data) >= n:
            break
    return data


def spool_stdin(spark: SparkSession) -> str:
    """Standard input as a file on the driver, which only tasks of a local master can open. Raises ValueError if it is a terminal or empty."""
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("standard input can be read with a local master only")
    if sys.stdin.isatty():
        raise ValueError("standard input is a terminal")
    with tempfile.NamedTemporaryFile("wb", suffix=".log", delete=False) as out:
        size = 0
        while block := sys.stdin.buffer.read(1 << 20):
            size += out.write(block)
    if not size:
        raise ValueError("standard input is empty")
    return out.name


def read_log(spark: SparkSession, paths: str | list[str], fmt: LogFormat | None = None, range_size: int | None = None) -> Log:
    """Read plain and gzip files (any case of `.gz`, several members), folders and patterns of them, or `-` for standard input."""
    paths = [spool_stdin(spark) if p == "-" else p for p in ([paths] if isinstance(paths, str) else paths)]
    files = file_sizes(spark, paths)
    paths = [path for path, _ in files]
    fmt = fmt or sniff(head(spark, paths[0]))
    tasks = 2 * spark.sparkContext.defaultParallelism
    size = range_size or min(RANGE, max(READ, sum(n for _, n in files) // tasks))
    counts = count(spark, paths, fmt.separator, size)
    # the ranges get their first ordinals before they are read, so that only a row for each range moves and never a message
    before = Window.orderBy("source_idx", "range_start").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("source_idx", F.col("range_start").alias("start"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def columns(code: str | None) -> list:
        return [
            "source_idx", "source", F.col("seq").alias("ordinal"), "offset", F.octet_length("raw").cast("long").alias("raw_len"), F.col("raw").cast("string").alias("raw"),
            F.lit(fmt.separator).alias("sep"), *([code] if code else []),
        ]

    messages = scan(spark, paths, fmt.separator, size, bases=bases).where("code IS NULL").select(*columns(None))
    errors = scan(spark, paths, fmt.separator, size).where("code IS NOT NULL").select("source_idx", "source", "offset", "code")
    frames = scan(spark, paths, fmt.separator, size, bases=bases, tags=PROMOTED).select(*columns("code"), *promoted())
    return Log(messages, errors, fmt, frames)


def promoted() -> list[Column]:
    """The columns of a saved log that hold tags, from those that framing gives."""
    pairs = F.transform("repeats", lambda x: F.struct(x["tag"].alias("tag"), x["value"].cast("string").alias("value")))
    return [F.col(f"t{t}").cast("string").alias(f"t{t}") for t in PROMOTED] + [pairs.alias("repeats"), F.col("repeats").isNotNull().alias("repeated")]


def read_records(df: DataFrame, record: str, order: str, separator: str = "\x01") -> Log:
    """Messages from rows that hold one each; `order` is a unique number that gives their order and becomes the ordinal."""
    framed = native_frames(df, record, separator)
    base = framed.withColumn("source_idx", F.lit(0)).withColumn("source", F.lit("rows")).withColumn("offset", F.col(order).cast("long"))
    messages = base.where("code IS NULL").select(
        "source_idx", "source", F.col(order).cast("long").alias("ordinal"), "offset", F.octet_length("raw").cast("long").alias("raw_len"), "raw", "sep"
    )
    return Log(messages, base.where("code IS NOT NULL").select("source_idx", "source", "offset", "code"), LogFormat(separator))


def scan_lines(spark: SparkSession, paths: str | list[str], fmt: LogFormat | None = None) -> DataFrame:
    """(raw, sep, code, source) by splitting at the marker on the JVM side only: the fastest scan for filters and counts that need neither offsets nor ordinals. A
    marker inside a value ends a message here, which read_log handles."""
    paths = [paths] if isinstance(paths, str) else paths
    fmt = fmt or sniff(head(spark, paths[0]))
    lines = spark.read.option("lineSep", "8=FIX").text(paths).select(F.concat(F.lit("8=FIX"), "value").alias("record"), F.input_file_name().alias("source"))
    return native_frames(lines.where(F.length("record") > 5), "record", fmt.separator).drop("record")
