"""Logs as a data source: spark.read and spark.readStream with format("fix").

    register(spark)
    spark.read.format("fix").option("path", "hdfs:///logs/monday.log").load().where("t35 = 'D'")

Rows have source, offset, raw, sep and a column t<tag> for each tag that analyses read. A batch read takes ranges of the files in tasks; with the option `until`, offsets as a stream has them, it ends where a
stream stands. Conditions on these columns are pushed to the reader (=, <=>, IN, IS NULL, IS NOT NULL, and text that begins or ends with or holds another), which applies them to a block's tags before any message becomes a row; what
can't be pushed Spark applies itself. Damaged messages have no rows; `read_log` has them, and dense numbers.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not, StringContains, StringEndsWith, StringStartsWith,
)

from fixlake.functions.tokens import PROMOTED
from fixlake.sources.frames import RANGE, Framer, Promoter, _blocks
from fixlake.sources.layout import SNIFF_WINDOW, sniff
from fixlake.streaming.tail import Span, TailReader, _read, length

COLUMNS = ["source", "offset", "raw", "sep", *[f"t{t}" for t in PROMOTED]]
SCHEMA = ", ".join(f"{c} {'long' if c == 'offset' else 'string'}" for c in COLUMNS)
#: Filters that the reader applies, with the functions that do.
_APPLIED = {
    EqualTo: lambda c, f: pc.equal(c, f.value), EqualNullSafe: lambda c, f: pc.is_null(c) if f.value is None else pc.fill_null(pc.equal(c, f.value), False),
    In: lambda c, f: pc.is_in(c, pa.array([v for v in f.value if v is not None], c.type)), IsNull: lambda c, f: pc.is_null(c), IsNotNull: lambda c, f: pc.is_valid(c),
    StringStartsWith: lambda c, f: pc.starts_with(c, f.value), StringEndsWith: lambda c, f: pc.ends_with(c, f.value), StringContains: lambda c, f: pc.match_substring(c, f.value),
}


def _text(column: pa.Array) -> pa.Array:
    """Binary values as strings; bytes that are no UTF-8 become replacement characters, as Spark's Arrow reader takes strings only."""
    try:
        return column.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if v is None else v.decode("utf-8", "replace") for v in column.to_pylist()], pa.string())


def _kept(filters: list[Filter], column) -> pa.Array | None:
    """Which rows all filters take, given columns by name."""
    def one(f: Filter) -> pa.Array:
        return pc.invert(one(f.child)) if isinstance(f, Not) else _APPLIED[type(f)](column(f.attribute[0]), f)

    return pc.fill_null(reduce(pc.and_kleene, map(one, filters)), False) if filters else None


def batches(span: Span, filters: list[Filter]) -> Iterator[pa.RecordBatch]:
    """The messages of a span that filters take."""
    framer, promoter = Framer(span.sep), Promoter(span.sep, PROMOTED)
    for block in framer.read(_blocks(span.path, span.start), span.start, span.stop):
        n = len(block.starts)
        if not n:
            continue
        tags = dict(zip(COLUMNS[4:], promoter.columns(block), strict=False))
        made = {"offset": pa.array(block.starts + block.base), "source": pa.array([span.path] * n), "sep": pa.array([span.sep] * n)}

        def column(name: str) -> pa.Array:
            if name not in made:
                made[name] = _text(block.raw() if name == "raw" else tags[name])  # noqa: B023
            return made[name]  # noqa: B023

        keep = _kept(filters, column)
        if keep is not None:
            rows = np.flatnonzero(keep.to_numpy(zero_copy_only=False))
            if not len(rows):
                continue
            block.starts, block.ends = block.starts[rows], block.ends[rows]
            made = {name: c.take(pa.array(rows)) for name, c in made.items() if name != "raw"}
            tags = {name: c.take(pa.array(rows)) for name, c in tags.items()}
        yield pa.RecordBatch.from_arrays([column(c) for c in COLUMNS], names=COLUMNS)


class FixReader(DataSourceReader):
    def __init__(self, paths: list[str], separator: str | None, until: dict | None, range_size: int):
        self.paths, self.separator, self.until, self.range_size = paths, separator, until, range_size
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            known = type(inner) in _APPLIED and len(inner.attribute) == 1 and inner.attribute[0] in COLUMNS
            if known and (inner.attribute[0] != "offset" or isinstance(inner, (EqualTo, IsNotNull))):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            sep = self.separator or sniff(_read(path, 0, SNIFF_WINDOW) if not path.lower().endswith(".gz") else next(_blocks(path, 0))[:SNIFF_WINDOW]).separator
            if path.lower().endswith(".gz"):
                out.append(Span(path, 0, None, sep))
                continue
            end = self.until[path] if self.until else length(path)
            stops = [*range(self.range_size, end, self.range_size), end if self.until else None]
            out += [Span(path, start, stop, sep) for start, stop in zip(range(0, max(1, end), self.range_size), stops, strict=True)]
        return out

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return batches(partition, self.filters)


class FixStream(TailReader):
    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        return batches(span, [])


class FixSource(DataSource):
    """Options: path, or paths as a JSON list; separator, sniffed from the first bytes if it is not given; range_size; for batches until, as JSON; for streams start, beginning or end."""

    @classmethod
    def name(cls) -> str:
        return "fix"

    def schema(self) -> str:
        return SCHEMA

    def _paths(self) -> list[str]:
        return json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]

    def reader(self, schema) -> FixReader:
        until = json.loads(self.options["until"])["at"] if "until" in self.options else None
        return FixReader(self._paths(), self.options.get("separator"), until, int(self.options.get("range_size", RANGE)))

    def streamReader(self, schema) -> FixStream:
        return FixStream(self._paths(), self.options.get("separator"), self.options.get("start", "beginning"))


def register(spark: SparkSession) -> None:
    """Make format("fix") known to a session, and have it push filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FixSource)


