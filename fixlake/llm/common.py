"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixlake.functions.graph import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key's decimal text, modulo `folds`; null keys are in no fold."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))


#: Bytes of a batch that are made into Python objects at once; a row of more is a batch by itself.
BATCH_BYTES = 4 << 20


def bounded(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` bytes, or of one row."""
    todo: list[pa.RecordBatch] = []
    for batch in batches:
        todo.append(batch)
        while todo:
            part = todo.pop()
            if part.num_rows < 2 or part.get_total_buffer_size() <= most or part.nbytes <= most:
                if part.num_rows:
                    yield part
                continue
            half = part.num_rows // 2
            todo += [part.slice(half), part.slice(0, half)]


def per_row(
    df: DataFrame, columns: list[str], func: Callable[..., tuple], schema: str, setup: Callable[[], dict] | None = None
) -> DataFrame:
    """Apply func(*values, **setup()) to each row's `columns`; it returns a tuple of the schema's fields.

    Rows go through Arrow in batches that are bounded in bytes; `setup` runs once a task.
    """
    wanted = df.select(*[F.col(c) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else {}
        for batch in bounded(batches):
            rows = [func(*values, **state) for values in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(fields)], names=fields.names)

    fields = arrow_schema(schema)
    return wanted.mapInArrow(run, schema)


_TYPES = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(),
    "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
}


def arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (f.strip().split(" ") for f in schema.split(","))])


class Saved:
    """Tables of one run in the shared folder: `saved(name, df)` writes df and reads it again, which cuts its lineage. At the end of the block all go but
    those written by `last`, which the result still reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.names = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", []

    def __enter__(self) -> Saved:
        return self

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        self.names.append(name)
        return self.last(name, df)

    def last(self, name: str, df: DataFrame) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def __exit__(self, *_: object) -> None:
        for name in self.names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
