"""Messages over time, in buckets of tag 52."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixlake.functions.graph import checkpointed
from fixlake.functions.tokens import read, stored_tags
from fixlake.functions.values import sending_ns

#: Bins that are filled in; a finer histogram stays sparse only.
MOST_BINS = 10_000_000
# Eighths of a column
LEVELS = " ▁▂▃▄▅▆▇█"


def sparse(messages: DataFrame, bucket_ns: int) -> DataFrame:
    """(start_ns, count) of the bins that have messages; start_ns is null for those without a readable time."""
    bucket = max(1, bucket_ns)
    ns = sending_ns(read(messages, 52))
    return messages.select((ns - ns % bucket).alias("start_ns")).groupBy("start_ns").agg(F.count(F.lit(1)).alias("count"))


def dropped(messages: DataFrame) -> DataFrame:
    """(dropped_no_time): messages without a readable tag 52."""
    return messages.agg(F.count_if(sending_ns(read(messages, 52)).isNull()).alias("dropped_no_time"))


def histogram(messages: DataFrame, bucket_ns: int) -> DataFrame:
    """(start_ns, end_ns, count) of all bins from the first to the last, empty ones too. Raises ValueError beyond MOST_BINS bins."""
    bucket = max(1, bucket_ns)
    bins = sparse(messages, bucket).where("start_ns IS NOT NULL")
    bins = bins if stored_tags(messages) else checkpointed(bins)  # a text is read once
    ends = bins.agg(F.min("start_ns").alias("a"), F.max("start_ns").alias("b")).first()  # two numbers
    if ends["a"] is not None and (ends["b"] - ends["a"]) // bucket >= MOST_BINS:
        raise ValueError(f"more than {MOST_BINS} bins; take a larger bucket")
    spark = messages.sparkSession
    every = spark.range(0 if ends["a"] is None else ends["a"], 0 if ends["a"] is None else ends["b"] + 1, bucket).withColumnRenamed("id", "start_ns")
    return every.join(bins, "start_ns", "left").select("start_ns", (F.col("start_ns") + bucket).alias("end_ns"), F.coalesce("count", F.lit(0)).alias("count"))


def peaks(bins: DataFrame, k: int) -> DataFrame:
    """The k fullest bins; of equal ones the earlier first."""
    return bins.where("count > 0").orderBy(F.desc("count"), "start_ns").limit(k)


def total(bins: DataFrame) -> DataFrame:
    return bins.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))


def sparkline(bins: DataFrame, width: int) -> str:
    """Bins merged into `width` columns, drawn in eighths of the 95th percentile."""
    if width <= 0:
        return ""
    numbered = bins.agg(F.count(F.lit(1)).alias("n"), F.min("start_ns").alias("a"), F.max(F.col("end_ns") - F.col("start_ns")).alias("w")).first()
    n = numbered["n"]
    if not n:
        return ""
    spans = [(i * n // width, min(n, max((i + 1) * n // width, i * n // width + 1))) for i in range(width)]
    cells = bins.sparkSession.createDataFrame([(c, lo, hi) for c, (lo, hi) in enumerate(spans)], "cell int, lo long, hi long")
    index = ((F.col("start_ns") - numbered["a"]) / numbered["w"]).cast("long")
    if n <= width * 4:  # few bins: a bin may fall into several columns
        merged = bins.withColumn("i", index).join(cells, (F.col("i") >= F.col("lo")) & (F.col("i") < F.col("hi"))).groupBy("cell").agg(F.sum("count").alias("c"))
    else:  # each bin is in one column
        cell = F.floor(((index + 1) * width - 1) / n).cast("int")
        merged = bins.groupBy(cell.alias("cell")).agg(F.sum("count").alias("c"))
    found = {r["cell"]: r["c"] for r in merged.collect()}  # at most `width` rows
    counts = [found.get(i, 0) for i in range(width)]
    scale = sorted(counts)[max(0, len(counts) * 95 - 1) // 100] or 1
    return "".join(LEVELS[min(8, c * 8 // scale)] for c in counts)
