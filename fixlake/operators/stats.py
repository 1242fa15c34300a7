"""Summary statistics of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixlake.functions.dictionary import Dictionary, builtin, chain_for
from fixlake.functions.tokens import final, occurrences, read


def message_types(messages: DataFrame, top: int | None = 10, d: Dictionary | None = None) -> DataFrame:
    """(msg_type, n, label), most frequent first: every occurrence of tag 35 counts; labels by the chain of the last message. All types with top=None."""
    d = d or builtin()
    kinds = messages.select(F.explode(occurrences(messages, 35)).alias("t")).select(F.col("t.value").alias("msg_type"))
    counts = kinds.groupBy("msg_type").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.orderBy(F.desc("n"), "msg_type").limit(top) if top else counts
    begin, appl = read(messages, 8), read(messages, 1128)
    seen = messages.agg(F.max_by(begin, "ordinal").alias("begin"), F.max_by(appl, F.when(appl.isNotNull(), F.col("ordinal"))).alias("appl")).first()
    chain = chain_for(seen["begin"], seen["appl"])
    names = {k: v for version in reversed(chain) for k, v in d.messages.get(version, {}).items()}
    label = F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("msg_type"))
    return counts.withColumn("label", label)


def session_pairs(messages: DataFrame) -> DataFrame:
    """(sender, target, n) of directed pairs; the last occurrence of tags 49 and 56 in a message counts."""
    pairs = messages.select(final(messages, 49).alias("sender"), final(messages, 56).alias("target")).where("sender IS NOT NULL AND target IS NOT NULL")
    return pairs.groupBy("sender", "target").agg(F.count(F.lit(1)).alias("n"))


def totals(messages: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: messages, errors, and the smallest and largest tag 52 as texts, over every occurrence."""
    times = F.transform(occurrences(messages, 52), lambda t: t["value"])
    of = messages.select(F.array_min(times).alias("a"), F.array_max(times).alias("b"))
    seen = of.agg(F.count(F.lit(1)).alias("messages"), F.min("a").alias("min_time"), F.max("b").alias("max_time"))
    return seen.crossJoin(F.broadcast(errors.agg(F.count(F.lit(1)).alias("errors")))).select("messages", "errors", "min_time", "max_time")  # one row each


def order_counts(messages: DataFrame, limit: int | None = 20) -> DataFrame:
    """(clordid, events) by the first tag 11 of each message, most frequent first, then by identifier."""
    counts = messages.select(read(messages, 11).alias("clordid")).where("clordid IS NOT NULL").groupBy("clordid").agg(F.count(F.lit(1)).alias("events"))
    return counts.orderBy(F.desc("events"), "clordid").limit(limit) if limit is not None else counts


def index_metrics(messages: DataFrame, hot: tuple[int, ...] = (35, 49, 56, 11, 34, 37, 41)) -> DataFrame:
    """(messages, keys, entries) of the lookup by hot tags."""
    found = postings(messages, hot).agg(F.count_distinct("tag", "value").alias("keys"), F.count(F.lit(1)).alias("entries"))
    return messages.agg(F.count(F.lit(1)).alias("messages")).crossJoin(F.broadcast(found))  # one row each


def postings(messages: DataFrame, hot: tuple[int, ...]) -> DataFrame:
    """(tag, value, ordinal): each value of a hot tag that a message has, once."""
    return messages.select("ordinal", F.explode(F.array_distinct(occurrences(messages, *hot))).alias("t")).select("t.tag", "t.value", "ordinal")
