"""Sessions: traffic between two parties, whichever way, with gaps in their sequence numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixlake.functions.tokens import read
from fixlake.functions.values import u32

#: Sequence numbers of a session and direction that are ordered in one task.
BUCKET = 100_000


def with_session(messages: DataFrame) -> DataFrame:
    """Add sender and target (the smaller and the larger identifier) and direction; null where tag 49 or 56 is missing."""
    a, b = read(messages, 49), read(messages, 56)
    both = a.isNotNull() & b.isNotNull()
    return messages.withColumns({
        "sender": F.when(both, F.least(a, b)), "target": F.when(both, F.greatest(a, b)), "direction": F.when(both, F.when(a <= b, "in").otherwise("out")),
    })


def sessions(messages: DataFrame) -> DataFrame:
    """(sender, target, in_count, out_count, by_msg_type, seq_min, seq_max): by_msg_type maps types to counts."""
    return of_counts(counts(messages))


def counts(messages: DataFrame) -> DataFrame:
    """(sender, target, kind, i, o, a, b): what sessions are made of. Counts of parts of a log can be kept, and those of new messages added to them by union."""
    base = with_session(messages).where("sender IS NOT NULL").select("sender", "target", "direction", read(messages, 35).alias("kind"), u32(read(messages, 34)).alias("seq"))
    return base.groupBy("sender", "target", "kind").agg(
        F.count_if(F.col("direction") == "in").alias("i"), F.count_if(F.col("direction") == "out").alias("o"), F.min("seq").alias("a"), F.max("seq").alias("b")
    )


def of_counts(found: DataFrame) -> DataFrame:
    """The sessions of counts, of one part of a log or of several."""
    kinds = found.groupBy("sender", "target", "kind").agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.min("a").alias("a"), F.max("b").alias("b"))
    counted = F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", (F.col("i") + F.col("o")).alias("n"))))
    return kinds.groupBy("sender", "target").agg(
        F.sum("i").alias("in_count"), F.sum("o").alias("out_count"), F.map_from_entries(F.array_sort(counted)).alias("by_msg_type"),
        F.min("a").alias("seq_min"), F.max("b").alias("seq_max"),
    )


def top_types(by_msg_type: Column, n: int = 3) -> Column:
    """The n most frequent types of a session, as `type=count` joined by spaces."""
    entries = F.array_sort(F.map_entries(by_msg_type), lambda x, y: F.when(x["value"] != y["value"], F.signum(y["value"] - x["value"]).cast("int")).when(
        x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))
    return F.array_join(F.transform(F.slice(entries, 1, n), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ")


def seq_gaps(messages: DataFrame) -> DataFrame:
    """(sender, target, direction, from_seq, to_seq, ordinal_before, ordinal_after) where sequence numbers in order leave some out; repeated numbers are no gap.

    Distinct numbers are ordered within buckets of `BUCKET` numbers, and only the buckets' ends across them, so that no task orders all of a busy session.
    """
    return of_numbers(numbers(messages))


def numbers(messages: DataFrame) -> DataFrame:
    """(sender, target, direction, seq, last, first): the distinct sequence numbers with the last and the first message of each; they add up by union, as counts do."""
    base = with_session(messages).select("sender", "target", "direction", u32(read(messages, 34)).alias("seq"), "ordinal").where("sender IS NOT NULL AND seq IS NOT NULL")
    return base.groupBy("sender", "target", "direction", "seq").agg(F.max("ordinal").alias("last"), F.min("ordinal").alias("first"))


def of_numbers(found: DataFrame) -> DataFrame:
    """The gaps of sequence numbers, of one part of a log or of several."""
    numbers = found.groupBy("sender", "target", "direction", "seq").agg(F.max("last").alias("last"), F.min("first").alias("first"))
    numbers = numbers.withColumn("bucket", F.floor(F.col("seq") / BUCKET))
    side = ["sender", "target", "direction"]
    order = Window.partitionBy(*side, "bucket").orderBy("seq")
    inside = numbers.withColumns({"to_seq": F.lead("seq").over(order), "ordinal_after": F.lead("first").over(order)})
    ends = numbers.groupBy(*side, "bucket").agg(
        F.max("seq").alias("seq"), F.max_by("last", "seq").alias("last"), F.min("seq").alias("low"), F.min_by("first", "seq").alias("low_first")
    )
    across = Window.partitionBy(*side).orderBy("bucket")
    between = ends.withColumns({"to_seq": F.lead("low").over(across), "ordinal_after": F.lead("low_first").over(across)})
    columns = [*side, F.col("seq").alias("from_seq"), "to_seq", F.col("last").alias("ordinal_before"), "ordinal_after"]
    return inside.select(*columns).unionByName(between.select(*columns)).where("to_seq > from_seq + 1")


#: Ordinals of a block, at the ends of which runs end too, so that a busy session is ordered in many tasks.
BLOCK = 1 << 16


def ordinal_runs(messages: DataFrame) -> DataFrame:
    """(sender, target, first, last): which messages a session has, in runs of ordinals in a row within blocks of BLOCK."""
    base = with_session(messages).where("sender IS NOT NULL")
    return merged_runs(base.select("sender", "target", F.col("ordinal").alias("first"), F.col("ordinal").alias("last")))


def merged_runs(runs: DataFrame) -> DataFrame:
    """Runs of one part of a log or of several, with those that touch made one. New messages need no second look at old ones."""
    ordered = Window.partitionBy("sender", "target", F.floor(F.col("first") / BLOCK)).orderBy("first")
    new = F.coalesce((F.col("first") > F.lag("last").over(ordered) + 1).cast("int"), F.lit(1))
    numbered = runs.withColumn("block", F.floor(F.col("first") / BLOCK)).withColumn("new", new)
    numbered = numbered.withColumn("run", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("sender", "target", "block", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("sender", "target", "first", "last")


def of_ordinals(runs: DataFrame, ordinals: DataFrame) -> DataFrame:
    """The rows (with ordinal) with their session, null where they have none."""
    held = runs.withColumn("__block", F.floor(F.col("first") / BLOCK))
    asked = ordinals.withColumn("__block", F.floor(F.col("ordinal") / BLOCK))
    found = asked.join(held, (asked["__block"] == held["__block"]) & (F.col("ordinal") >= F.col("first")) & (F.col("ordinal") <= F.col("last")), "left")
    return found.select(*ordinals.columns, "sender", "target")
