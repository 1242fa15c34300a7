"""Views of messages: filtered, ordered, searched and compared."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixlake.functions.graph import checkpointed, written
from fixlake.functions.tokens import HOT, fields, read, stored_tags
from fixlake.functions.values import u32
from fixlake.operators.stats import postings
from fixlake.plans.dsl import compose, hot_equalities, parse, to_column


def filtered(messages: DataFrame, user: str | None, hide_heartbeats: bool = False) -> DataFrame:
    effective = compose(user, hide_heartbeats)
    return messages.where(to_column(effective, stored=stored_tags(messages))) if effective else messages


def by_postings(messages: DataFrame, looked_up: DataFrame, user: str) -> DataFrame:
    """As filtered, for a conjunction of equalities on hot tags by postings (tag, value, ordinal); other filters scan. Of saved postings only the buckets of the filter's values are read,
    and joined. Others are made in one pass for all values; if the rarest one has up to LOOKUP, what is left of its ordinals goes to the scan of the messages, which frames no others then, else they are joined."""
    pairs = hot_equalities(parse(user))
    if pairs is None:
        return filtered(messages, user)
    pairs = list(dict.fromkeys(pairs))
    holds = [(F.col("tag") == number) & (F.col("value") == value) for number, value in pairs]
    if "bucket" in looked_up.columns:
        for one, (number, value) in zip(holds, pairs, strict=True):
            hits = looked_up.where(one & (F.col("bucket") == bucket(F.lit(number), F.lit(value))))
            messages = messages.join(hits.select("ordinal"), "ordinal", "left_semi")
        return messages
    which = F.coalesce(*[F.when(one, F.lit(i)) for i, one in enumerate(holds)])
    hits = written(looked_up.where(reduce(or_, holds)).select(which.alias("pair"), "ordinal"))
    counts = {r["pair"]: r["n"] for r in hits.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(range(len(pairs)), key=lambda i: counts.get(i, 0))
    if counts.get(order[0], 0) > LOOKUP:
        for i in order:
            messages = messages.join(hits.where(F.col("pair") == i).select("ordinal"), "ordinal", "left_semi")
        return messages
    found = None
    for i in order:
        rows = hits.where(F.col("pair") == i)
        rows = rows if found is None else rows.where(F.col("ordinal").isin(found))
        found = sorted({r["ordinal"] for r in rows.select("ordinal").collect()})
    return messages.where(F.col("ordinal").isin(found))


def index(messages: DataFrame, hot: tuple[int, ...] = HOT) -> DataFrame:
    return postings(messages, hot)


#: Ordinals that are looked up in the scan.
LOOKUP = 10_000
#: Folders of saved postings, and tasks that share one, as a frequent value is in one folder.
BUCKETS, SHARED = 64, 16


def bucket(number: Column, value: Column) -> Column:
    return F.pmod(F.xxhash64(number.cast("long"), value), F.lit(BUCKETS)).cast("int")


def save_index(messages: DataFrame, folder: str, hot: tuple[int, ...] = HOT) -> DataFrame:
    """Write the postings, in folders by a hash of tag and value, and read them from there."""
    rows = index(messages, hot).withColumn("bucket", bucket(F.col("tag"), F.col("value")))
    rows = rows.repartition("bucket", F.pmod("ordinal", F.lit(SHARED))).sortWithinPartitions("bucket", "tag", "value", "ordinal")
    rows.write.partitionBy("bucket").parquet(folder)
    return messages.sparkSession.read.schema("tag long, value string, ordinal long, bucket int").parquet(folder)


#: Orders of a view: by position, sequence number, TransactTime and SendingTime; what a message lacks comes last.
SORTS = {"natural": None, "seq": lambda m: u32(read(m, 34)), "transact": lambda m: read(m, 60), "sending": lambda m: read(m, 52)}
CYCLE = tuple(SORTS)


def sort_key(messages: DataFrame, by: str) -> list[Column]:
    key = SORTS[by]
    return [F.col("ordinal")] if key is None else [key(messages).asc_nulls_last(), F.col("ordinal")]


def ordered(messages: DataFrame, by: str = "natural") -> DataFrame:
    return messages.orderBy(*sort_key(messages, by))


def ranked(messages: DataFrame, by: str = "natural", parts: int | None = None) -> DataFrame:
    """Add rank, each message's place in the order of a view, from 0."""
    return placed(messages, sort_key(messages, by), parts)


def placed(rows: DataFrame, key: list[Column], parts: int | None = None) -> DataFrame:
    """Add rank, each row's place in the order of a key, from 0. Rows are dealt to tasks by ranges of the key; a range's first rank comes from the sizes of
    those before it, so that no task has all rows."""
    dealt = checkpointed((rows.repartitionByRange(parts, *key) if parts else rows.repartitionByRange(*key)).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))  # a row for each task
    first = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*key))
    return dealt.withColumn("_in", inside).join(F.broadcast(first), "_part").withColumn("rank", F.col("_first") + F.col("_in") - 1).drop("_part", "_first", "_in")


def first(messages: DataFrame, n: int) -> DataFrame:
    return messages.orderBy("ordinal").limit(n)


def search(messages: DataFrame, query: str, current: int, forward: bool = True) -> DataFrame:
    """(ordinal, wrapped): the next match after, or before, the current message in natural order, or else the one found from the other end; the
    current message itself does not count. No row without a match."""
    hits = filtered(messages, query).where(F.col("ordinal") != current).select("ordinal")
    beyond = F.col("ordinal") > current if forward else F.col("ordinal") < current
    pick = F.min if forward else F.max
    found = hits.agg(pick(F.when(beyond, F.col("ordinal"))).alias("near"), pick("ordinal").alias("far"))
    return found.where("far IS NOT NULL").select(F.coalesce("near", "far").alias("ordinal"), F.col("near").isNull().alias("wrapped"))


def message(messages: DataFrame, ordinal: int) -> DataFrame:
    return messages.where(F.col("ordinal") == ordinal)


def diff(messages: DataFrame, a: int, b: int) -> DataFrame:
    """(tag, a, b, status) of two messages by tag, its last occurrence counts: equal, different, only_a or only_b."""

    def of(ordinal: int, name: str) -> DataFrame:
        rows = message(messages, ordinal).select(F.explode(fields()).alias("t")).select("t.tag", "t.pos", "t.value")
        return rows.groupBy("tag").agg(F.max_by("value", "pos").alias(name))

    both = of(a, "a").join(of(b, "b"), "tag", "full")
    status = F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").when(F.col("a") == F.col("b"), "equal").otherwise("different")
    return both.withColumn("status", status)


def within(messages: DataFrame, ordinals: DataFrame) -> DataFrame:
    """The messages of a view that other rows (ordinal) point to."""
    return messages.join(ordinals.select("ordinal"), "ordinal", "left_semi")


def union_all(*views: DataFrame) -> DataFrame:
    """Sources in the order given, renumbered on."""
    out = None
    for i, view in enumerate(views):
        view = view.withColumn("source_idx", F.lit(i))
        if out is not None:
            shift = out.agg(F.coalesce(F.max("ordinal") + 1, F.lit(0)).alias("_s"))  # one row
            view = view.crossJoin(F.broadcast(shift)).withColumn("ordinal", F.col("ordinal") + F.col("_s")).drop("_s")
        out = view if out is None else out.unionByName(view)
    return out


class Bookmarks:
    """Named messages of a view."""

    def __init__(self):
        self.at: dict[str, int] = {}

    def mark(self, name: str, ordinal: int) -> None:
        if name not in "0123456789" or len(name) != 1:
            raise ValueError("a bookmark is a digit")
        self.at[name] = ordinal

    def jump(self, view: DataFrame, name: str) -> DataFrame:
        """The bookmarked message, if it is in the view."""
        return message(view, self.at.get(name, -1))
