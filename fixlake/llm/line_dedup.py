"""Line dedup by content-defined chunks, in DataFrame functions only.

A text's lines are hashed, and a polynomial rolling hash runs over each two lines in a row. A chunk ends behind a line whose
rolling hash is a local minimum, so that boundaries depend on three neighbouring lines only and fall in the same places
when a passage is shifted; such chunks have two lines at least. A line of `LONG` words or more is as large as
a chunk is meant to be and is one by itself. Chunks of several lines, and such long lines, that occur more than once in all documents
are grouped by their bytes; the occurrence with the smallest (document id, position) stays and the others are removed.

Minima are taken over whole neighbourhoods, so a run of one repeated line has no boundary in it; single short lines, however
common, stay where no chunk around them repeats.

Defined cases: a null text stays null, an empty one empty; chunks without a visible character always stay; rows with the same id count as
one document and agree on what is first, so an exactly repeated row keeps the same text; null ids come last; a text of which
everything is removed becomes empty, its row stays; all other columns are kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a line that is a chunk by itself.
LONG = 50
#: A prime below 2 ** 48, and the base of the rolling hash.
MODULUS = 281474976710597
BASE = 257


def _chunks(text: Column, long: int) -> Column:
    """array<struct<text, n, whole>>: each chunk's text and lines, and whether it may be removed."""
    lines = F.split(text, "\n", -1)
    hashed = F.transform(lines, lambda x: F.struct(
        x.alias("s"),
        F.conv(F.substring(F.md5(x.cast("binary")), 1, 12), 16, 10).cast("long").alias("h"),
        (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1 >= long).alias("long"),
    ))
    return hashed


def with_chunks(df: DataFrame, text: str, out: str, long: int = LONG) -> DataFrame:
    """Add the chunks of each text as `out`: array<struct<text, n, removable>>."""
    df = df.withColumn("__l", _chunks(F.coalesce(F.col(text), F.lit("")), long))
    df = df.withColumn("__r", F.expr(
        f"transform(__l, (x, i) -> (coalesce(get(__l, i - 1).h, 0L) * {BASE}L + x.h) % {MODULUS}L)"
    ))
    df = df.withColumn("__e", F.expr(
        "filter(sequence(0, size(__l) - 1), i -> i = size(__l) - 1 OR get(__l, i).long OR get(__l, i + 1).long"
        " OR (i > 0 AND get(__r, i) < get(__r, i - 1) AND get(__r, i) <= get(__r, i + 1)))"
    ))
    df = df.withColumn("__c", F.expr(
        "transform(__e, (e, i) -> slice(__l, coalesce(get(__e, i - 1), -1) + 2, e - coalesce(get(__e, i - 1), -1)))"
    ))
    df = df.withColumn(out, F.expr(
        "transform(__c, c -> named_struct('text', array_join(transform(c, x -> x.s), '\n'), 'n', size(c),"
        " 'removable', (size(c) > 1 OR c[0].long) AND exists(c, x -> trim(x.s) <> '')))"
    ))
    return df.drop("__l", "__r", "__e", "__c")


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", long: int = LONG, counts: bool = False, emptied: bool = True) -> DataFrame:
    """The rows with repeated chunks removed from the text; with `counts`, also n_removed. Without `emptied`, rows of which nothing but line ends is left go."""
    columns = df.columns
    named = df.withColumn("__id", F.xxhash64(F.col(key), F.col(text)))
    cut = with_chunks(named.select(key, text, "__id"), text, "__chunks", long)
    order = F.coalesce(F.col(key).cast("decimal(20,0)"), F.lit(9223372036854775807).cast("decimal(20,0)")) * F.lit(1000000000).cast("decimal(10,0)")
    seen = (
        cut.select(F.col(key).alias("__key"), "__id", F.posexplode_outer("__chunks").alias("__pos", "__chunk"), order.alias("__order"))
        .where("__chunk.removable")
        .select("__key", "__id", "__pos", (F.col("__order") + F.col("__pos")).cast("decimal(38,0)").alias("__at"), F.col("__chunk.text").alias("__text"))
        .withColumn("__h", F.xxhash64("__text"))
    )
    # grouped by bytes, not by hash
    repeated = seen.groupBy("__text").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    repeated = repeated.select(F.xxhash64("__text").alias("__h"), "__first", F.col("__text").alias("__same"))
    marks = seen.drop("__text").join(repeated, "__h").where("__at > __first")
    marks = marks.groupBy("__id", "__key").agg(F.collect_set(F.struct("__pos", "__same")).alias("__marks"))
    marks = marks.withColumnRenamed("__id", "__id2")
    joined = named.join(marks, (F.col("__id") == F.col("__id2")) & F.col(key).eqNullSafe(F.col("__key")), "left")
    touched = F.col("__marks").isNotNull()
    # the bytes are compared once more where a mark meets its own text
    kept = with_chunks(joined.withColumn("__t", F.when(touched, F.col(text))), "__t", "__chunks", long)
    kept = kept.withColumn("__kept", F.when(touched, F.expr(
        "filter(transform(__chunks, (c, i) -> named_struct('text', c.text, 'gone', c.removable AND"
        " exists(__marks, m -> m.__pos = i AND m.__same = c.text))), x -> NOT x.gone)"
    )))
    cleaned = F.when(touched, F.array_join(F.transform("__kept", lambda x: x["text"]), "\n")).otherwise(F.col(text))
    gone = F.when(touched, F.size("__chunks") - F.size("__kept")).otherwise(0)
    out = kept.select(*[cleaned.alias(text) if c == text else F.col(f"`{c}`") for c in columns], gone.cast("long").alias("__gone"))
    if not emptied:
        # what a generator makes is not computed once more in the filter above it
        rest = [F.col(f"`{c}`") for c in columns if c != text]
        out = out.select(*rest, F.inline(F.array(F.struct(F.col(text).alias("__text"), F.col("__gone").alias("__gone")))))
        out = out.where((F.col("__gone") == 0) | (F.replace(F.col("__text"), F.lit("\n"), F.lit("")) != ""))
        out = out.select(*[F.col("__text").alias(text) if c == text else F.col(f"`{c}`") for c in columns], "__gone")
    return out.withColumnRenamed("__gone", "n_removed") if counts else out.drop("__gone")


#: The same by window functions, for DuckDB.
SQL = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS s
  FROM documents WHERE text IS NOT NULL),
hashed AS (
  SELECT *, ('0x' || substr(md5(s), 1, 12))::BIGINT AS h, length(s) - length(replace(s, ' ', '')) + 1 >= {LONG} AS big FROM lines),
rolled AS (
  SELECT *, (coalesce(lag(h) OVER w, 0) * {BASE} + h) % {MODULUS} AS r, lead(big) OVER w AS big_next FROM hashed
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ends AS (
  SELECT *, big_next IS NULL OR big OR big_next OR (i > 0 AND r < lag(r) OVER w AND r <= lead(r) OVER w) AS is_end FROM rolled
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (
  SELECT *, sum(is_end::INT) OVER (PARTITION BY doc_id ORDER BY i) - is_end::INT AS c FROM ends),
chunks AS (
  SELECT doc_id, c, string_agg(s, chr(10) ORDER BY i) AS body,
    (count(*) > 1 OR bool_or(big)) AND bool_or(trim(s) <> '') AS removable FROM numbered GROUP BY doc_id, c),
ranked AS (
  SELECT *, removable AND row_number() OVER (PARTITION BY removable, body ORDER BY doc_id, c) > 1 AS gone FROM chunks)
SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY c) FILTER (NOT gone), '') AS text,
  sum(gone::INT)::BIGINT AS n_removed
FROM ranked GROUP BY doc_id
"""
