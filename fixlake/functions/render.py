"""Messages as text: readable blocks, JSON lines, CSV and raw; and sinks that write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixlake.functions.dictionary import Dictionary, resolve
from fixlake.functions.tokens import fields, tag

CSV_COLUMNS = ("ordinal", "offset", "msg_type", "sender", "target", "seq_num", "sending_time")


def _valid(text: Column) -> Column:
    return F.make_valid_utf8(text)


def resolved(messages: DataFrame, d: Dictionary | None = None) -> DataFrame:
    return resolve(messages.withColumn("tags", fields()), d)


def pretty(messages: DataFrame, d: Dictionary | None = None) -> DataFrame:
    """(ordinal, text): a head line, a line for each field with names in one column, and an empty line."""
    width = F.array_max(F.transform("fields", lambda f: F.coalesce(F.length(f["name"]), F.lit(0))))
    line = lambda f: F.concat(
        F.lit("  "), F.format_string("%5d", f["tag"]), F.lit("  "),
        F.rpad(F.coalesce(f["name"], F.lit("?")), F.greatest(F.col("_w"), F.lit(1)), F.lit(" ")), F.lit(" = "), _valid(f["value"]),
        F.coalesce(F.concat(F.lit(" ("), f["value_label"], F.lit(")")), F.lit("")),
    )
    head = F.concat(F.lit("Message @ offset "), F.col("offset").cast("string"), F.lit(" ("), F.col("raw_len").cast("string"), F.lit(" bytes)"),
                    F.coalesce(F.concat(F.lit(" "), F.col("msg_type_name")), F.lit("")))
    out = resolved(messages, d).withColumn("_w", width)
    return out.select("ordinal", F.concat(head, F.lit("\n"), F.array_join(F.transform("fields", line), "\n"), F.lit("\n")).alias("text"))


def json_text(text: Column) -> Column:
    """A JSON string; control characters but for line ends and tabs as \\u00xx."""
    out = _valid(text)
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    plain = F.concat(F.lit('"'), out, F.lit('"'))
    for code in (*range(1, 9), 11, 12, *range(14, 32)):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.when(text.rlike("[\\x00-\\x1f]"), F.concat(F.lit('"'), out, F.lit('"'))).otherwise(plain)


def jsonl(messages: DataFrame, d: Dictionary | None = None) -> DataFrame:
    """(ordinal, text): {"offset", "raw_len", "msg_type_name" if known, "tags": [{"tag", "name" or null, "value", "value_label" if known}]}."""
    item = lambda f: F.concat(
        F.lit('{"tag":'), f["tag"].cast("string"), F.lit(',"name":'), F.coalesce(json_text(f["name"]), F.lit("null")), F.lit(',"value":'), json_text(f["value"]),
        F.coalesce(F.concat(F.lit(',"value_label":'), json_text(f["value_label"])), F.lit("")), F.lit("}"),
    )
    text = F.concat(
        F.lit('{"offset":'), F.col("offset").cast("string"), F.lit(',"raw_len":'), F.col("raw_len").cast("string"),
        F.coalesce(F.concat(F.lit(',"msg_type_name":'), json_text(F.col("msg_type_name"))), F.lit("")), F.lit(',"tags":['),
        F.array_join(F.transform("fields", item), ","), F.lit("]}"),
    )
    return resolved(messages, d).select("ordinal", text.alias("text"))


def csv_columns() -> list[Column]:
    text = lambda n: F.coalesce(_valid(tag(n)), F.lit(""))
    return [
        F.col("ordinal"), F.col("offset"), text(35).alias("msg_type"), text(49).alias("sender"), text(56).alias("target"), text(34).alias("seq_num"), text(52).alias("sending_time")
    ]


def csv_escape(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\n]'), quoted).otherwise(text)


def csv(messages: DataFrame) -> DataFrame:
    """(ordinal, text), without the header line."""
    rows = messages.select(*csv_columns())
    return rows.select("ordinal", F.concat_ws(",", *[F.col(c).cast("string") if c in ("ordinal", "offset") else csv_escape(F.col(c)) for c in CSV_COLUMNS]).alias("text"))


def fix(messages: DataFrame) -> DataFrame:
    """(ordinal, text): the messages as they are."""
    return messages.select("ordinal", F.col("raw").alias("text"))


FORMATS = {"pretty": pretty, "json": jsonl, "csv": csv, "fix": fix}


def export(messages: DataFrame, kind: str, path: str) -> int:
    """Write a view as text files in the order of ordinals; the number of messages. Raises ValueError for an empty view."""
    n = messages.count()
    if not n:
        raise ValueError("there is nothing to export")
    FORMATS[kind](messages).repartitionByRange("ordinal").sortWithinPartitions("ordinal").select("text").write.option("header", False).text(path)
    return n
