"""Tags of messages, as Column expressions over the columns raw (a message) and sep (its separator).

`fields` gives all tags in order; `tag` gives the first occurrence of one tag straight from the text, which is far cheaper when a query needs only a
few tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAGS = "array<struct<pos:int,tag:bigint,value:string>>"
#: Tags that the analyses read.
PROMOTED = (6, 8, 9, 10, 11, 14, 17, 31, 32, 34, 35, 37, 38, 39, 41, 44, 49, 52, 54, 55, 56, 58, 60, 150, 1128)
#: Tags that messages are looked up by.
HOT = (35, 49, 56, 11, 34, 37, 41)


def _split(text: str) -> str:
    return (
        f"transform(split(left({text}, length({text}) - 1), concat('\\\\Q', sep, '\\\\E'), -1), (x, i) -> named_struct('pos', i,"
        " 'tag', try_cast(substring_index(x, '=', 1) AS BIGINT), 'value', substring(x, instr(x, '=') + 1)))"
    )


def fields() -> Column:
    """array<struct<pos, tag, value>> in the order of the message, repeated tags included; values keep their bytes."""
    wide = _split("decode(CAST(raw AS BINARY), 'ISO-8859-1')")
    return F.expr(
        f"CASE WHEN raw IS NULL THEN NULL WHEN is_valid_utf8(raw) THEN {_split('raw')} ELSE transform({wide}, f -> named_struct('pos', f.pos, 'tag', f.tag,"
        " 'value', CAST(encode(f.value, 'ISO-8859-1') AS STRING))) END"
    )


def tag(number: int) -> Column:
    """The first occurrence's value; null where the message lacks the tag."""
    if number == 8:
        return F.expr("substring_index(substring(raw, 3), sep, 1)")
    key = f"concat(sep, '{number}=')"
    found = f"IF(locate({key}, raw) > 0, substring_index(substring(raw, locate({key}, raw) + {len(str(number)) + 2}), sep, 1), NULL)"
    # leading zeros in tags, and bytes that are no UTF-8, which would put the positions of characters out
    wide = "decode(CAST(raw AS BINARY), 'ISO-8859-1')"
    there = f"concat('\\\\Q', sep, '\\\\E0*{number}=')"
    value = f"regexp_extract({wide}, concat({there}, '([^', IF(sep = '^', '\\\\^', sep), ']*)'), 1)"
    odd = f"IF({wide} RLIKE {there}, CAST(encode({value}, 'ISO-8859-1') AS STRING), NULL)"
    return F.expr(f"IF(locate(concat(sep, '0'), raw) = 0 AND is_valid_utf8(raw), {found}, {odd})")


def first(number: int, tags: str = "tags") -> Column:
    """The first occurrence's value in the tag list."""
    return F.get(F.filter(tags, lambda t: t["tag"] == number), F.lit(0))["value"]


def last(number: int, tags: str = "tags") -> Column:
    return F.try_element_at(F.filter(tags, lambda t: t["tag"] == number), F.lit(-1))["value"]


def stored_tags(messages: DataFrame) -> frozenset[int]:
    """The tags that have columns of their own, in messages that were saved."""
    columns = messages.columns
    return frozenset(n for n in PROMOTED if f"t{n}" in columns) if "repeats" in columns else frozenset()


def read(messages: DataFrame, number: int) -> Column:
    """The first occurrence's value, from the tag's own column where the messages have it."""
    return F.col(f"t{number}") if number in stored_tags(messages) else tag(number)


def taken(messages: DataFrame, keep: list[Column | str], named: dict[str, int]) -> DataFrame:
    """Some columns, and the first occurrences of many tags by name: as `read` of each, but for the places of all tags first, then their values. In one step the code for them all gets longer than the JVM compiles."""
    if stored_tags(messages) >= set(named.values()):
        return messages.select(*keep, *[read(messages, n).alias(c) for c, n in named.items()])
    kept = [F.col(c) if isinstance(c, str) else c for c in keep]
    plain = F.expr("locate(concat(sep, '0'), raw) = 0 AND is_valid_utf8(raw)").alias("_plain")
    rows = messages.select(F.struct(*kept).alias("_kept"), "raw", "sep", plain)
    places = [F.expr(f"IF(_plain, locate(concat(sep, '{n}='), raw), 0)").alias(f"_p{n}") for n in set(named.values())]
    rows = rows.select("*", *places, F.when(~F.col("_plain"), fields()).alias("_f"))
    value = lambda n: F.expr(f"substring_index(substring(raw, _p{n} + {len(str(n)) + 2}), sep, 1)")
    return rows.select("_kept.*", *[F.when(F.col(f"_p{n}") > 0, value(n)).when(~F.col("_plain"), first(n, "_f")).alias(c) for c, n in named.items()])


def occurrences(messages: DataFrame, *numbers: int) -> Column:
    """array<struct<tag, value>>: every occurrence of some tags, those of one tag in order."""
    pair = lambda t: F.struct(t["tag"].alias("tag"), t["value"].alias("value"))
    if not stored_tags(messages) >= set(numbers):
        # fields of other tags are left out before they are taken apart, unless a tag may have leading zeros
        chosen = ", ".join(f"'{n}'" for n in numbers)
        few = "filter(split(left(raw, length(raw) - 1), concat('\\\\Q', sep, '\\\\E'), -1), x -> substring_index(x, '=', 1) IN (" + chosen + "))"
        plain = f"transform({few}, x -> named_struct('tag', try_cast(substring_index(x, '=', 1) AS BIGINT), 'value', substring(x, instr(x, '=') + 1)))"
        return F.when(F.expr("locate(concat(sep, '0'), raw) = 0 AND is_valid_utf8(raw)"), F.expr(plain)).otherwise(F.transform(F.filter(fields(), lambda t: t["tag"].isin(*numbers)), pair))
    firsts = F.array(*[F.when(F.col(f"t{n}").isNotNull(), F.struct(F.lit(n).cast("long").alias("tag"), F.col(f"t{n}").alias("value"))) for n in numbers])
    more = F.when(F.col("repeated"), F.filter("repeats", lambda t: t["tag"].isin(*numbers))).otherwise(F.array().cast("array<struct<tag:bigint,value:string>>"))
    return F.concat(F.filter(firsts, lambda t: t.isNotNull()), F.transform(more, pair))


def final(messages: DataFrame, number: int) -> Column:
    """The last occurrence's value."""
    return F.try_element_at(occurrences(messages, number), F.lit(-1))["value"]


def with_stored(messages: DataFrame) -> DataFrame:
    """Add a column for each promoted tag, `repeats` with their further occurrences, and `repeated`, which says whether there are any."""
    every = messages.withColumn("_f", F.filter(fields(), lambda t: t["tag"].isin(*PROMOTED)))
    named = every.withColumns({f"t{n}": first(n, "_f") for n in PROMOTED})
    further = F.filter("_f", lambda t: F.exists("_f", lambda u: (u["tag"] == t["tag"]) & (u["pos"] < t["pos"])))
    pairs = F.transform(further, lambda t: F.struct(t["tag"].alias("tag"), t["value"].alias("value")))
    return named.withColumn("repeats", F.when(F.size(pairs) > 0, pairs)).withColumn("repeated", F.col("repeats").isNotNull()).drop("_f")


def checksum(text: str = "raw") -> Column:
    """Sum of all bytes before the CheckSum field, modulo 256."""
    wide = f"decode(CAST({text} AS BINARY), 'ISO-8859-1')"
    body = f"left({wide}, greatest(0, length({wide}) - length(substring_index(substring_index({wide}, sep, -2), sep, 1)) - 1))"
    return F.expr(f"aggregate(split({body}, ''), 0, (a, c) -> a + ascii(c)) % 256").cast("int")


def declared_checksum() -> Column:
    """Exactly three digits, up to 255; else null."""
    value = tag(10)
    return F.when(value.rlike("^[0-9]{3}$"), F.when(value.try_cast("int") <= 255, value.try_cast("int")))
