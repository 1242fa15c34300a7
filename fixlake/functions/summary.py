"""One-line summaries of messages, as Column expressions over raw and sep."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fixlake.functions.dictionary import SIDES, Dictionary, builtin, chain_column, label_column, message_name_column
from fixlake.functions.tokens import tag

#: Characters of a reject's text that are shown.
TEXT = 60
#: Tags that a detail view can hide.
COMMON = (8, 9, 10, 34, 35, 49, 52, 56)


def format_qty(text: Column) -> Column:
    """Thousands separators in the whole part; sign and fraction stay, and so does anything that is no number."""
    whole = F.substring_index(text, ".", 1)
    grouped = F.regexp_replace(whole, "(?<=[0-9])(?=(?:[0-9]{3})+$)", ",")
    return F.when(whole.rlike("^[+-]?[0-9]+$"), F.concat(grouped, F.substring(text, F.length(whole) + 1, F.length(text)))).otherwise(text)


def _labelled(number: int, chain: Column, d: Dictionary) -> Column:
    return F.coalesce(label_column(F.lit(number), tag(number), chain, d), tag(number))


def order_detail(chain: Column, d: Dictionary, price: bool) -> Column:
    """Side, quantity, symbol and perhaps `@ price`; parts that a message lacks are left out, null if it lacks all."""
    at = F.concat(F.lit("@ "), tag(44)) if price else F.lit(None).cast("string")
    return F.nullif(F.concat_ws(" ", _labelled(54, chain, d), format_qty(tag(38)), tag(55), at), F.lit(""))


def detail(chain: Column | None = None, d: Dictionary | None = None) -> Column:
    """What a message says, by its type."""
    chain, d, kind = chain if chain is not None else chain_column(), d or builtin(), tag(35)
    return (
        F.when(kind.isin("8", "F"), order_detail(chain, d, False)).when(kind.isin("3", "j"), reject_text())
        .when(kind.isin("A", "5", "0", "1", "2"), F.lit(None).cast("string")).otherwise(order_detail(chain, d, True))
    )


def reject_text() -> Column:
    return F.when(F.length(tag(58)) > TEXT, F.concat(F.left(tag(58), F.lit(TEXT)), F.lit("…"))).otherwise(tag(58))


def badges(chain: Column | None = None, d: Dictionary | None = None) -> Column:
    """array<string>: an execution report's type and status by name; empty for other messages."""
    chain, d = chain if chain is not None else chain_column(), d or builtin()
    both = F.array_compact(F.array(_labelled(150, chain, d), _labelled(39, chain, d)))
    return F.when(tag(35) == "8", both).otherwise(F.array().cast("array<string>"))


def list_row(d: Dictionary | None = None) -> list[Column]:
    """Columns of a list view: time, message, clordid, status, detail."""
    d, chain = d or builtin(), chain_column(application=F.lit(None).cast("string"))
    time = F.when(F.instr(tag(52), "-") > 0, F.left(F.substring(tag(52), F.instr(tag(52), "-") + 1, F.lit(8)), F.lit(8)))
    return [
        time.alias("time"), F.coalesce(message_name_column(tag(35), chain, d), tag(35)).alias("message"), tag(11).alias("clordid"),
        F.array_join(badges(chain, d), " · ").alias("status"), detail(chain, d).alias("detail"),
    ]


def pad_cell(text: Column, width: int) -> Column:
    return F.rpad(text, width, " ")


def truncate(text: Column, width: int) -> Column:
    """At most `width` characters, the last one an ellipsis where some are cut."""
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(max(0, width - 1))), F.lit("…"))).otherwise(text)


def side_label(side: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SIDES.items() for x in kv]), side), F.when(side.isNotNull(), F.lit("?")))


def status_label(status: Column, d: Dictionary | None = None) -> Column:
    return F.coalesce(label_column(F.lit(39), status, F.array(F.lit("FIX44")), d or builtin()), status)


def family_display(family: Column) -> Column:
    return F.array_join(F.array_sort(family), "→")


def format_int(n: Column) -> Column:
    return F.format_number(n.cast("decimal(20,0)"), 0)


def format_money(n: Column) -> Column:
    return F.format_number(n, 2)


def format_price(n: Column) -> Column:
    return F.when(n == 0, F.lit("-")).otherwise(F.format_string("%.4f", n))


def utc_time(ns: Column) -> Column:
    """YYYY-MM-DD HH:MM:SS, whatever the session's time zone."""
    seconds = F.floor(ns / 1_000_000_000).cast("long")
    day = F.date_from_unix_date(F.floor(seconds / 86400).cast("int")).cast("string")
    part = lambda of, size: F.lpad((F.floor(seconds / of) % size).cast("string"), 2, "0")
    return F.concat(day, F.lit(" "), part(3600, 24), F.lit(":"), part(60, 60), F.lit(":"), part(1, 60))


def raw_display(raw: Column) -> Column:
    """Printable ASCII: SOH as a bar, anything else that does not print as a point."""
    return F.regexp_replace(F.translate(raw, "\x01", "|"), "[^ -~]", ".")


def without_common(tags: str = "tags") -> Column:
    return F.filter(tags, lambda t: ~t["tag"].isin(*COMMON))


def severity() -> Column:
    """A colour's meaning: reject, trade, cancel, session or normal."""
    return (
        F.when(tag(35).isin("3", "j", "9") | (tag(150) == "8") | (tag(39) == "8"), "reject").when(tag(150).isin("F", "1", "2"), "trade")
        .when(tag(35).isin("F", "G") | tag(150).isin("4", "5"), "cancel").when(tag(35).isin("A", "5", "0", "1", "2"), "session").otherwise("normal")
    )
