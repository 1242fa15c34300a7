"""Sessions, timelines and consolidated orders as text: tables to read, CSV and JSON.

Each report is a DataFrame of one line a row, (line, text), to be ordered by line; lines are made by Column expressions and numbered by the order of the report. Heads, widths and keys are fixed values of the formats. Amounts in CSV and JSON are rounded as decimals, halves away from zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixlake.functions.dictionary import Dictionary
from fixlake.functions.render import csv_escape, json_text, resolved
from fixlake.functions.summary import family_display, format_int, format_money, format_price, raw_display, side_label, status_label, truncate, without_common
from fixlake.operators import consolidate, orders, sessions
from fixlake.operators.views import placed

#: Columns of a timeline's bar.
BAR = 60


def _lines(rows: DataFrame, order: list[Column], text: Column, head: list[str] = [], last: list[str] = [], between: str = "") -> DataFrame:  # noqa: B006
    """Rows as lines, behind the head's and before the last ones, each but the last with what stands between two. Places come from ranges of the order, so that no task has all lines."""
    spark, ranked = rows.sparkSession, placed(rows, order)
    if between:
        ranked = ranked.crossJoin(F.broadcast(ranked.agg(F.max("rank").alias("__end"))))  # one row
        text = F.concat(text, F.when(F.col("rank") < F.col("__end"), between).otherwise(""))
    body = ranked.select((F.col("rank") + 1).cast("long").alias("line"), text.alias("text"))
    framed = [(i - len(head), t) for i, t in enumerate(head)] + [((1 << 62) + i, t) for i, t in enumerate(last)]
    return body.unionByName(spark.createDataFrame(framed, "line long, text string")) if framed else body


def _dash(value: Column) -> Column:
    return F.coalesce(value, F.lit("-"))


def session_rows(messages: DataFrame) -> DataFrame:
    """The sessions with their gaps: array<struct<from_seq, to_seq, ordinal_before, ordinal_after>> in the order of directions and numbers."""
    gap = F.struct("direction", "from_seq", "to_seq", "ordinal_before", "ordinal_after")
    gaps = sessions.seq_gaps(messages).groupBy("sender", "target").agg(F.array_sort(F.collect_list(gap)).alias("gaps"))
    found = sessions.sessions(messages).join(gaps, ["sender", "target"], "left")
    return found.withColumn("gaps", F.coalesce("gaps", F.array().cast("array<struct<direction:string,from_seq:bigint,to_seq:bigint,ordinal_before:bigint,ordinal_after:bigint>>")))


def sessions_pretty(messages: DataFrame) -> DataFrame:
    span = F.when(F.col("seq_min").isNotNull(), F.concat_ws("..", "seq_min", "seq_max"))
    text = F.format_string(
        "%-32s %8d %18s %16s %6d", truncate(F.concat_ws(" ↔ ", "sender", "target"), 32), F.col("in_count") + F.col("out_count"),
        truncate(sessions.top_types(F.col("by_msg_type")), 18), _dash(span), F.size("gaps"),
    )
    head = ["%-32s %8s %18s %16s %6s" % ("session", "msgs", "by-msg-type", "seq-range", "gaps"), "-" * 84]
    return _lines(session_rows(messages), [F.col("sender"), F.col("target")], text, head)


def sessions_json(messages: DataFrame) -> DataFrame:
    kinds = F.transform(F.array_sort(F.map_entries("by_msg_type")), lambda e: F.concat(json_text(e["key"]), F.lit(":"), e["value"].cast("string")))
    gaps = F.transform("gaps", lambda g: F.format_string(
        '{"from_seq":%d,"to_seq":%d,"ordinal_before":%d,"ordinal_after":%d}', g["from_seq"], g["to_seq"], g["ordinal_before"], g["ordinal_after"]
    ))
    span = F.coalesce(F.format_string(',"seq_min":%d,"seq_max":%d', F.col("seq_min"), F.col("seq_max")), F.lit(""))
    text = F.concat(
        F.lit('{"sender":'), json_text(F.col("sender")), F.lit(',"target":'), json_text(F.col("target")), F.format_string(',"in_count":%d,"out_count":%d', "in_count", "out_count"),
        F.lit(',"by_msg_type":{'), F.array_join(kinds, ","), F.lit("}"), F.when(F.col("seq_min").isNotNull(), span).otherwise(F.lit("")),
        F.lit(',"gaps":['), F.array_join(gaps, ","), F.lit("]}"),
    )
    return _lines(session_rows(messages), [F.col("sender"), F.col("target")], text)


def order_counts_pretty(counts: DataFrame) -> DataFrame:
    head = ["%-40s %8s" % ("clordid", "events"), "-" * 49]
    return _lines(counts, [F.desc("events"), F.col("clordid")], F.format_string("%-40s %8d", truncate(F.col("clordid"), 40), "events"), head)


def order_counts_json(counts: DataFrame) -> DataFrame:
    text = F.concat(F.lit('{"clordid":'), json_text(F.col("clordid")), F.lit(',"events":'), F.col("events").cast("string"), F.lit("}"))
    return _lines(counts, [F.desc("events"), F.col("clordid")], text)


def timeline_pretty(messages: DataFrame, clordid: str) -> DataFrame:
    """A timeline is as long as an order's own messages; its identifiers and number of events go into the head."""
    events = orders.timeline(messages, clordid)
    ids = [r["order_id"] for r in orders.order_ids(events).collect()]
    text = F.format_string("%8d  %6s  %8s  %8s  %8s", "ordinal", "msg_type", _dash(F.col("exec_type")), _dash(F.col("ord_status")), _dash(F.col("cum_qty")))
    head = [
        f"ClOrdID: {clordid}   OrderID(s): [{', '.join(ids)}]   events: {events.count()}", "", "%8s  %6s  %8s  %8s  %8s" % ("ordinal", "type", "exec", "status", "cum-qty"),
        "-" * 46,
    ]
    last = ["", f"Gantt ({BAR} cols, N=D X=8 C=F R=G !=3/j ?=other):", f"  {orders.gantt(events, BAR)}"]
    return _lines(events, [F.col("ordinal")], text, head, last)


def timeline_json(messages: DataFrame, clordid: str) -> DataFrame:
    """One object: the identifier, its OrderIDs and its events."""
    part = lambda c: F.coalesce(F.concat(F.lit(f',"{c}":'), json_text(F.col(c))), F.lit(""))
    text = F.concat(F.lit('{"ordinal":'), F.col("ordinal").cast("string"), F.lit(',"msg_type":'), json_text(F.col("msg_type")), *map(part, ("exec_type", "ord_status", "cum_qty")), F.lit("}"))
    events = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", text.alias("text")))), lambda x: x["text"]), ",")
    ids = F.array_join(F.transform(F.array_sort(F.collect_set("order_id")), json_text), ",")
    whole = F.concat(F.lit('{"clordid":'), json_text(F.lit(clordid)), F.lit(',"order_ids":['), ids, F.lit('],"events":['), events, F.lit("]}"))
    return orders.timeline(messages, clordid).agg(whole.alias("text")).select(F.lit(1).cast("long").alias("line"), "text")


def consolidated_pretty(found: DataFrame, by: str = "notional") -> DataFrame:
    text = F.format_string(
        "%-18s %-5s %-8s %10s %10s %15s %10s %-14s %5d", truncate(family_display(F.col("family")), 18), _dash(side_label(F.col("side"))), truncate(_dash(F.col("symbol")), 8),
        _dash(format_int(F.col("order_qty"))), format_int(F.col("cum_qty")), format_money(F.col("notional")), format_price(F.col("avg_px")),
        truncate(_dash(status_label(F.col("final_ord_status"))), 14), "fills",
    )
    names = ("ClOrdID", "Side", "Symbol", "OrderQty", "CumQty", "Notional", "AvgPx", "Status", "Fills")
    return _lines(found, consolidate.sort_key(by), text, ["%-18s %-5s %-8s %10s %10s %15s %10s %-14s %5s" % names, "-" * 103])


def _whole(n: Column) -> Column:
    return n.cast("decimal(20,0)").cast("string")


def _four(value: Column, plain: Column) -> Column:
    """Four places of a decimal, halves away from zero; what decimals can't hold as it is."""
    return F.coalesce(F.round(value, 4).try_cast("decimal(32,4)").cast("string"), F.format_string("%.4f", plain))


def _amounts() -> tuple[Column, Column]:
    """Notional and average price with four places; the price from the notional and not from its own rounded quotient."""
    notional = F.round(F.col("notional").try_cast("decimal(28,10)"), 6)  # the digits that a double has of such amounts
    price = F.when(F.col("cum_qty") > 0, notional / F.col("cum_qty").cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(28,10)"))
    return _four(notional, F.col("notional")), _four(price, F.col("avg_px"))


def consolidated_csv(found: DataFrame, by: str = "notional") -> DataFrame:
    empty = lambda c: F.coalesce(c, F.lit(""))
    text = F.concat_ws(
        ",", csv_escape(F.col("root_clordid")), csv_escape(F.array_join("family", "|")), empty(side_label(F.col("side"))), csv_escape(empty(F.col("symbol"))),
        empty(_whole(F.col("order_qty"))), _whole(F.col("cum_qty")), *_amounts(), F.col("fills").cast("string"),
        csv_escape(empty(status_label(F.col("final_ord_status")))),
    )
    return _lines(found, consolidate.sort_key(by), text, ["root_clordid,family,side,symbol,order_qty,cum_qty,notional,avg_px,fills,final_ord_status"])


def consolidated_json(found: DataFrame, by: str = "notional") -> DataFrame:
    """The objects of an array, one a line; a comma follows each but the last."""
    part = lambda name, value: F.coalesce(F.concat(F.lit(f',"{name}":'), value), F.lit(""))
    text = F.concat(
        F.lit('{"root_clordid":'), json_text(F.col("root_clordid")), F.lit(',"family":['), F.array_join(F.transform("family", json_text), ","), F.lit("]"),
        part("symbol", json_text(F.col("symbol"))), part("side", json_text(side_label(F.col("side")))), part("order_qty", _whole(F.col("order_qty"))),
        F.lit(',"cum_qty":'), _whole(F.col("cum_qty")), F.lit(',"notional":'), _amounts()[0], F.lit(',"avg_px":'), _amounts()[1], F.format_string(',"fills":%d', "fills"),
        part("final_ord_status", json_text(status_label(F.col("final_ord_status")))), F.lit("}"),
    )
    return _lines(found, consolidate.sort_key(by), text, ["["], ["]"], ",")


def detail_table(messages: DataFrame, d: Dictionary | None = None, hide_common: bool = False) -> DataFrame:
    """(ordinal, pos, tag, name, type, raw, decoded): the fields of messages; names of fields within a repeating group are indented."""
    rows = resolved(messages, d)
    if hide_common:
        rows = rows.withColumn("fields", without_common("fields"))
    name = F.concat(F.when(F.col("f.depth") > 0, "└ ").otherwise(""), F.coalesce("f.name", F.lit("?")))
    return rows.select("ordinal", F.explode("fields").alias("f")).select(
        "ordinal", "f.pos", "f.tag", name.alias("name"), F.coalesce("f.field_type", F.lit("")).alias("type"), raw_display(F.col("f.value")).alias("raw"),
        F.coalesce("f.value_label", F.lit("")).alias("decoded"),
    )


def summary_table(spark: SparkSession, rows: list[tuple[str, object]], width: int) -> DataFrame:
    """Named values, one a line, names as wide as this."""
    return spark.createDataFrame([(i, f"{name + ':':<{width}}{value}") for i, (name, value) in enumerate(rows)], "line long, text string")
