"""Command line: python -m fixlake.cli COMMAND ...

    sniff FILE                                              the layout of a log
    parse FILE [--first N] [--format pretty|json]           its messages
    stats FILE                                              counts of messages, errors, sessions and types
    grep FILE --filter EXPR [--format ...] [-F]             the messages that a filter takes; -F goes on as the file grows
    sessions FILE [--format ...]                            traffic by pairs, with gaps
    orders FILE [--id CLORDID] [--limit N] [--format ...]   order identifiers by events, or one order's timeline
    orders consolidate FILE... [--format ...] [--sort ...]  one row for each family of orders, over all files
    histogram FILE [--bucket 1s] [--width 80] [--peaks 5]   messages over time

FILE is a plain or gzip file, a folder or a pattern, or - for standard input. The exit status is 0, 1 where nothing was found or the input can't be read, and 2 for wrong usage.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixlake.functions import render, reports
from fixlake.functions.values import human_duration, parse_duration
from fixlake.operators import consolidate, histogram, stats, views
from fixlake.operators.orders import timeline
from fixlake.plans.dsl import QueryError, parse
from fixlake.sources.layout import SniffError
from fixlake.sources.log import read_log
from fixlake.streaming.tail import decided, follow

# How layouts are named
SEPARATORS = {"\x01": "SOH (0x01)", "|": "| (0x7C)", "^": "^ (0x5E)", ";": "; (0x3B)"}
ENDINGS = {"lf": "LF (\\n)", "crlf": "CRLF (\\r\\n)"}


def arguments(argv: list[str]) -> argparse.Namespace:
    if argv[:2] == ["orders", "consolidate"]:
        argv = ["consolidate", *argv[2:]]
    parser = argparse.ArgumentParser(prog="fixlake", description="Look into FIX logs.")
    every = parser.add_subparsers(dest="command", required=True)

    def command(name: str, many: bool = False, formats: tuple[str, ...] = ()) -> argparse.ArgumentParser:
        one = every.add_parser(name)
        one.add_argument("file", nargs="+" if many else None)
        if formats:
            one.add_argument("--format", choices=formats, default="pretty")
        return one

    command("sniff")
    command("parse", formats=("pretty", "json")).add_argument("--first", type=int)
    command("stats")
    grep = command("grep", formats=("pretty", "json"))
    grep.add_argument("--filter", required=True)
    grep.add_argument("-F", "--follow", action="store_true")
    command("sessions", formats=("pretty", "json"))
    orders = command("orders", formats=("pretty", "json"))
    orders.add_argument("--id")
    orders.add_argument("--limit", type=int, default=20)
    command("consolidate", many=True, formats=("pretty", "csv", "json")).add_argument("--sort", choices=("notional", "cum-qty", "fills", "recent"), default="notional")
    bars = command("histogram")
    bars.add_argument("--bucket", default="1s")
    bars.add_argument("--width", type=int, default=80)
    bars.add_argument("--peaks", type=int, default=5)
    return parser.parse_args(argv)


def shown(lines: DataFrame, by: str = "line") -> int:
    """Print a column of text, in order, a partition at a time; the number of rows."""
    n = 0
    for row in lines.orderBy(by).select("text").toLocalIterator():
        print(row["text"])
        n += 1
    return n


def run(spark: SparkSession, argv: list[str]) -> int:
    args = arguments(argv)
    try:
        return globals()[f"_{args.command}"](spark, args)
    except (QueryError, SniffError, ValueError, OSError, PySparkException) as error:
        print(f"fixlake: {'parsing filter: ' if isinstance(error, QueryError) else ''}{error}", file=sys.stderr)
        return 1


def _sniff(spark, args) -> int:
    fmt = read_log(spark, args.file).format
    prefix = f"fixed {fmt.prefix_len} bytes" if fmt.prefix_len else "none"
    rows = [("File", args.file), ("Separator", SEPARATORS.get(fmt.separator, "custom")), ("Line prefix", prefix), ("Line ending", ENDINGS[fmt.line_ending]),
            ("Encoding", "UTF-8 / ASCII"), ("Msg boundary", fmt.boundary)]
    return 0 if shown(reports.summary_table(spark, rows, 16)) else 1


def _parse(spark, args) -> int:
    messages = read_log(spark, args.file).messages
    shown(render.FORMATS[args.format](views.first(messages, args.first) if args.first is not None else messages), "ordinal")
    return 0


def _stats(spark, args) -> int:
    log = read_log(spark, args.file)
    total, pairs = stats.totals(log.messages, log.errors).first(), stats.session_pairs(log.messages)
    rows = [("File", args.file), ("Messages parsed", total["messages"]), ("Parse errors", total["errors"])]
    rows += [("Time range", f"{total['min_time']} .. {total['max_time']}")] if total["min_time"] is not None else []
    shown(reports.summary_table(spark, [*rows, ("Sessions", pairs.count())], 17))
    shown(pairs.select(F.struct(-F.col("n"), "sender", "target").alias("line"), F.format_string("  %10d  %s → %s", "n", "sender", "target").alias("text")))
    kinds = stats.message_types(log.messages)
    print("Message types:")
    shown(kinds.select(F.struct(-F.col("n"), "msg_type").alias("line"), F.format_string("  %10d  %-4s %s", "n", "msg_type", F.coalesce("label", F.lit(""))).alias("text")))
    return 0


def _grep(spark, args) -> int:
    parse(args.filter)
    log = read_log(spark, args.file)
    # the first pass ends where the stream begins, so that what is written meanwhile is shown once
    end = decided(args.file, 0, log.format.separator) if args.follow else None
    there = log.messages if end is None else log.messages.where(F.col("offset") < end)
    found = shown(render.FORMATS[args.format](views.filtered(there, args.filter)), "ordinal")
    if args.follow:
        show = lambda batch, _: shown(render.FORMATS[args.format](batch.withColumns({"ordinal": F.col("offset"), "raw_len": F.octet_length("raw").cast("long")})), "ordinal")
        follow(spark, args.file, args.filter, log.format.separator, str(end)).writeStream.foreachBatch(show).start().awaitTermination()
    return 0 if found else 1


def _sessions(spark, args) -> int:
    lines = {"pretty": reports.sessions_pretty, "json": reports.sessions_json}[args.format](read_log(spark, args.file).messages)
    return _unless_empty(lines, "(no sessions)" if args.format == "pretty" else None)


def _orders(spark, args) -> int:
    messages = read_log(spark, args.file).messages
    if args.id is None:
        lines = {"pretty": reports.order_counts_pretty, "json": reports.order_counts_json}[args.format](stats.order_counts(messages, args.limit))
        return _unless_empty(lines, "(no orders)" if args.format == "pretty" else None)
    if timeline(messages, args.id).isEmpty():
        raise ValueError(f"no events found for ClOrdID={args.id}")
    shown({"pretty": reports.timeline_pretty, "json": reports.timeline_json}[args.format](messages, args.id))
    return 0


def _consolidate(spark, args) -> int:
    found = consolidate.consolidated(read_log(spark, args.file).messages)
    lines = {"pretty": reports.consolidated_pretty, "csv": reports.consolidated_csv, "json": reports.consolidated_json}[args.format](found, args.sort.replace("-", "_"))
    return _unless_empty(lines, "(no orders)" if args.format == "pretty" else None)


def _unless_empty(lines: DataFrame, instead: str | None) -> int:
    """Print a report; one without a line of its own is empty, and has the exit status 1."""
    if lines.where(F.col("line").between(1, (1 << 62) - 1)).isEmpty():
        print(instead) if instead else shown(lines)
        return 1
    shown(lines)
    return 0


def _histogram(spark, args) -> int:
    bucket = parse_duration(args.bucket)
    if not bucket:
        raise ValueError(f"no duration: {args.bucket}")
    messages = read_log(spark, args.file).messages
    bins = histogram.histogram(messages, bucket)
    total, lost = histogram.total(bins).first()["total"], histogram.dropped(messages).first()[0]
    print(f"messages: {total}   without time: {lost}   bins: {bins.count()}\nbucket: {human_duration(bucket)}")
    if not total:
        print("(no timestamped messages)")
        return 1
    print(histogram.sparkline(bins, args.width), "", f"top {args.peaks} peaks (count · start_ns):", sep="\n")
    shown(histogram.peaks(bins, args.peaks).select(F.struct(-F.col("count"), "start_ns").alias("line"), F.format_string("  %8d  %d", "count", "start_ns").alias("text")))
    return 0


def main() -> None:
    spark = SparkSession.builder.appName("fixlake").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    status = run(spark, sys.argv[1:])
    spark.stop()
    sys.exit(status)


if __name__ == "__main__":
    main()
