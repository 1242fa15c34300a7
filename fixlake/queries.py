"""The log operators as queries over messages rendered from tables, with the SQL that gives the same rows from the tables themselves."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixlake.functions import dictionary, render, reports, summary
from fixlake.functions.graph import shared_folder
from fixlake.functions.tokens import checksum, declared_checksum, fields, read, tag
from fixlake.functions.values import number, quantity, sending_ns, u32
from fixlake.operators import consolidate, histogram, incremental, orders, sessions, stats, views
from fixlake.plans.dsl import to_column
from fixlake.sources import datasource, stored, synth
from fixlake.sources.frames import file_sizes
from fixlake.sources.log import Log, read_log, read_records, scan_lines

HOUR = 3_600_000_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_log(spark: SparkSession, sf_dir: str) -> Log:
    return read_records(synth.order_flow(_table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")), "record", "pos")


def session_log(spark: SparkSession, sf_dir: str) -> Log:
    return read_records(synth.session_flow(_table(spark, sf_dir, "events")), "record", "pos")


def party_log(spark: SparkSession, sf_dir: str) -> Log:
    """Messages that repeat a tag: customers with two party identifiers each."""
    rows = _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("pos"),
        synth.framed(synth.body((35, "D"), (49, F.col("c_name")), (448, F.col("c_mktsegment")), (447, "D"), (448, F.concat(F.lit("N"), F.col("c_nationkey"))), (38, F.floor("c_acctbal")))).alias("record"),
    )
    return read_records(rows, "record", "pos")


def market_log(spark: SparkSession, sf_dir: str) -> Log:
    """Market data with a repeating group from parts."""
    rows = _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"),
        synth.framed(synth.body((35, "W"), (55, F.concat(F.lit("P"), F.col("p_partkey"))), (268, "2"), (269, "0"), (270, F.col("p_size")), (269, "1"), (270, F.col("p_size") + 1), (58, "end"))).alias("record"),
    )
    return read_records(rows, "record", "pos")


def damaged_log(spark: SparkSession, sf_dir: str) -> Log:
    """Events of which some have a wrong BodyLength, a tag that is no number, or no marker."""
    base = synth.framed(synth.body((35, "B"), (11, F.col("event_id")), (58, F.col("event_type"))))
    broken = (
        F.when(F.col("event_id") % 7 == 0, F.replace(base, F.lit("\x019="), F.lit("\x019=9")))
        .when(F.col("event_id") % 11 == 0, F.replace(base, F.lit("\x0158="), F.lit("\x01x8=")))
        .when(F.col("event_id") % 13 == 0, F.replace(base, F.lit("8=FIX"), F.lit("8=XIF"))).otherwise(F.concat(F.lit("prefix "), base))
    )
    return read_records(_table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), broken.alias("record")), "record", "pos")


ORDERS = """
WITH l AS (
  SELECT l.*, o_custkey, o_orderstatus, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS n
  FROM lineitem l JOIN orders ON o_orderkey = l_orderkey),
m AS (
  SELECT o_orderkey AS k, o_orderkey * 1024 AS pos, 'D' AS t35, 'C' || o_custkey AS t49, 'GW' AS t56, strftime(o_orderdate, '%Y%m%d-%H:%M:%S.%f') AS t52, o_orderdate AS ts,
    'O' || o_orderkey AS t11, NULL AS t41x, 'P' || (o_custkey % 50) AS t55, CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '2' END AS t54, '100' AS t38,
    o_totalprice::DECIMAL(18,2)::VARCHAR AS t44, CASE WHEN o_orderkey % 7 = 0 THEN 'NONE' END AS t41, NULL AS t37, NULL AS t17, NULL AS t150, NULL AS t39, NULL AS t32, NULL AS t31, NULL AS t14
  FROM orders
  UNION ALL
  SELECT o_orderkey, o_orderkey * 1024 + 1, 'G', 'C' || o_custkey, 'GW', strftime(o_orderdate, '%Y%m%d-%H:%M:%S.%f'), o_orderdate, 'R' || o_orderkey, NULL, NULL,
    CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '2' END, '150', NULL, 'O' || o_orderkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM orders WHERE o_orderstatus = 'P'
  UNION ALL
  SELECT l_orderkey, l_orderkey * 1024 + 1 + n, '8', 'GW', 'C' || o_custkey, strftime(l_shipdate, '%Y%m%d-%H:%M:%S.%f'), l_shipdate,
    CASE WHEN n % 3 <> 0 THEN (CASE WHEN o_orderstatus = 'P' THEN 'R' ELSE 'O' END) || l_orderkey END, NULL, NULL, NULL, NULL, NULL, NULL, 'X' || l_orderkey,
    'E' || l_orderkey || '-' || l_linenumber, 'F', CASE WHEN o_orderstatus = 'F' THEN '2' ELSE '1' END, l_quantity::INT::VARCHAR, l_extendedprice::DECIMAL(18,2)::VARCHAR,
    (l_quantity * n)::INT::VARCHAR
  FROM l)
"""
EVENTS = """
WITH crc AS (SELECT event_type AS et, g FROM (VALUES {kinds}) v(event_type, g)),
n AS (
  SELECT e.*, g = 0 AS o, (row_number() OVER w + sum((event_id % 17 = 0)::INT) OVER w)::BIGINT AS seq, 'U' || lpad(user_id::VARCHAR, 6, '0') AS u FROM events e JOIN crc ON et = event_type
  WINDOW w AS (PARTITION BY user_id, g = 0 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
m AS (
  SELECT event_id AS pos, upper(substr(event_type, 1, 1)) AS t35, seq, CASE WHEN o THEN 'GW' ELSE u END AS t49, CASE WHEN o THEN u ELSE 'GW' END AS t56,
    strftime(ts, '%Y%m%d-%H:%M:%S.%f') AS t52, ts, event_type AS t58, 'GW' AS sender, u AS target, CASE WHEN o THEN 'in' ELSE 'out' END AS direction
  FROM n)
"""
# crc32 modulo 3 of the event types, which DuckDB has no function for
_KINDS = ("click", "view", "purchase", "signup", "error", "login", "logout", "search", "add_to_cart", "refund", "scroll", "share", "checkout")


def _events_sql() -> str:
    import zlib

    return EVENTS.replace("{kinds}", ", ".join(f"('{k}', {zlib.crc32(k.encode()) % 3})" for k in _KINDS))


def _first_replaced(spark: SparkSession, sf_dir: str) -> int:
    return _table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").agg(F.min("o_orderkey")).first()[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _shown(*tags: int) -> list[Column]:
    return [F.col("ordinal"), *[tag(t).alias(f"t{t}") for t in tags]]


_NS = "epoch_us(ts) * 1000"


@query(ORDERS + "SELECT t35 AS msg_type, count(*) AS n, CASE t35 WHEN 'D' THEN 'NewOrderSingle' WHEN 'G' THEN 'OrderCancelReplaceRequest' WHEN '8' THEN 'ExecutionReport' END AS label FROM m GROUP BY t35")
def msgtype_counts(spark, sf_dir):
    return stats.message_types(order_log(spark, sf_dir).messages)


@query(ORDERS + "SELECT t49 AS sender, t56 AS target, count(*) AS n FROM m GROUP BY ALL")
def session_pairs(spark, sf_dir):
    return stats.session_pairs(order_log(spark, sf_dir).messages)


@query(ORDERS + "SELECT count(*) AS messages, 0::BIGINT AS errors, min(t52) AS min_time, max(t52) AS max_time FROM m")
def time_range(spark, sf_dir):
    log = order_log(spark, sf_dir)
    return stats.totals(log.messages, log.errors)


@query(ORDERS + "SELECT pos AS ordinal, t11, t17 FROM m WHERE t35 = '8' AND t39 = '2'")
def filter_eq(spark, sf_dir):
    return views.filtered(order_log(spark, sf_dir).messages, "35=8 AND 39=2").select(*_shown(11, 17))


@query(ORDERS + "SELECT pos AS ordinal, t11, t41 FROM m WHERE t41 IS DISTINCT FROM 'NONE' AND t11 IS NOT NULL")
def filter_ne_absent(spark, sf_dir):
    return views.filtered(order_log(spark, sf_dir).messages, "41!=NONE AND 11~.").select(*_shown(11, 41))


@query(ORDERS + "SELECT pos AS ordinal, t11 FROM m WHERE regexp_matches(t11, '^O[0-9]*7$')")
def filter_regex(spark, sf_dir):
    return views.filtered(order_log(spark, sf_dir).messages, '11~"^O[0-9]*7$"').select(*_shown(11))


@query(ORDERS + "SELECT pos AS ordinal, t35, t54, t38 FROM m WHERE (t35 = 'D' OR t35 = 'G') AND t54 IS DISTINCT FROM '1' AND NOT (t38 = '150' AND t35 = 'G')")
def filter_bool(spark, sf_dir):
    return views.filtered(order_log(spark, sf_dir).messages, "(35=D or 35=G) AND not 54=1 AND NOT (38=150 AND 35=G)").select(*_shown(35, 54, 38))


@query("SELECT c_custkey AS ordinal, c_name AS t49 FROM customer WHERE c_mktsegment = 'BUILDING' AND 'N' || c_nationkey <> 'N3' AND c_mktsegment <> 'N3'")
def filter_repeating(spark, sf_dir):
    return views.filtered(party_log(spark, sf_dir).messages, "448=BUILDING AND 448!=N3").select(*_shown(49))


@query(ORDERS + "SELECT pos AS ordinal FROM m WHERE t35 = '8' AND t37 = (SELECT 'X' || min(k) FROM m WHERE t35 = 'G')")
def filter_postings(spark, sf_dir):
    messages = order_log(spark, sf_dir).messages
    return views.by_postings(messages, views.index(messages, (35, 37)), f"35=8 AND 37=X{_first_replaced(spark, sf_dir)}").select("ordinal")


@query(_events_sql() + "SELECT pos AS ordinal FROM m WHERE t58 = 'click' AND NOT t35 = '0'")
def filter_hide_heartbeats(spark, sf_dir):
    return views.filtered(session_log(spark, sf_dir).messages, "58=click", hide_heartbeats=True).select("ordinal")


_SESSIONS = """, t AS (SELECT sender, target, t35, count(*) AS n FROM m GROUP BY ALL),
k AS (SELECT sender, target, string_agg(t35 || '=' || n, ' ' ORDER BY t35) AS by_msg_type FROM t GROUP BY ALL),
s AS (SELECT sender, target, count(*) FILTER (direction = 'in') AS in_count, count(*) FILTER (direction = 'out') AS out_count, min(seq) AS seq_min, max(seq) AS seq_max FROM m GROUP BY ALL)
SELECT * FROM s JOIN k USING (sender, target)"""


def _typed_sessions(messages: DataFrame) -> DataFrame:
    kinds = F.transform(F.array_sort(F.map_entries("by_msg_type")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return sessions.sessions(messages).withColumn("by_msg_type", F.array_join(kinds, " "))


@query(_events_sql() + _SESSIONS)
def sessions_summary(spark, sf_dir):
    return _typed_sessions(session_log(spark, sf_dir).messages)


@query(_events_sql() + """, c AS (SELECT sender, target, t35, count(*) AS n FROM m GROUP BY ALL), r AS (
  SELECT *, row_number() OVER (PARTITION BY sender, target ORDER BY n DESC, t35) AS i FROM c)
SELECT sender, target, string_agg(t35 || '=' || n, ' ' ORDER BY i) AS top_types FROM r WHERE i <= 3 GROUP BY ALL""")
def session_types(spark, sf_dir):
    found = sessions.sessions(session_log(spark, sf_dir).messages)
    return found.select("sender", "target", sessions.top_types(F.col("by_msg_type")).alias("top_types"))


@query(_events_sql() + """, x AS (
  SELECT *, lead(seq) OVER w AS to_seq, lead(pos) OVER w AS ordinal_after FROM m WINDOW w AS (PARTITION BY sender, target, direction ORDER BY seq, pos))
SELECT sender, target, direction, seq AS from_seq, to_seq, pos AS ordinal_before, ordinal_after FROM x WHERE to_seq > seq + 1""")
def seq_gaps(spark, sf_dir):
    return sessions.seq_gaps(session_log(spark, sf_dir).messages)


@query(_events_sql() + "SELECT pos AS ordinal, sender, target, direction FROM m")
def session_of_message(spark, sf_dir):
    return sessions.with_session(session_log(spark, sf_dir).messages).select("ordinal", "sender", "target", "direction")


@query(_events_sql() + "SELECT pos AS ordinal, t49, t56 FROM m WHERE t49 = 'GW' AND t56 = (SELECT min(u) FROM n)")
def session_filter(spark, sf_dir):
    from fixlake.plans.dsl import for_session

    user = _table(spark, sf_dir, "events").agg(F.min("user_id")).first()[0]
    return views.filtered(session_log(spark, sf_dir).messages, for_session("GW", f"U{user:06d}")).select(*_shown(49, 56))


_BINS = f""", b AS (SELECT {_NS} - ({_NS}) % {HOUR} AS s FROM m), c AS (SELECT s, count(*) AS n FROM b GROUP BY s),
g AS (SELECT unnest(range(min(s), max(s) + 1, {HOUR})) AS s FROM c), h AS (SELECT g.s AS start_ns, g.s + {HOUR} AS end_ns, coalesce(n, 0) AS count FROM g LEFT JOIN c USING (s)) """


@query(_events_sql() + _BINS + "SELECT start_ns, end_ns, count FROM h")
def histogram_hours(spark, sf_dir):
    return histogram.histogram(session_log(spark, sf_dir).messages, HOUR)


@query(_events_sql() + _BINS + "SELECT start_ns, end_ns, count FROM h WHERE count > 0 ORDER BY count DESC, start_ns LIMIT 10")
def histogram_peaks(spark, sf_dir):
    return histogram.peaks(histogram.histogram(session_log(spark, sf_dir).messages, HOUR), 10)


@query(_events_sql() + "SELECT count(*)::BIGINT AS total FROM m")
def histogram_total(spark, sf_dir):
    return histogram.total(histogram.histogram(session_log(spark, sf_dir).messages, HOUR))


@query(_events_sql() + _BINS + """, g2 AS (SELECT count, row_number() OVER (ORDER BY start_ns) - 1 AS i, count(*) OVER () AS n FROM h),
c2 AS (SELECT cell, cell * n // 60 AS lo, least(n, greatest((cell + 1) * n // 60, cell * n // 60 + 1)) AS hi FROM (SELECT unnest(range(60)) AS cell), (SELECT any_value(n) AS n FROM g2)),
s2 AS (SELECT cell, coalesce(sum(count), 0) AS c FROM c2 LEFT JOIN g2 ON i >= lo AND i < hi GROUP BY cell),
t2 AS (SELECT greatest(1, list_sort(list(c))[57]) AS scale FROM s2)
SELECT string_agg(substr(' ▁▂▃▄▅▆▇█', least(8, c * 8 // scale)::INT + 1, 1), '' ORDER BY cell) AS sparkline FROM s2, t2""")
def histogram_sparkline(spark, sf_dir):
    line = histogram.sparkline(histogram.histogram(session_log(spark, sf_dir).messages, HOUR), 60)
    return spark.createDataFrame([(line,)], "sparkline string")


@query(ORDERS + "SELECT t11 AS clordid, count(*) AS events FROM m WHERE t11 IS NOT NULL GROUP BY t11 ORDER BY events DESC, clordid LIMIT 20")
def clordid_top(spark, sf_dir):
    return stats.order_counts(order_log(spark, sf_dir).messages)


@query(ORDERS + f"""SELECT pos AS ordinal, t35 AS msg_type, {_NS} AS sending_ns, t150 AS exec_type, t39 AS ord_status, t32 AS last_qty, t31 AS last_px, t14 AS cum_qty, NULL::VARCHAR AS avg_px,
t37 AS order_id FROM m WHERE k = (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'P')""")
def timeline_chain(spark, sf_dir):
    return orders.timeline(order_log(spark, sf_dir).messages, f"O{_first_replaced(spark, sf_dir)}")


@query(ORDERS + f"""SELECT 'O' || k AS clordid, pos AS ordinal, t35 AS msg_type, {_NS} AS sending_ns, t150 AS exec_type, t39 AS ord_status, t32 AS last_qty, t31 AS last_px, t14 AS cum_qty, NULL::VARCHAR AS avg_px,
t37 AS order_id FROM m""")
def timeline_all(spark, sf_dir):
    """The timelines of all orders in one call."""
    asked = _table(spark, sf_dir, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("clordid"))
    return orders.timelines(order_log(spark, sf_dir).messages, asked)


@query(ORDERS + """SELECT pos AS ordinal, t35 AS msg_type, t39 AS ord_status FROM m WHERE k = (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'P') AND t35 <> 'D'""")
def timeline_forward(spark, sf_dir):
    found = orders.timeline(order_log(spark, sf_dir).messages, f"R{_first_replaced(spark, sf_dir)}")
    return found.select("ordinal", "msg_type", "ord_status")


@query(ORDERS + f""", e AS (SELECT pos, {_NS} AS ns, CASE t35 WHEN 'D' THEN 'N' WHEN '8' THEN 'X' WHEN 'G' THEN 'R' END AS l FROM m WHERE k = (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'P')),
x AS (SELECT arg_min(ns, pos) AS a, arg_max(ns, pos) AS b FROM e),
y AS (SELECT arg_max(l, pos) AS l, CASE WHEN a = b THEN 0 ELSE least(79, greatest(0, ns - a)::HUGEINT * 79 // greatest(1, b - a)) END AS c FROM e, x GROUP BY c)
SELECT string_agg(coalesce(l, '.'), '' ORDER BY i) AS gantt FROM (SELECT unnest(range(80)) AS i) LEFT JOIN y ON c = i""")
def timeline_gantt(spark, sf_dir):
    line = orders.gantt(orders.timeline(order_log(spark, sf_dir).messages, f"O{_first_replaced(spark, sf_dir)}"))
    return spark.createDataFrame([(line,)], "gantt string")


_FILLS = """, f AS (SELECT *, row_number() OVER (PARTITION BY k, t17 ORDER BY pos) AS rn FROM m WHERE t35 = '8'),
s AS (SELECT k, (sum(t32::DECIMAL(12,0) * t31::DECIMAL(12,2)) FILTER (rn = 1))::DOUBLE AS notional, count(*) FILTER (rn = 1) AS fills, count(*) AS seen FROM f GROUP BY k),
a AS (
  SELECT k, 'O' || k AS root, string_agg(DISTINCT t11, '→' ORDER BY t11) AS family, max(t55) AS symbol, max(t54) AS side, arg_max(t38, pos) FILTER (t38 IS NOT NULL)::DECIMAL(20,0) AS order_qty,
    coalesce(max(t14::BIGINT), 0)::DECIMAL(20,0) AS cum_qty, arg_max(t39, pos) FILTER (t35 = '8') AS status, min(epoch_us(ts) * 1000) AS first_ns, max(epoch_us(ts) * 1000) AS last_ns FROM m GROUP BY k)
"""


@query(ORDERS + _FILLS + """SELECT root AS root_clordid, family, symbol, side, order_qty::BIGINT AS order_qty, cum_qty::BIGINT AS cum_qty, round(coalesce(notional, 0), 2) AS notional,
floor(CASE WHEN cum_qty > 0 THEN coalesce(notional, 0) / cum_qty::DOUBLE ELSE 0 END * 1000 + 0.001)::BIGINT AS avg_px_milli, coalesce(fills, 0)::BIGINT AS fills, status AS final_ord_status, first_ns AS first_seen_ns,
last_ns AS last_seen_ns FROM a LEFT JOIN s USING (k)""")
def consolidated(spark, sf_dir):
    found = consolidate.consolidated(order_log(spark, sf_dir).messages)
    whole = {c: F.col(c).cast("long") for c in ("order_qty", "cum_qty", "fills")}
    return found.withColumns(whole | {
        "family": summary.family_display(F.col("family")), "notional": F.round("notional", 2), "avg_px_milli": F.floor(F.col("avg_px") * 1000 + 0.001).cast("long"),
    }).drop("avg_px")


@query(ORDERS + _FILLS + """SELECT row_number() OVER (ORDER BY coalesce(notional, 0) DESC, root) - 1 AS rank, root AS root_clordid, coalesce(fills, 0)::BIGINT AS fills,
round(coalesce(notional, 0), 2) AS notional FROM a LEFT JOIN s USING (k)""")
def consolidated_order(spark, sf_dir):
    found = consolidate.ranked(consolidate.consolidated(order_log(spark, sf_dir).messages), "notional")
    return found.select("rank", "root_clordid", F.col("fills").cast("long").alias("fills"), F.round("notional", 2).alias("notional"))


@query(ORDERS + _FILLS + "SELECT count(*) AS orders, coalesce(sum(fills), 0)::BIGINT AS fills, round(sum(notional), 0) AS notional FROM a LEFT JOIN s USING (k)")
def consolidated_totals(spark, sf_dir):
    return consolidate.totals(consolidate.consolidated(order_log(spark, sf_dir).messages)).withColumn("notional", F.round("notional", 0))


@query(ORDERS + _FILLS + "SELECT 0 AS source_idx, 'rows' AS source, (SELECT count(*) FROM m) AS messages, sum(seen)::BIGINT AS fills_seen, sum(seen - fills)::BIGINT AS fills_deduped FROM s")
def source_stats(spark, sf_dir):
    return consolidate.source_stats(order_log(spark, sf_dir).messages)


@query(ORDERS + "SELECT t11 AS id, 'O' || k AS root, min(pos) AS first_pos FROM m WHERE t11 IS NOT NULL GROUP BY ALL")
def family_members(spark, sf_dir):
    rows = order_log(spark, sf_dir).messages.select(F.col("ordinal").alias("pos"), tag(11).alias("clordid"), tag(41).alias("orig"))
    return consolidate.families(rows)


@query(_events_sql() + "SELECT row_number() OVER (ORDER BY seq, pos) - 1 AS rank, pos AS ordinal, seq FROM m")
def sort_seq(spark, sf_dir):
    return views.ranked(session_log(spark, sf_dir).messages, "seq").select("rank", "ordinal", u32(tag(34)).alias("seq"))


@query(ORDERS + "SELECT row_number() OVER (ORDER BY t52, pos) - 1 AS rank, pos AS ordinal, t52 FROM m")
def sort_time(spark, sf_dir):
    return views.ranked(order_log(spark, sf_dir).messages, "sending").select("rank", "ordinal", tag(52).alias("t52"))


@query(ORDERS + "SELECT coalesce(min(pos) FILTER (pos > 5000), min(pos)) AS ordinal, min(pos) FILTER (pos > 5000) IS NULL AS wrapped FROM m WHERE t35 = 'G' AND pos <> 5000")
def search_next(spark, sf_dir):
    return views.search(order_log(spark, sf_dir).messages, "35=G", 5000)


@query(ORDERS + "SELECT coalesce(max(pos) FILTER (pos < 500000), max(pos)) AS ordinal, max(pos) FILTER (pos < 500000) IS NULL AS wrapped FROM m WHERE t35 = 'G' AND pos <> 500000")
def search_previous(spark, sf_dir):
    return views.search(order_log(spark, sf_dir).messages, "35=G", 500_000, forward=False)


@query(ORDERS + "SELECT max(pos) AS ordinal, true AS wrapped FROM m WHERE t35 = 'G'")
def search_wraps(spark, sf_dir):
    return views.search(order_log(spark, sf_dir).messages, "35=G", 0, forward=False)


@query("""WITH p AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 2), x AS (
  SELECT row_number() OVER (ORDER BY c_custkey) AS i, 35 AS tag, 'D' AS v FROM p UNION ALL SELECT row_number() OVER (ORDER BY c_custkey), 49, c_name FROM p
  UNION ALL SELECT row_number() OVER (ORDER BY c_custkey), 448, 'N' || c_nationkey FROM p UNION ALL SELECT row_number() OVER (ORDER BY c_custkey), 447, 'D' FROM p
  UNION ALL SELECT row_number() OVER (ORDER BY c_custkey), 38, floor(c_acctbal)::BIGINT::VARCHAR FROM p)
SELECT tag::BIGINT AS tag, a.v AS a, b.v AS b, CASE WHEN a.v = b.v THEN 'equal' ELSE 'different' END AS status FROM (SELECT * FROM x WHERE i = 1) a JOIN (SELECT * FROM x WHERE i = 2) b USING (tag)""")
def diff_messages(spark, sf_dir):
    two = [r[0] for r in _table(spark, sf_dir, "customer").orderBy("c_custkey").select("c_custkey").limit(2).collect()]
    return views.diff(party_log(spark, sf_dir).messages, *two).where("tag NOT IN (8, 9, 10)")


@query("""SELECT p_partkey AS ordinal, pos, tag::BIGINT AS tag, name, label AS value_label, depth FROM part, (VALUES (2, 35, 'MsgType', NULL, 0), (3, 55, 'Symbol', NULL, 0), (4, 268, 'NoMDEntries', NULL, 0),
(5, 269, 'MDEntryType', 'BID', 1), (6, 270, 'MDEntryPx', NULL, 1), (7, 269, 'MDEntryType', 'OFFER', 1), (8, 270, 'MDEntryPx', NULL, 1), (9, 58, 'Text', NULL, 0)) v(pos, tag, name, label, depth)""")
def resolve_fields(spark, sf_dir):
    found = render.resolved(market_log(spark, sf_dir).messages).select("ordinal", F.explode("fields").alias("f"))
    return found.where("f.tag NOT IN (8, 9, 10)").select("ordinal", "f.pos", "f.tag", "f.name", "f.value_label", "f.depth")


@query("""SELECT p_partkey AS ordinal, pos, tag::BIGINT AS tag, name, type, CASE pos WHEN 3 THEN 'P' || p_partkey WHEN 6 THEN p_size::VARCHAR WHEN 8 THEN (p_size + 1)::VARCHAR ELSE v END AS raw, decoded FROM part,
(VALUES (3, 55, 'Symbol', 'STRING', '', ''), (4, 268, 'NoMDEntries', 'NUMINGROUP', '2', ''), (5, 269, '└ MDEntryType', 'CHAR', '0', 'BID'), (6, 270, '└ MDEntryPx', 'PRICE', '', ''),
(7, 269, '└ MDEntryType', 'CHAR', '1', 'OFFER'), (8, 270, '└ MDEntryPx', 'PRICE', '', ''), (9, 58, 'Text', 'STRING', 'end', '')) v(pos, tag, name, type, v, decoded)""")
def detail_rows(spark, sf_dir):
    return reports.detail_table(market_log(spark, sf_dir).messages, hide_common=True)


@query("SELECT p_partkey AS ordinal, 'MarketDataSnapshotFullRefresh' AS msg_type_name, 11 AS n FROM part")
def message_names(spark, sf_dir):
    return render.resolved(market_log(spark, sf_dir).messages).select("ordinal", "msg_type_name", F.size("fields").alias("n"))


@query(ORDERS + """SELECT pos AS ordinal, CASE t35 WHEN 'D' THEN concat_ws(' ', CASE t54 WHEN '1' THEN 'BUY' ELSE 'SELL' END, t38, t55, '@ ' || t44)
WHEN 'G' THEN concat_ws(' ', CASE t54 WHEN '1' THEN 'BUY' ELSE 'SELL' END, t38) END AS detail, CASE WHEN t35 = '8' THEN 'TRADE · ' || CASE t39 WHEN '2' THEN 'FILLED' ELSE 'PARTIALLY_FILLED' END ELSE '' END AS status
FROM m""")
def summaries(spark, sf_dir):
    return order_log(spark, sf_dir).messages.select("ordinal", summary.detail().alias("detail"), F.array_join(summary.badges(), " · ").alias("status"))


@query(ORDERS + """SELECT pos AS ordinal, substr(t52, 10, 8) AS time, CASE t35 WHEN 'D' THEN 'NewOrderSingle' WHEN 'G' THEN 'OrderCancelReplaceRequest' ELSE 'ExecutionReport' END AS message, t11 AS clordid,
CASE WHEN t35 = '8' THEN 'TRADE · ' || CASE t39 WHEN '2' THEN 'FILLED' ELSE 'PARTIALLY_FILLED' END ELSE '' END AS status,
CASE t35 WHEN 'D' THEN concat_ws(' ', CASE t54 WHEN '1' THEN 'BUY' ELSE 'SELL' END, t38, t55, '@ ' || t44) WHEN 'G' THEN concat_ws(' ', CASE t54 WHEN '1' THEN 'BUY' ELSE 'SELL' END, t38) END AS detail FROM m""")
def list_rows(spark, sf_dir):
    return order_log(spark, sf_dir).messages.select("ordinal", *summary.list_row())


@query(ORDERS + """SELECT pos AS ordinal, CASE t54 WHEN '1' THEN 'BUY' WHEN '2' THEN 'SELL' END AS side, CASE t39 WHEN '2' THEN 'FILLED' WHEN '1' THEN 'PARTIALLY_FILLED' END AS status FROM m""")
def side_status_labels(spark, sf_dir):
    return order_log(spark, sf_dir).messages.select("ordinal", summary.side_label(tag(54)).alias("side"), summary.status_label(tag(39)).alias("status"))


@query("""SELECT event_id AS offset, CASE WHEN event_id % 7 = 0 THEN 'UnexpectedEof' WHEN event_id % 11 = 0 THEN 'InvalidTag' ELSE 'InvalidBeginString' END AS code FROM events
WHERE event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0""")
def parse_errors(spark, sf_dir):
    return damaged_log(spark, sf_dir).errors.select("offset", "code")


@query("SELECT count(*) AS messages, sum((event_id % 2 = 0)::INT)::BIGINT AS good FROM events")
def checksum_audit(spark, sf_dir):
    text = synth.body((35, "B"), (11, F.col("event_id")), (58, F.col("event_type")))
    head = F.concat(F.lit("8=FIX.4.4\x019="), F.octet_length(text).cast("string"), F.lit("\x01"), text)
    right = synth.byte_sum(head)
    wrong = F.lpad(((right.cast("int") + 1) % 256).cast("string"), 3, "0")
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), synth.framed(text, checksum=F.when(F.col("event_id") % 2 == 0, right).otherwise(wrong)).alias("record"))
    messages = read_records(rows, "record", "pos").messages
    return messages.agg(F.count(F.lit(1)).alias("messages"), F.count_if(checksum() == declared_checksum()).alias("good"))


@query(ORDERS + f"""SELECT pos AS ordinal, t32::BIGINT AS qty, t31::DOUBLE AS px, {_NS} AS ns FROM m""")
def typed_values(spark, sf_dir):
    return order_log(spark, sf_dir).messages.select("ordinal", quantity(tag(32)).cast("long").alias("qty"), number(tag(31)).alias("px"), sending_ns(tag(52)).alias("ns"))


@query(ORDERS + "SELECT pos AS ordinal, pos AS offset, t35 AS msg_type, t49 AS sender, t56 AS target, '' AS seq_num, t52 AS sending_time FROM m")
def render_csv(spark, sf_dir):
    return order_log(spark, sf_dir).messages.select(*render.csv_columns())


@query("""SELECT p_partkey AS ordinal, '{"offset":' || p_partkey || ',"raw_len":' || (length('8=FIX.4.4|9=|10=000|') + length(n::VARCHAR) + n) || ',"msg_type_name":"MarketDataSnapshotFullRefresh","tags":['
|| '{"tag":8,"name":"BeginString","value":"FIX.4.4"},{"tag":9,"name":"BodyLength","value":"' || n || '"},{"tag":35,"name":"MsgType","value":"W"},{"tag":55,"name":"Symbol","value":"P' || p_partkey
|| '"},{"tag":268,"name":"NoMDEntries","value":"2"},{"tag":269,"name":"MDEntryType","value":"0","value_label":"BID"},{"tag":270,"name":"MDEntryPx","value":"' || p_size
|| '"},{"tag":269,"name":"MDEntryType","value":"1","value_label":"OFFER"},{"tag":270,"name":"MDEntryPx","value":"' || (p_size + 1)
|| '"},{"tag":58,"name":"Text","value":"end"},{"tag":10,"name":"CheckSum","value":"000"}]}' AS text
FROM (SELECT *, length('35=W|55=P|268=2|269=0|270=|269=1|270=|58=end|') + length(p_partkey::VARCHAR) + length(p_size::VARCHAR) + length((p_size + 1)::VARCHAR) AS n FROM part)""")
def render_jsonl(spark, sf_dir):
    return render.jsonl(market_log(spark, sf_dir).messages)


@query("""SELECT p_partkey AS ordinal, 'Message @ offset ' || p_partkey || ' (' || (length('8=FIX.4.4|9=|10=000|') + length(n::VARCHAR) + n) || ' bytes) MarketDataSnapshotFullRefresh' || chr(10)
|| string_agg('  ' || lpad(tag::VARCHAR, 5, ' ') || '  ' || rpad(name, 11, ' ') || ' = ' || CASE i WHEN 2 THEN n::VARCHAR WHEN 4 THEN 'P' || p_partkey WHEN 7 THEN p_size::VARCHAR WHEN 9 THEN (p_size + 1)::VARCHAR ELSE v END
  || coalesce(' (' || label || ')', ''), chr(10) ORDER BY i) || chr(10) AS text
FROM (SELECT *, length('35=W|55=P|268=2|269=0|270=|269=1|270=|58=end|') + length(p_partkey::VARCHAR) + length(p_size::VARCHAR) + length((p_size + 1)::VARCHAR) AS n FROM part),
(VALUES (1, 8, 'BeginString', 'FIX.4.4', NULL), (2, 9, 'BodyLength', '', NULL), (3, 35, 'MsgType', 'W', NULL), (4, 55, 'Symbol', '', NULL), (5, 268, 'NoMDEntries', '2', NULL), (6, 269, 'MDEntryType', '0', 'BID'),
(7, 270, 'MDEntryPx', '', NULL), (8, 269, 'MDEntryType', '1', 'OFFER'), (9, 270, 'MDEntryPx', '', NULL), (10, 58, 'Text', 'end', NULL), (11, 10, 'CheckSum', '000', NULL)) f(i, tag, name, v, label)
GROUP BY p_partkey, n""")
def render_pretty(spark, sf_dir):
    return render.pretty(market_log(spark, sf_dir).messages)


@query(ORDERS + """SELECT (SELECT count(*) FROM m) AS messages, count(*) AS keys, sum(n)::BIGINT AS entries FROM (
  SELECT 35 AS t, t35 AS v, count(*) AS n FROM m GROUP BY ALL UNION ALL SELECT 49, t49, count(*) FROM m GROUP BY ALL UNION ALL SELECT 56, t56, count(*) FROM m GROUP BY ALL
  UNION ALL SELECT 11, t11, count(*) FROM m GROUP BY ALL UNION ALL SELECT 37, t37, count(*) FROM m GROUP BY ALL UNION ALL SELECT 41, t41, count(*) FROM m GROUP BY ALL) WHERE v IS NOT NULL""")
def index_metrics(spark, sf_dir):
    return stats.index_metrics(order_log(spark, sf_dir).messages)


@query("SELECT * FROM (VALUES ('FIX44', 49, 20), ('FIXT11', 74, 8), ('FIX50', 27, 13), ('FIX50SP1', 28, 13), ('FIX50SP2', 29, 13)) t(version, fields, messages)")
def dictionary_sizes(spark, sf_dir):
    return dictionary.builtin().sizes(spark)


@query("""SELECT p_partkey AS ordinal, CASE p_partkey % 4 WHEN 0 THEN 'MarketID' WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE NULL END AS t1301, CASE WHEN p_partkey % 4 IN (0, 2) THEN 'ApplID' END AS t1180,
CASE WHEN p_partkey % 4 <> 3 THEN 'DefaultApplVerID' END AS t1137, 'Symbol' AS t55, CASE WHEN p_partkey % 4 <> 3 THEN 'Username' END AS t553 FROM part""")
def resolve_versions(spark, sf_dir):
    """Names by BeginString and ApplVerID: FIX.5.0 SP2, FIX.5.0, FIX.5.0 SP1 and FIX.4.4."""
    kind = F.col("p_partkey") % 4
    text = synth.body((35, "W"), (1128, F.when(kind == 0, "9").when(kind == 1, "7").when(kind == 2, "8")), (1301, "M"), (1180, "A"), (1137, "9"), (55, "P"), (553, "u"))
    record = F.when(kind == 3, synth.framed(text)).otherwise(synth.framed(text, "FIXT.1.1"))
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), record.alias("record"))
    found = render.resolved(read_records(rows, "record", "pos").messages)
    name = lambda n: F.get(F.filter("fields", lambda f: f["tag"] == n), F.lit(0))["name"]
    return found.select("ordinal", *[name(n).alias(f"t{n}") for n in (1301, 1180, 1137, 55, 553)])


@query(ORDERS + "SELECT t35, count(*) AS n, count(t41) AS with_orig FROM m GROUP BY ALL")
def token_counts_by_type(spark, sf_dir):
    tagged = order_log(spark, sf_dir).messages.withColumn("tags", fields())
    kind = F.get(F.filter("tags", lambda t: t["tag"] == 35), F.lit(0))["value"]
    return tagged.groupBy(kind.alias("t35")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.exists("tags", lambda t: t["tag"] == 41)).alias("with_orig"))


@query(ORDERS + "SELECT pos AS ordinal FROM m WHERE t35 IN ('D', '8') AND t11 IS NOT NULL AND t41 IS NULL")
def sql_front_end(spark, sf_dir):
    order_log(spark, sf_dir).messages.withColumn("matches", to_column("(35=D OR 35=8) AND 11~. AND NOT 41~.")).createOrReplaceTempView("fix_messages")
    return spark.sql("SELECT ordinal FROM fix_messages WHERE matches")


def _written(spark: SparkSession, rows: DataFrame, record: Column | str = "record", gzip: bool = False) -> str:
    """Rows (pos, record) as a log in the shared folder: files of lines, in the order of pos."""
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    lines = rows.repartitionByRange("pos").sortWithinPartitions("pos").select(record)
    lines.write.option("compression", "gzip" if gzip else "none").text(path)
    return path


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.order_flow(_table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem"))


def _plain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = synth.body((35, "B"), (11, F.col("event_id")), (58, F.col("event_type")))
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), synth.framed(text).alias("record"))


@query(ORDERS + "SELECT row_number() OVER (ORDER BY pos) - 1 AS ordinal, t35, t11, t17, t52 FROM m")
def file_messages(spark, sf_dir):
    """A plain log on disk, framed by BodyLength and numbered over all its files."""
    messages = read_log(spark, _written(spark, _orders(spark, sf_dir))).messages
    return messages.select("ordinal", *[read(messages, n).alias(f"t{n}") for n in (35, 11, 17, 52)])


@query(_events_sql() + _SESSIONS)
def file_gzip_sessions(spark, sf_dir):
    rows = synth.session_flow(_table(spark, sf_dir, "events"))
    return _typed_sessions(read_log(spark, _written(spark, rows, gzip=True)).messages)


@query(ORDERS + """, n AS (SELECT *, row_number() OVER (ORDER BY k % 2, pos) - 1 AS ordinal FROM m)
SELECT (k % 2)::INT AS source, t35, count(*) AS n, min(ordinal) AS first, max(ordinal) AS last FROM n GROUP BY ALL""")
def file_two_sources(spark, sf_dir):
    """A plain source and a compressed one, of which the first comes first."""
    rows = _orders(spark, sf_dir)
    odd = F.floor(F.col("pos") / 1024) % 2
    a, b = _written(spark, rows.where(odd == 0)), _written(spark, rows.where(odd == 1), gzip=True)
    messages = read_log(spark, [a, b]).messages
    source = F.col("source").endswith(".gz").cast("int")
    return messages.groupBy(source.alias("source"), read(messages, 35).alias("t35")).agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))


_CONSOLIDATED = "SELECT root AS root_clordid, cum_qty::BIGINT AS cum_qty, round(coalesce(notional, 0), 2) AS notional, coalesce(fills, 0)::BIGINT AS fills, status AS final_ord_status FROM a LEFT JOIN s USING (k)"


@query(ORDERS + _FILLS + _CONSOLIDATED)
def saved_consolidated(spark, sf_dir):
    """Consolidation of a log on disk in two sources, saved once and read from its columns."""
    rows = _orders(spark, sf_dir)
    odd = F.floor(F.col("pos") / 1024) % 2
    log = read_log(spark, [_written(spark, rows.where(odd == 0)), _written(spark, rows.where(odd == 1), gzip=True)])
    found = consolidate.consolidated(log.save(f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}").messages)
    return found.select("root_clordid", F.col("cum_qty").cast("long").alias("cum_qty"), F.round("notional", 2).alias("notional"), F.col("fills").cast("long").alias("fills"), "final_ord_status")


@query(ORDERS + "SELECT pos AS ordinal, t11, t17 FROM m WHERE t35 = '8' AND t39 = '2' AND t11 IS DISTINCT FROM 'O1'")
def saved_filter(spark, sf_dir):
    messages = order_log(spark, sf_dir).save(f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}").messages
    return views.filtered(messages, "35=8 AND 39=2 AND 11!=O1").select("ordinal", read(messages, 11).alias("t11"), read(messages, 17).alias("t17"))


@query(ORDERS + "SELECT pos AS ordinal FROM m WHERE t35 = '8' AND t37 = (SELECT 'X' || min(k) FROM m WHERE t35 = 'G')")
def saved_postings(spark, sf_dir):
    messages = order_log(spark, sf_dir).messages
    looked_up = views.save_index(messages, f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}", (35, 37))
    return views.by_postings(messages, looked_up, f"35=8 AND 37=X{_first_replaced(spark, sf_dir)}").select("ordinal")


def _grown(spark: SparkSession, path: str, parts: str, share: float) -> None:
    """The first bytes of a folder's files, put together in one file: what a log held at an earlier time, up to anywhere in a message. Of compressed files the share is one of their compressed bytes."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = file_sizes(spark, [parts])
    left = int(sum(n for _, n in files) * share)
    fs, io = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf), jvm.org.apache.commons.io

    def copied(name: str, to, n: int | None = None) -> int:
        source = fs.open(jvm.org.apache.hadoop.fs.Path(name))
        source = jvm.java.util.zip.GZIPInputStream(source, 1 << 16) if name.endswith(".gz") else source
        try:
            return io.IOUtils.copyLarge(source, to) if n is None else io.IOUtils.copyLarge(source, to, 0, n)
        finally:
            source.close()

    out = fs.create(jvm.org.apache.hadoop.fs.Path(path), True)
    for name, size in files:
        if left >= size:
            copied(name, out)
        elif left > 0:
            copied(name, out, copied(name, io.output.NullOutputStream.INSTANCE) * left // size if name.endswith(".gz") else left)
        left -= size
    out.close()


def _stored_twice(spark: SparkSession, sf_dir: str) -> str:
    """A log that was stored when it had two thirds of its bytes, and brought up to date when it had all."""
    parts, folder = _written(spark, _orders(spark, sf_dir)), f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    _grown(spark, f"{folder}.log", parts, 2 / 3)
    stored.append(spark, folder, f"{folder}.log")
    _grown(spark, f"{folder}.log", parts, 1)
    stored.append(spark, folder)
    return folder


@query(ORDERS + "SELECT row_number() OVER (ORDER BY pos) - 1 AS ordinal, t35, t11, t17, t52 FROM m")
def stored_append(spark, sf_dir):
    messages = stored.read_stored(spark, _stored_twice(spark, sf_dir)).messages
    return messages.select("ordinal", *[read(messages, n).alias(f"t{n}") for n in (35, 11, 17, 52)])


@query(ORDERS + """, n AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS ordinal FROM m), r AS (SELECT min(k) AS k FROM m WHERE t35 = 'G')
SELECT ordinal, t11, t17 FROM n WHERE t35 = '8' AND t49 = 'GW' AND t37 = 'X' || (SELECT k FROM r) AND t11 IS NOT NULL""")
def stored_lookup(spark, sf_dir):
    """Three equalities and another condition, by the index of a stored log."""
    user = f"35=8 AND 11~. AND 49=GW AND 37=X{_first_replaced(spark, sf_dir)}"
    found = stored.find(spark, _stored_twice(spark, sf_dir), user).messages
    return found.select("ordinal", read(found, 11).alias("t11"), read(found, 17).alias("t17"))


def _amounts(found: DataFrame) -> DataFrame:
    return found.select("root_clordid", F.col("cum_qty").cast("long").alias("cum_qty"), F.round("notional", 2).alias("notional"), F.col("fills").cast("long").alias("fills"), "final_ord_status")


@query(ORDERS + _FILLS + _CONSOLIDATED)
def incremental_consolidated(spark, sf_dir):
    """Orders kept up to date by three batches, which cut through the messages of orders, merged once between."""
    messages = order_log(spark, sf_dir).messages
    state = incremental.Consolidation(spark, f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}")
    # near these shares of the keys; exact ones would need all keys in one task, and any cut gives the same orders
    ends = _table(spark, sf_dir, "orders").agg(F.percentile_approx("o_orderkey", [0.3, 0.7]).alias("p")).first()["p"]
    a, b = (int(p) * 1024 + 2 for p in ends)
    state.add(messages.where(F.col("ordinal") < a), 0)
    state.add(messages.where((F.col("ordinal") >= a) & (F.col("ordinal") < b)), 1)
    state.compact()
    state.add(messages.where(F.col("ordinal") >= b), 2)
    return _amounts(state.orders())


@query(ORDERS + _FILLS + _CONSOLIDATED)
def followed_consolidated(spark, sf_dir):
    """Orders of a log that is followed while it grows: what is there is taken, then what has come."""
    # what is yet to come waits compressed, and neither that nor the log is kept when the orders have it
    parts, folder = _written(spark, _orders(spark, sf_dir), gzip=True), f"{shared_folder(spark)}/followed-{uuid.uuid4().hex}"
    for share in (0.6, 1):
        _grown(spark, f"{folder}.log", parts, share)
        if share == 1:
            stored.Folder(spark, parts).delete("")
        incremental.follow_orders(spark, f"{folder}.log", f"{folder}/orders", f"{folder}/stream").trigger(availableNow=True).start().awaitTermination()
    stored.Folder(spark, f"{folder}.log").delete("")
    return _amounts(incremental.Consolidation(spark, f"{folder}/orders").orders())


def _late_log(spark: SparkSession, sf_dir: str) -> Log:
    """Orders of which each has two identifiers that both report the same execution before the second is linked to the first, unless the order's status is F; odd ones report it again behind that."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    a, b, fill = F.concat(F.lit("A"), key), F.concat(F.lit("B"), key), [(35, "8"), (17, F.concat(F.lit("E"), key)), (150, "F")]
    rows = [
        (0, None, [*fill, (11, b), (39, "1"), (32, "1"), (31, price), (14, "1"), (55, "L")]), (1, None, [(35, "D"), (11, a), (38, "100"), (54, "2")]),
        (2, None, [*fill, (11, a), (39, "0"), (32, "2"), (31, "10"), (14, "3")]), (3, F.col("o_orderstatus") != "F", [(35, "G"), (11, b), (41, a), (55, "OWN"), (54, "1")]),
        (4, key % 2 == 1, [*fill, (11, b), (39, "2"), (32, "5"), (31, "10"), (14, "4")]),
    ]
    made = F.array(*[F.when(F.lit(True) if when is None else when, F.struct((key * 8 + n).alias("pos"), synth.framed(synth.body(*fields)).alias("record"))) for n, when, fields in rows])
    return read_records(_table(spark, sf_dir, "orders").select(F.explode(F.filter(made, lambda x: x.isNotNull())).alias("m")).select("m.*"), "record", "pos")


_LATE = """WITH o AS (SELECT o_orderkey AS k, o_totalprice::DECIMAL(18,2)::DOUBLE AS price, o_orderstatus = 'F' AS apart, o_orderkey % 2 = 1 AS again FROM orders)"""


@query(_LATE + """
SELECT 'A' || k AS root_clordid, 'A' || k || '→B' || k AS family, 'L' AS symbol, '2' AS side, 100 AS order_qty, CASE WHEN again THEN 4 ELSE 3 END AS cum_qty, round(price + 20, 2) AS notional, 2 AS fills,
  CASE WHEN again THEN '2' ELSE '1' END AS final_ord_status FROM o WHERE NOT apart
UNION ALL SELECT 'A' || k, 'A' || k, NULL, '2', 100, 3, 20, 1, '0' FROM o WHERE apart
UNION ALL SELECT 'B' || k, 'B' || k, 'L', NULL, NULL, CASE WHEN again THEN 4 ELSE 1 END, round(price, 2), 1, CASE WHEN again THEN '2' ELSE '1' END FROM o WHERE apart""")
def late_consolidated(spark, sf_dir):
    """Families whose parts had fills, a symbol and a status before they were linked: both fills count, a later one does not."""
    found = consolidate.consolidated(_late_log(spark, sf_dir).messages)
    whole = {c: F.col(c).cast("long") for c in ("order_qty", "cum_qty", "fills")}
    return found.withColumns(whole | {"family": F.concat_ws("→", "family"), "notional": F.round("notional", 2)}).drop("avg_px", "first_seen_ns", "last_seen_ns")


@query(_LATE + """SELECT 0 AS source_idx, 'rows' AS source, sum(3 + CASE WHEN apart THEN 0 ELSE 1 END + CASE WHEN again THEN 1 ELSE 0 END)::BIGINT AS messages,
sum(2 + CASE WHEN again THEN 1 ELSE 0 END)::BIGINT AS fills_seen, count(*) FILTER (again) AS fills_deduped FROM o""")
def late_source_stats(spark, sf_dir):
    return consolidate.source_stats(_late_log(spark, sf_dir).messages)


_DAMAGE = """CASE WHEN event_id % 7 = 0 THEN 'InvalidBodyLength' WHEN event_id % 11 = 0 THEN 'InvalidTag' WHEN event_id % 13 = 0 THEN 'lost' ELSE 'good' END"""


def _damaged_file(spark: SparkSession, sf_dir: str) -> Log:
    """Messages with a BodyLength that is no number, a tag that is none, or no marker, behind noise."""
    base, n = F.col("record"), F.col("pos")
    broken = (
        F.when(n % 7 == 0, F.replace(base, F.lit("\x019="), F.lit("\x019=x"))).when((n % 11 == 0), F.replace(base, F.lit("\x0158="), F.lit("\x01x8=")))
        .when(n % 13 == 0, F.replace(base, F.lit("8=FIX"), F.lit("8=XIF"))).otherwise(F.concat(F.lit("noise "), base))
    )
    return read_log(spark, _written(spark, _plain_events(spark, sf_dir), broken))


@query(f"SELECT code, count(*) AS n FROM (SELECT {_DAMAGE} AS code FROM events) WHERE code LIKE 'Invalid%' GROUP BY ALL")
def file_errors(spark, sf_dir):
    return _damaged_file(spark, sf_dir).errors.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT row_number() OVER (ORDER BY event_id) - 1 AS ordinal, event_id::VARCHAR AS t11 FROM events WHERE {_DAMAGE} = 'good'")
def file_recovered(spark, sf_dir):
    messages = _damaged_file(spark, sf_dir).messages
    return messages.select("ordinal", read(messages, 11).alias("t11"))


@query("""SELECT separator, prefix_len, event_id::VARCHAR AS t11, event_type AS t58 FROM events, (VALUES ('soh', 24), ('pipe', 0), ('caret', 24), ('semicolon', 0)) v(separator, prefix_len)""")
def file_layouts(spark, sf_dir):
    """Each separator, with and without a prefix before each line, as it is told from the first bytes."""
    rows, found = _plain_events(spark, sf_dir), None
    for separator, prefix in (("\x01", "20240101-00:00:00.000 : "), ("|", ""), ("^", "20240101-00:00:00.000 : "), (";", "")):
        log = read_log(spark, _written(spark, rows, F.concat(F.lit(prefix), F.translate("record", "\x01", separator))))
        one = log.messages.select(
            F.lit(log.format.separator_name).alias("separator"), F.lit(log.format.prefix_len).alias("prefix_len"), read(log.messages, 11).alias("t11"), read(log.messages, 58).alias("t58")
        )
        found = one if found is None else found.unionByName(one)
    return found


@query(ORDERS + "SELECT t35, count(*) AS n FROM m GROUP BY ALL")
def file_native_scan(spark, sf_dir):
    rows = scan_lines(spark, _written(spark, _orders(spark, sf_dir))).where("code IS NULL")
    return rows.groupBy(tag(35).alias("t35")).agg(F.count(F.lit(1)).alias("n"))


@query(ORDERS + _FILLS + """, c AS (SELECT root, family, side, symbol, order_qty, cum_qty, coalesce(notional, 0) AS notional, coalesce(fills, 0) AS fills, status,
  CASE WHEN cum_qty > 0 THEN (round(coalesce(notional, 0) * 100)::HUGEINT * 200 + cum_qty::HUGEINT) // (2 * cum_qty::HUGEINT) ELSE 0 END AS u FROM a LEFT JOIN s USING (k))
SELECT row_number() OVER (ORDER BY fills DESC, root) AS line, concat_ws(',', root, replace(family, '→', '|'), CASE side WHEN '1' THEN 'BUY' ELSE 'SELL' END, symbol, order_qty::BIGINT::VARCHAR, cum_qty::BIGINT::VARCHAR,
  notional::DECIMAL(28,4)::VARCHAR, (u // 10000)::VARCHAR || '.' || lpad((u % 10000)::VARCHAR, 4, '0'), fills::BIGINT::VARCHAR, CASE status WHEN '2' THEN 'FILLED' WHEN '1' THEN 'PARTIALLY_FILLED' ELSE '' END) AS text FROM c""")
def report_consolidated(spark, sf_dir):
    return reports.consolidated_csv(consolidate.consolidated(order_log(spark, sf_dir).messages), "fills").where("line > 0")


@query(_events_sql() + """, x AS (SELECT sender, target, direction, seq, pos, lead(seq) OVER w AS nxt FROM m WINDOW w AS (PARTITION BY sender, target, direction ORDER BY seq, pos)),
g AS (SELECT sender, target, count(*) AS gaps FROM x WHERE nxt > seq + 1 GROUP BY ALL), c AS (SELECT sender, target, t35, count(*) AS n FROM m GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY sender, target ORDER BY n DESC, t35) AS i FROM c), t AS (SELECT sender, target, string_agg(t35 || '=' || n, ' ' ORDER BY i) AS top FROM r WHERE i <= 3 GROUP BY ALL),
s AS (SELECT sender, target, count(*) AS n, min(seq) AS a, max(seq) AS b FROM m GROUP BY ALL)
SELECT row_number() OVER (ORDER BY sender, target) AS line, rpad(sender || ' ↔ ' || target, 32, ' ') || lpad(n::VARCHAR, 9, ' ') || lpad(CASE WHEN length(top) > 18 THEN substr(top, 1, 17) || '…' ELSE top END, 19, ' ')
  || lpad(a || '..' || b, 17, ' ') || lpad(coalesce(gaps, 0)::VARCHAR, 7, ' ') AS text FROM s JOIN t USING (sender, target) LEFT JOIN g USING (sender, target)""")
def report_sessions(spark, sf_dir):
    return reports.sessions_pretty(session_log(spark, sf_dir).messages).where("line > 0")


@query(ORDERS + """SELECT row_number() OVER (ORDER BY n DESC, t11) AS line, rpad(t11, 40, ' ') || ' ' || lpad(n::VARCHAR, 8, ' ') AS text FROM (SELECT t11, count(*) AS n FROM m WHERE t11 IS NOT NULL GROUP BY t11)""")
def report_order_counts(spark, sf_dir):
    return reports.order_counts_pretty(stats.order_counts(order_log(spark, sf_dir).messages, None)).where("line > 0")


@query(ORDERS + """SELECT row_number() OVER (ORDER BY n DESC, t11) AS line, '{"clordid":"' || t11 || '","events":' || n || '}' AS text FROM (SELECT t11, count(*) AS n FROM m WHERE t11 IS NOT NULL GROUP BY t11)""")
def report_order_counts_json(spark, sf_dir):
    return reports.order_counts_json(stats.order_counts(order_log(spark, sf_dir).messages, None))


@query(ORDERS + _FILLS + """, c AS (SELECT root, family, side, symbol, order_qty, cum_qty, coalesce(notional, 0) AS notional, coalesce(fills, 0) AS fills, status,
  CASE WHEN cum_qty > 0 THEN (round(coalesce(notional, 0) * 100)::HUGEINT * 200 + cum_qty::HUGEINT) // (2 * cum_qty::HUGEINT) ELSE 0 END AS u FROM a LEFT JOIN s USING (k))
SELECT line, text || CASE WHEN line < max(line) OVER () THEN ',' ELSE '' END AS text FROM (SELECT row_number() OVER (ORDER BY cum_qty DESC, root) AS line, '{"root_clordid":"' || root || '","family":["' || replace(family, '→', '","') || '"]'
  || ',"symbol":"' || symbol || '","side":"' || CASE side WHEN '1' THEN 'BUY' ELSE 'SELL' END || '","order_qty":' || order_qty::BIGINT || ',"cum_qty":' || cum_qty::BIGINT || ',"notional":' || notional::DECIMAL(28,4)::VARCHAR
  || ',"avg_px":' || (u // 10000)::VARCHAR || '.' || lpad((u % 10000)::VARCHAR, 4, '0') || ',"fills":' || fills::BIGINT
  || CASE WHEN status IS NULL THEN '' ELSE ',"final_ord_status":"' || CASE status WHEN '2' THEN 'FILLED' ELSE 'PARTIALLY_FILLED' END || '"' END || '}' AS text FROM c)""")
def report_consolidated_json(spark, sf_dir):
    return reports.consolidated_json(consolidate.consolidated(order_log(spark, sf_dir).messages), "cum_qty").where("line > 0 AND line < 4611686018427387904")


@query(_events_sql() + """, c AS (SELECT sender, target, t35, count(*) AS n FROM m GROUP BY ALL), t AS (SELECT sender, target, string_agg('"' || t35 || '":' || n, ',' ORDER BY t35) AS kinds FROM c GROUP BY ALL),
x AS (SELECT sender, target, direction, seq, pos, lead(seq) OVER w AS nxt, lead(pos) OVER w AS behind FROM m WINDOW w AS (PARTITION BY sender, target, direction ORDER BY seq, pos)),
g AS (SELECT sender, target, string_agg('{"from_seq":' || seq || ',"to_seq":' || nxt || ',"ordinal_before":' || pos || ',"ordinal_after":' || behind || '}', ',' ORDER BY direction, seq) AS gaps FROM x WHERE nxt > seq + 1 GROUP BY ALL),
s AS (SELECT sender, target, count(*) FILTER (direction = 'in') AS i, count(*) FILTER (direction = 'out') AS o, min(seq) AS a, max(seq) AS b FROM m GROUP BY ALL)
SELECT row_number() OVER (ORDER BY sender, target) AS line, '{"sender":"' || sender || '","target":"' || target || '","in_count":' || i || ',"out_count":' || o || ',"by_msg_type":{' || kinds || '},"seq_min":' || a || ',"seq_max":' || b
  || ',"gaps":[' || coalesce(gaps, '') || ']}' AS text FROM s JOIN t USING (sender, target) LEFT JOIN g USING (sender, target)""")
def report_sessions_json(spark, sf_dir):
    return reports.sessions_json(session_log(spark, sf_dir).messages)


@query(ORDERS + "SELECT t11, t17, t39, t32 FROM m WHERE t35 = '8' AND t39 = '2' AND t11 IS NOT NULL AND t17 LIKE 'E1%'")
def source_filtered(spark, sf_dir):
    """A log on disk as a data source, which filters before it makes rows."""
    datasource.register(spark)
    paths = [name for name, _ in file_sizes(spark, [_written(spark, _orders(spark, sf_dir))])]
    rows = spark.read.format("fix").option("paths", json.dumps(paths)).load()
    return rows.where("t35 = '8' AND t39 = '2' AND t11 IS NOT NULL AND t17 LIKE 'E1%'").select("t11", "t17", "t39", "t32")


@query(_events_sql() + """, r AS (SELECT *, pos - row_number() OVER (PARTITION BY sender, target, pos // 65536 ORDER BY pos) AS g FROM m)
SELECT sender, target, min(pos) AS first, max(pos) AS last FROM r GROUP BY sender, target, pos // 65536, g""")
def session_ordinals(spark, sf_dir):
    """Which messages each session has, from two parts of the log whose runs are merged."""
    messages = session_log(spark, sf_dir).messages
    cut = _table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] // 3
    parts = [sessions.ordinal_runs(messages.where(F.col("ordinal") < cut)), sessions.ordinal_runs(messages.where(F.col("ordinal") >= cut))]
    return sessions.merged_runs(parts[0].unionByName(parts[1]))


@query("""SELECT event_id::VARCHAR AS t11, NULL AS code FROM events WHERE event_id < (SELECT max(event_id) FROM events) UNION ALL SELECT NULL, 'UnexpectedEof'""")
def file_crlf_partial(spark, sf_dir):
    """Lines that end with carriage return and line feed, and a last message of which only the beginning is there."""
    rows = _plain_events(spark, sf_dir)
    last = _table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    text = F.when(F.col("pos") == last, F.expr("left(record, length(record) - 9)")).otherwise(F.concat("record", F.lit("\r")))
    log = read_log(spark, _written(spark, rows, text))
    return log.messages.select(read(log.messages, 11).alias("t11"), F.lit(None).cast("string").alias("code")).unionByName(log.errors.select(F.lit(None).cast("string").alias("t11"), "code"))
