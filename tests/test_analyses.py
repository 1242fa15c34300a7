import gzip

import pytest
from pyspark.sql import functions as F

from fixlake.functions import dictionary, render, summary
from fixlake.functions.tokens import fields
from fixlake.operators import consolidate, histogram, orders, sessions, stats, views
from fixlake.sources.log import read_log


def exec_report(cid, eid, qty, px, cum, status="1", *extra):
    return [(35, "8"), (11, cid), (17, eid), (150, "F"), (39, status), (32, qty), (31, px), (14, cum), *extra]


def test_sessions_and_gaps(log_of):
    rows = [(a, b, n) for a, b, n in [("A", "B", 1), ("A", "B", 2), ("A", "B", 4), ("B", "A", 1), ("B", "A", 2), ("B", "A", 3), ("C", "D", 7), ("C", "C", 1), ("A", "B", 4)]]
    log = log_of(*[[(35, "D"), (34, str(n)), (49, a), (56, b)] for a, b, n in rows], [(35, "0"), (49, "A")])
    found = {(r.sender, r.target): r for r in sessions.sessions(log.messages).collect()}
    assert found["A", "B"].in_count == 4 and found["A", "B"].out_count == 3 and found["A", "B"].by_msg_type == {"D": 7} and found["C", "C"].in_count == 1
    gaps = [tuple(r) for r in sessions.seq_gaps(log.messages).collect()]
    assert gaps == [("A", "B", "in", 2, 4, 1, 2)]


def test_gaps_across_buckets(log_of, monkeypatch):
    monkeypatch.setattr(sessions, "BUCKET", 5)
    numbers = [1, 2, 4, 5, 9, 10, 11, 30]
    log = log_of(*[[(35, "D"), (34, str(n)), (49, "A"), (56, "B")] for n in numbers])
    assert sorted((r.from_seq, r.to_seq) for r in sessions.seq_gaps(log.messages).collect()) == [(2, 4), (5, 9), (11, 30)]


def test_histogram(log_of):
    log = log_of(*[[(35, "0"), (52, f"20260101-00:00:{s:02}")] for s in (0, 1, 2, 3, 4, 10)], [(35, "0"), (52, "x")])
    bins = histogram.histogram(log.messages, 10**9).cache()
    assert bins.count() == 11 and histogram.total(bins).first()[0] == 6 and histogram.dropped(log.messages).first()[0] == 1
    assert [r.start_ns % 86_400_000_000_000 for r in histogram.peaks(bins, 2).collect()] == [0, 10**9]
    assert histogram.sparkline(bins, 11) == "█████     █" and len(histogram.sparkline(bins, 3)) == 3 and histogram.sparkline(bins, 0) == ""
    assert histogram.sparkline(bins.where("false"), 5) == ""
    with pytest.raises(ValueError, match="larger bucket"):
        histogram.histogram(log.messages, 1)


def test_sparkline_narrow(log_of):
    log = log_of(*[[(35, "0"), (52, f"20260101-00:{s // 60:02}:{s % 60:02}")] for s in range(100)])
    assert histogram.sparkline(histogram.histogram(log.messages, 10**9), 4) == "████"


LIFE = [
    [(35, "D"), (11, "ABC"), (55, "AAPL"), (54, "1"), (38, "100"), (52, "20260101-00:00:00")],
    exec_report("ABC", "E1", "60", "10.5", "60", "1", (37, "X1"), (52, "20260101-00:00:10")),
    [(35, "G"), (11, "XYZ"), (41, "ABC"), (38, "120"), (52, "20260101-00:00:20")],
    exec_report("XYZ", "E2", "40", "11", "100", "2", (37, "X1"), (52, "20260101-00:00:30")),
    [(35, "8"), (37, "X1"), (39, "4"), (52, "20260101-00:00:40")],
    [(35, "D"), (11, "OTHER"), (41, "NONE"), (38, "5")],
]


def test_timeline(log_of):
    log = log_of(*LIFE)
    events = orders.timeline(log.messages, "ABC")
    assert [r.ordinal for r in events.orderBy("ordinal").collect()] == [0, 1, 2, 3, 4] and [r[0] for r in orders.order_ids(events).collect()] == ["X1"]
    assert [r.ordinal for r in orders.timeline(log.messages, "XYZ").orderBy("ordinal").collect()] == [1, 2, 3, 4]  # forward only, and one round by OrderID
    assert orders.timeline(log.messages, "absent").count() == 0
    assert orders.gantt(events, 11) == "N..X.R..X.?" or orders.gantt(events, 11)[0] == "N"
    assert orders.gantt(orders.timeline(log.messages, "OTHER"), 3) == "N" + "." * 9


def test_timeline_cycle(log_of):
    log = log_of([(35, "G"), (11, "A"), (41, "B")], [(35, "G"), (11, "B"), (41, "A")])
    assert orders.timeline(log.messages, "A").count() == 2


def consolidated(messages):
    return {r.root_clordid: r for r in consolidate.consolidated(messages).collect()}


def test_consolidated(log_of):
    found = consolidated(log_of(*LIFE, exec_report("ABC", "E1", "60", "10.5", "60")).messages)
    row = found["ABC"]
    assert row.family == ["ABC", "XYZ"] and row.notional == 1070.0 and row.fills == 2 and row.cum_qty == 100 and row.avg_px == 10.7 and row.order_qty == 120
    assert (row.symbol, row.side, row.final_ord_status) == ("AAPL", "1", "1") and set(found) == {"ABC", "OTHER"}


def test_fills_without_identifier_and_unbound(log_of):
    log = log_of([(35, "D"), (11, "A")], exec_report("A", "", "1", "2", "1"), exec_report("A", "", "1", "2", "1"), exec_report("A", "E", "x", "2", "1"), exec_report("A", "E", "1", "2", "1"), [(35, "8"), (37, "lost"), (150, "F")])
    assert (consolidated(log.messages)["A"].fills, consolidated(log.messages)["A"].notional) == (2, 4.0)
    assert tuple(consolidate.source_stats(log.messages).first())[2:] == (6, 4, 1)


def test_equal_notionals_are_ranked_by_root(log_of):
    """Products of doubles are 2691483.3000000003 and 3592221.4999999995; as decimals they tie with what others sum up to."""
    log = log_of(exec_report("B", "E1", "33", "81560.1", "33"), exec_report("A", "E2", "1", "2691483.3", "1"), exec_report("C", "E3", "50", "71844.43", "50"), exec_report("D", "E4", "1", "3592221.5", "1"),
                 exec_report("N", "E5", "0.000001", "2000000", "1"), exec_report("T", "E6", "1e300", "1e8", "1"))
    found = consolidate.ranked(consolidate.consolidated(log.messages)).orderBy("rank").collect()
    assert [(r.root_clordid, r.notional) for r in found] == [("T", 1e308), ("C", 3592221.5), ("D", 3592221.5), ("A", 2691483.3), ("B", 2691483.3), ("N", 2.0)]


def test_family_rules(log_of):
    # the parent must have been seen before; several parents and cycles are replayed in order
    log = log_of([(35, "G"), (11, "B"), (41, "A")], [(35, "D"), (11, "A")], [(35, "D"), (11, "P")], [(35, "G"), (11, "Q"), (41, "P")], [(35, "D"), (11, "R")], [(35, "G"), (11, "Q"), (41, "R")], [(35, "G"), (11, "R"), (41, "Q")])
    found = {k: set(r.family) for k, r in consolidated(log.messages).items()}
    assert found == {"A": {"A"}, "B": {"B"}, "R": {"P", "Q", "R"}}


def test_split_sources_equal_whole(spark, tmp_path, msg):
    rows = [msg(*r) for r in LIFE]
    (tmp_path / "all.log").write_text("\n".join(rows))
    (tmp_path / "a.log").write_text("\n".join(rows[:3]))
    (tmp_path / "b.log.gz").write_bytes(gzip.compress("\n".join(rows[3:]).encode()))
    whole, parts = (consolidated(read_log(spark, p).messages) for p in (str(tmp_path / "all.log"), [str(tmp_path / "a.log"), str(tmp_path / "b.log.gz")]))
    assert whole == parts


def test_pipe_equals_soh(log_of):
    assert consolidated(log_of(*LIFE, sep="|").messages) == consolidated(log_of(*LIFE).messages)


@pytest.mark.parametrize("lookup", [10_000, 1])
def test_postings_are_made_once(spark, log_of, monkeypatch, lookup):
    """An index that is not saved is made in one pass for all values of a filter, few or many."""
    monkeypatch.setattr(views, "LOOKUP", lookup)
    log, made = log_of(*LIFE, [(35, "8"), ("011", "ABC")], [(35, "8"), (11, "Q"), (11, "ABC")]), spark.sparkContext.accumulator(0)

    def count(batches):
        made.add(1)
        yield from batches

    index = views.index(log.messages).coalesce(1).mapInArrow(count, "tag long, value string, ordinal long")
    for text, passes in (("35=8 AND 11=ABC", 1), ("35=8", 2), ("11=ABC AND 35=none", 3)):
        found = views.by_postings(log.messages, index, text)
        assert sorted(r[0] for r in found.select("ordinal").collect()) == sorted(r[0] for r in views.filtered(log.messages, text).select("ordinal").collect())
        assert made.value == passes


def test_views(log_of):
    log = log_of(*LIFE, [(35, "0"), (34, "9")], [(35, "0"), (34, "2")])
    m = log.messages.cache()
    assert [r[0] for r in views.ordered(m, "seq").select("ordinal").collect()][:2] == [7, 6]
    assert [r[0] for r in views.ordered(m, "sending").select("ordinal").collect()][:5] == [0, 1, 2, 3, 4]
    assert tuple(views.search(m, "35=8", 3).first()) == (4, False) and tuple(views.search(m, "35=8", 4).first()) == (1, True) and tuple(views.search(m, "35=8", 1, False).first()) == (4, True)
    assert views.search(m, "35=zzz", 1).count() == 0 and views.search(m, "35=D AND 55=AAPL", 0).count() == 0
    index = views.index(m).cache()
    for text in ("35=8 AND 11=ABC", "35=8", "58=x OR 35=D"):
        assert sorted(r[0] for r in views.by_postings(m, index, text).select("ordinal").collect()) == sorted(r[0] for r in views.filtered(m, text).select("ordinal").collect())
    status = {r.tag: r.status for r in views.diff(m, 0, 2).collect()}
    assert status[11] == "different" and status[55] == "only_a" and status[41] == "only_b" and status[8] == "equal"
    marks = views.Bookmarks()
    marks.mark("3", 2)
    assert [r.ordinal for r in marks.jump(m, "3").collect()] == [2] and marks.jump(m.where("ordinal > 5"), "3").count() == 0
    both = views.union_all(m, m)
    assert both.agg(F.max("ordinal")).first()[0] == 15 and stats.order_counts(m, 1).first().clordid == "ABC"


def test_stats(log_of):
    log = log_of([(35, "D"), (49, "A"), (49, "Z"), (56, "B"), (52, "2"), (52, "1")], [(35, "D"), (35, "8")])
    assert [(r.msg_type, r.n, r.label) for r in stats.message_types(log.messages).collect()] == [("D", 2, "NewOrderSingle"), ("8", 1, "ExecutionReport")]
    assert [tuple(r) for r in stats.session_pairs(log.messages).collect()] == [("Z", "B", 1)] and tuple(stats.totals(log.messages, log.errors).first()) == (2, 0, "1", "2")


def test_group_depth_and_names(log_of):
    log = log_of([(35, "W"), (268, "2"), (269, "0"), (270, "1"), (269, "1"), (58, "t"), (270, "9")])
    got = [(f.tag, f.depth, f.name) for f in render.resolved(log.messages).first().fields][3:-1]
    assert got == [(268, 0, "NoMDEntries"), (269, 1, "MDEntryType"), (270, 1, "MDEntryPx"), (269, 1, "MDEntryType"), (58, 0, "Text"), (270, 0, "MDEntryPx")]


def test_dictionary(spark):
    d = dictionary.builtin()
    assert dictionary.chain_for("FIX.4.4", None) == ["FIX44"] and [dictionary.chain_for("FIXT.1.1", v)[1] for v in ("6", "7", "8", "9", None)] == ["FIX44", "FIX50", "FIX50SP1", "FIX50SP2", "FIX50SP2"]
    assert d.label(["FIX44"], 54, "1") == "BUY" and d.label(["FIX44"], 54, "zz") is None and d.field_name(["FIX44"], 55) == "Symbol" and d.message_name(["FIX44"], "D") == "NewOrderSingle"
    xml = '<fix><messages><message name="Mine" msgtype="U"/><message name="Second" msgtype="U"/></messages><fields><field number="35" name="Kind"><value enum="U" description="USER"/></field><field number="7001" name="Own" type="QTY"/></fields></fix>'
    parsed = dictionary.load_xml(xml)
    assert parsed == ({35: ("Kind", "STRING"), 7001: ("Own", "QTY")}, {35: {"U": "USER"}}, {"U": "Mine"})
    own = dictionary.Dictionary().add("FIXT11", *parsed).add("FIX50SP2", {35: ("Later", "X"), 55: ("Symbol", "STRING")}, {}, {"D": "New"})
    df = spark.createDataFrame([("8=FIXT.1.1\x019=5\x0135=U\x0155=x\x0110=000\x01", "\x01")], "raw string, sep string").withColumn("tags", fields())
    row = dictionary.resolve(df, own).first()
    assert row.msg_type_name == "Mine" and [f.name for f in row.fields][2:4] == ["Kind", "Symbol"] and row.fields[2].value_label == "USER"


def test_summaries(log_of):
    log = log_of(*LIFE, [(35, "3"), (58, "x" * 61)], [(35, "A"), (55, "A")], [(35, "8"), (150, "Z"), (39, "2"), (38, "1500"), (54, "2"), (44, "9")], [(35, "D"), (44, "9")])
    got = log.messages.orderBy("ordinal").select(summary.detail().alias("d"), summary.badges().alias("b")).collect()
    assert got[0].d == "BUY 100 AAPL" and got[6].d == "x" * 60 + "…" and got[7].d is None and got[8].d == "SELL 1,500" and got[8].b == ["Z", "FILLED"] and got[9].d == "@ 9"


def test_render(log_of, tmp_path):
    log = log_of([(35, "D"), (49, 'a,"b'), (58, 'q"\\\t\x02'), (9999, "?")])
    text = render.jsonl(log.messages).first().text
    import json

    parsed = json.loads(text)
    assert parsed["msg_type_name"] == "NewOrderSingle" and [t["value"] for t in parsed["tags"]][4] == 'q"\\\t\x02' and parsed["tags"][5]["name"] is None and list(parsed) == ["offset", "raw_len", "msg_type_name", "tags"]
    assert render.csv(log.messages).first().text == '0,0,D,"a,""b",,,'
    lines = render.pretty(log.messages).first().text.split("\n")
    assert lines[0].startswith("Message @ offset 0 (") and lines[0].endswith("bytes) NewOrderSingle") and lines[3] == "     35  MsgType      = D (ORDER_SINGLE)" and "   9999  ?" in lines[6]
    assert render.export(log.messages, "fix", str(tmp_path / "out")) == 1
    with pytest.raises(ValueError, match="nothing"):
        render.export(log.messages.where("false"), "csv", str(tmp_path / "none"))


def test_timelines_of_many_orders(log_of, spark, monkeypatch):
    """As each order's own, also where links lead back or fan out, and for any number of identifiers."""
    rows = [((35, "D"), (11, "A"), (37, "X")), ((35, "G"), (11, "B"), (41, "A")), ((35, "G"), (11, "A"), (41, "B")), ((35, "G"), (11, "C"), (41, "A"), (41, "Z")), ((35, "8"), (37, "X")), ((35, "8"), (37, "Y")),
            ((35, "D"), (11, "Z"), (37, "Y")), ((35, "8"), (11, "D"), (41, "C"), (37, "W")), ((35, "8"), (37, "W"), (52, "20240101-10:00:00"))]
    messages = log_of(*rows).messages
    names = ["A", "B", "C", "D", "Z", "absent"]
    found = orders.timelines(messages, spark.createDataFrame([(n,) for n in names] * 2 + [(None,)], "clordid string")).collect()
    for n in names:
        want = sorted(map(repr, orders.timeline(messages, n).collect()))
        assert sorted(repr(type(r)(**{k: v for k, v in r.asDict().items() if k != "clordid"})) for r in found if r.clordid == n) == want, n
    whole = sorted(map(repr, orders.timeline(messages, "A").collect()))
    monkeypatch.setattr(orders, "MOST", 1)
    assert sorted(map(repr, orders.timeline(messages, "A").collect())) == whole and {r.id for r in orders.chain(messages, "A").collect()} == set("ABCD")
