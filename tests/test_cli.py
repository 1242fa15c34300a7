import gzip
import json

import pytest
from tests.conftest import message

from fixlake import cli


def rows():
    """A log on, two sessions, an order that fills in two parts, one that is replaced, and a fill that is sent twice."""
    head = lambda kind, a, b, seq: [(35, kind), (34, str(seq)), (49, a), (56, b), (52, f"20240102-10:00:{seq:02}")]
    new = lambda i, seq, sym="AAPL": [*head("D", "A", "B", seq), (11, i), (55, sym), (54, "1"), (38, "100")]
    fill = lambda i, seq, ex, qty, px, cum, st="1": [*head("8", "B", "A", seq), (37, f"X{i}"), (11, i), (17, ex), (150, "F"), (39, st), (32, qty), (31, px), (14, cum)]
    return [
        head("A", "A", "B", 1), head("A", "B", "A", 1), new("ABC", 2), fill("ABC", 2, "E1", "60", "10.5", "60"), fill("ABC", 3, "E2", "40", "11", "100", "2"),
        new("DEF", 5), [*head("G", "A", "B", 6), (11, "GHI"), (41, "DEF"), (55, "AAPL"), (54, "1"), (38, "50")], fill("GHI", 4, "E3", "50", "100", "50", "2"),
        fill("GHI", 4, "E3", "50", "100", "50", "2"), head("0", "C", "D", 1),
    ]


@pytest.fixture
def log(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes("\n".join(message(*r) for r in rows()).encode() + b"\n")
    return str(path)


def call(spark, capsys, *argv):
    capsys.readouterr()
    status = cli.run(spark, list(argv))
    return status, *capsys.readouterr()


def test_sniff_parse_and_stats(spark, capsys, log):
    status, out, _ = call(spark, capsys, "sniff", log)
    assert status == 0 and "SOH (0x01)" in out and "Line prefix:    none" in out and "LF (\\n)" in out
    status, out, _ = call(spark, capsys, "parse", log, "--first", "2", "--format", "json")
    assert status == 0 and [json.loads(x)["msg_type_name"] for x in out.splitlines()] == ["Logon", "Logon"]
    status, out, _ = call(spark, capsys, "parse", log)
    assert status == 0 and out.count("Message @ offset") == 10 and "(NEW)" not in out and "Symbol" in out
    status, out, _ = call(spark, capsys, "stats", log)
    assert status == 0 and "Messages parsed: 10" in out and "Parse errors:    0" in out and "Sessions:        3" in out
    assert "20240102-10:00:01 .. 20240102-10:00:06" in out and "8    ExecutionReport" in out


def test_grep_follows_the_convention(spark, capsys, log):
    status, out, _ = call(spark, capsys, "grep", log, "--filter", "35=8 AND 39=2", "--format", "json")
    assert status == 0 and len(out.splitlines()) == 3 and all('"value":"8"' in x for x in out.splitlines())
    assert call(spark, capsys, "grep", log, "--filter", "35=zz") == (1, "", "")
    status, out, err = call(spark, capsys, "grep", log, "--filter", "(35=D")
    assert status == 1 and out == "" and "parsing filter" in err and "UnbalancedParen" in err
    with pytest.raises(SystemExit) as wrong:
        call(spark, capsys, "grep", log)
    assert wrong.value.code == 2
    status, _, err = call(spark, capsys, "sniff", log + ".absent")
    assert status == 1 and "absent" in err


def test_sessions(spark, capsys, log):
    status, out, _ = call(spark, capsys, "sessions", log)
    lines = out.splitlines()
    assert status == 0 and lines[0].split() == ["session", "msgs", "by-msg-type", "seq-range", "gaps"] and len(lines) == 4
    assert lines[2].startswith("A ↔ B") and lines[2].split()[3:] == ["9", "8=4", "A=2", "D=2", "1..6", "1"]
    found = [json.loads(x) for x in call(spark, capsys, "sessions", log, "--format", "json")[1].splitlines()]
    assert found[0] == {"sender": "A", "target": "B", "in_count": 4, "out_count": 5, "by_msg_type": {"8": 4, "A": 2, "D": 2, "G": 1}, "seq_min": 1, "seq_max": 6,
                        "gaps": [{"from_seq": 2, "to_seq": 5, "ordinal_before": 2, "ordinal_after": 5}]}
    assert found[1]["gaps"] == [] and found[1]["in_count"] == 1


def test_orders(spark, capsys, log):
    status, out, _ = call(spark, capsys, "orders", log, "--limit", "2")
    assert status == 0 and [x.split() for x in out.splitlines()[2:]] == [["ABC", "3"], ["GHI", "3"]]
    assert [json.loads(x)["events"] for x in call(spark, capsys, "orders", log, "--format", "json")[1].splitlines()] == [3, 3, 1]
    status, out, _ = call(spark, capsys, "orders", log, "--id", "DEF")
    assert status == 0 and "ClOrdID: DEF   OrderID(s): [XGHI]   events: 4" in out and "Gantt (60 cols" in out and set(out.rstrip().splitlines()[-1].strip()) == set("X.R")
    one = json.loads(call(spark, capsys, "orders", log, "--id", "ABC", "--format", "json")[1])
    assert one["order_ids"] == ["XABC"] and [e["ordinal"] for e in one["events"]] == [2, 3, 4] and one["events"][1] == {"ordinal": 3, "msg_type": "8", "exec_type": "F", "ord_status": "1", "cum_qty": "60"}
    status, _, err = call(spark, capsys, "orders", log, "--id", "none")
    assert status == 1 and "no events found for ClOrdID=none" in err


def test_consolidate(spark, capsys, log, tmp_path):
    status, whole, _ = call(spark, capsys, "orders", "consolidate", log)
    lines = whole.splitlines()
    assert status == 0 and lines[0].startswith("ClOrdID") and "Notional" in lines[0] and [x.split()[0] for x in lines[2:]] == ["DEF→GHI", "ABC"]
    assert lines[2].split()[1:] == ["BUY", "AAPL", "50", "50", "5,000.00", "100.0000", "FILLED", "1"]
    status, out, _ = call(spark, capsys, "orders", "consolidate", log, "--format", "csv", "--sort", "fills")
    assert out.splitlines()[1:] == ["ABC,ABC,BUY,AAPL,100,100,1070.0000,10.7000,2,FILLED", "DEF,DEF|GHI,BUY,AAPL,50,50,5000.0000,100.0000,1,FILLED"]
    status, out, _ = call(spark, capsys, "orders", "consolidate", log, "--format", "json")
    assert json.loads(out)[1] == {"root_clordid": "ABC", "family": ["ABC"], "symbol": "AAPL", "side": "BUY", "order_qty": 100, "cum_qty": 100, "notional": 1070.0, "avg_px": 10.7, "fills": 2,
                                  "final_ord_status": "FILLED"}
    data = open(log, "rb").read().splitlines(keepends=True)
    (tmp_path / "1.log").write_bytes(b"".join(data[:4]))
    (tmp_path / "2.log.gz").write_bytes(gzip.compress(b"".join(data[4:])))
    assert call(spark, capsys, "orders", "consolidate", str(tmp_path / "1.log"), str(tmp_path / "2.log.gz"))[:2] == (0, whole)
    (tmp_path / "3.log").write_text(message((35, "0"), (34, "1")))
    assert call(spark, capsys, "orders", "consolidate", str(tmp_path / "3.log"))[:2] == (1, "(no orders)\n")
    assert call(spark, capsys, "sessions", str(tmp_path / "3.log"))[:2] == (1, "(no sessions)\n")


def test_histogram(spark, capsys, log):
    status, out, _ = call(spark, capsys, "histogram", log, "--bucket", "2s", "--width", "10", "--peaks", "1")
    assert status == 0 and "bucket: 2s" in out and "top 1 peaks" in out and out.splitlines()[-1].split()[0] == "3"
    assert call(spark, capsys, "histogram", log, "--bucket", "x")[0] == 1
