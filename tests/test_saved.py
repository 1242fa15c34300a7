import random
import re

import pytest
from tests.conftest import message
from pyspark.sql import functions as F

from fixlake.functions.tokens import PROMOTED, final, occurrences, read
from fixlake.operators import consolidate, histogram, orders, sessions, stats, views
from fixlake.sources.frames import Framer
from fixlake.sources.log import read_log, read_saved

FILTERS = ("35=D", "35!=D", "448=A AND 35=8", "NOT 55=S1", "11~^O[0-4]$", "55~S AND NOT 55=S2", "55!=S1", "8=FIX.4.4", "35=zz", "58=x OR 11=O3", "56~.")


def plain(frame):
    return sorted(map(repr, frame.collect()))


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    """A log with repeated tags, bytes that are no UTF-8, leading zeros and damage, as it is and saved."""
    rng, folder = random.Random(3), tmp_path_factory.mktemp("saved")
    out = []
    for i in range(300):
        kind = rng.choice("D8G")
        row = [(35, kind), (49, rng.choice("AB")), (56, rng.choice("AB")), (34, str(i // 2)), (52, f"20240101-10:{i // 60:02}:{i % 60:02}"), (11, f"O{i % 9}"), (55, f"S{i % 3}")]
        row += [(41, f"O{i % 7}")] * (kind == "G") + [(55, "S2")] * (i % 5 == 0) + [(35, "D")] * (i % 11 == 0) + [(448, "A"), (448, "B")] * (i % 4 == 0) + [("0058", "x")] * (i % 6 == 0)
        row += [(58, "caf\xe9")] * (i % 17 == 0) + [(37, f"X{i % 9}"), (17, f"E{i % 50}"), (150, "F"), (32, "1"), (31, "2.5"), (14, str(i))] * (kind == "8") + [(52, "2")] * (i % 13 == 0)
        text = message(*row)
        out.append(text.replace("9=", "9=9", 1) if i % 29 == 0 else text.replace("\x0156=", "\x01x56=", 1) if i % 31 == 0 else text)
    (folder / "a.log").write_bytes("\n".join(out).encode("latin-1"))
    log = read_log(spark, str(folder / "a.log"), range_size=5000)
    return log, log.save(f"file://{folder}/stored"), folder


def test_saved_messages_are_the_same(spark, logs):
    log, saved, folder = logs
    columns = log.messages.columns
    assert plain(log.messages) == plain(saved.messages.select(columns)) and plain(log.errors) == plain(saved.errors) and log.errors.count() > 10
    assert saved.format.separator == "\x01" and plain(read_saved(spark, f"file://{folder}/stored").messages) == plain(saved.messages)
    for n in PROMOTED:
        assert plain(log.messages.select("ordinal", read(log.messages, n).alias("v"))) == plain(saved.messages.select("ordinal", read(saved.messages, n).alias("v"))), n
    for n in (35, 52, 55):
        assert plain(log.messages.select("ordinal", occurrences(log.messages, n).alias("v"))) == plain(saved.messages.select("ordinal", occurrences(saved.messages, n).alias("v")))
        assert plain(log.messages.select("ordinal", final(log.messages, n).alias("v"))) == plain(saved.messages.select("ordinal", final(saved.messages, n).alias("v")))
    again = type(log)(log.messages, log.errors, log.format).save(f"file://{folder}/expressions")  # as for logs that are no files
    assert plain(again.messages.select(sorted(saved.messages.columns))) == plain(saved.messages.select(sorted(saved.messages.columns))) and plain(again.errors) == plain(log.errors)


@pytest.mark.parametrize("text", FILTERS)
def test_filters_agree(logs, text):
    log, saved, _ = logs
    assert plain(views.filtered(log.messages, text).select("ordinal")) == plain(views.filtered(saved.messages, text).select("ordinal"))


def test_analyses_agree(logs):
    log, saved, _ = logs
    for of in (
        lambda m: sessions.sessions(m), lambda m: sessions.seq_gaps(m), lambda m: histogram.histogram(m, 60_000_000_000), lambda m: stats.message_types(m, None), stats.session_pairs,
        lambda m: stats.order_counts(m, None), lambda m: stats.totals(m, log.errors), consolidate.consolidated, lambda m: orders.timeline(m, "O3"), consolidate.source_stats, stats.index_metrics,
        lambda m: views.index(m), lambda m: views.ordered(m, "seq").select("ordinal"), lambda m: views.ranked(m, "seq", 3).select("rank", "ordinal"),
    ):
        assert plain(of(log.messages)) == plain(of(saved.messages))


def test_filters_reach_the_scan(logs):
    plan = views.filtered(logs[1].messages, "35=D AND 49=A").select("ordinal", F.col("t11"))._jdf.queryExecution().executedPlan().toString()
    assert "t35" in plan.split("PushedFilters")[1].split("]")[0] and "raw:" not in plan.split("ReadSchema")[1]


def test_saved_postings(logs):
    log, saved, folder = logs
    looked_up = views.save_index(saved.messages, f"file://{folder}/postings")
    assert plain(looked_up.drop("bucket")) == plain(views.index(log.messages))
    for text in ("35=D AND 49=A", "35=D", "11=O3 AND 35=8", "35=none", "55=S1"):
        found = views.by_postings(saved.messages, looked_up, text)
        assert plain(found.select("ordinal")) == plain(views.filtered(log.messages, text).select("ordinal")), text
    plan = views.by_postings(saved.messages, looked_up, "37=X1")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket#[0-9]+ = [0-9]+", plan)


def test_ranks_are_places(logs):
    rows = logs[1].messages
    for by in ("natural", "seq", "sending", "transact"):
        want = [r.ordinal for r in views.ordered(rows, by).select("ordinal").collect()]
        assert [r.ordinal for r in views.ranked(rows, by, 5).orderBy("rank").collect()] == want
        assert [r["rank"] for r in views.ranked(rows, by).orderBy("rank").collect()] == list(range(len(want)))


def test_damaged_lengths_are_bounded(msg=message):
    """A BodyLength of gigabytes costs its message only, after a bounded look-ahead."""
    good = message((35, "0"), (34, "1")).encode()
    bad = b"8=FIX.4.4\x019=99999999\x0135=0\x01"
    block, held = b"\n".join([good] * 2000) + b"\n", []

    class Watched(Framer):
        def take(self, data, base, more, stop):
            held.append(len(data))
            return super().take(data, base, more, stop)

    found = list(Watched("\x01", look_ahead=1 << 20).scan(iter([bad, *[block] * 100]), 0, None))
    assert [code for _, _, code in found].count("UnexpectedEof") == 1 and len(found) == 1 + 100 * 2000 and max(held) < (1 << 20) + 3 * len(block)


def test_folders_and_patterns(spark, tmp_path):
    for name in ("b.log", "a.log", "_SUCCESS", ".hidden"):
        (tmp_path / name).write_text(message((35, "D"), (11, name)) + "\n")

    def ids(paths):
        messages = read_log(spark, paths).messages
        return [r.id for r in messages.orderBy("ordinal").select(read(messages, 11).alias("id")).collect()]

    assert ids(str(tmp_path)) == ["a.log", "b.log"] and ids(f"{tmp_path}/b*") == ["b.log"] and ids([f"{tmp_path}/b.log", f"{tmp_path}/a.log"]) == ["b.log", "a.log"]
    with pytest.raises(FileNotFoundError):
        read_log(spark, f"{tmp_path}/none*")
