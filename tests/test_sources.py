import gzip

import pytest
from pyspark.sql import functions as F

from fixlake.functions.tokens import checksum, declared_checksum, fields, tag, taken
from fixlake.sources.frames import Framer
from fixlake.sources.layout import SniffError, sniff
from fixlake.sources.log import read_log, scan_lines


@pytest.mark.parametrize(("sample", "code"), [(b"", "EmptySample"), (b"hello", "NoSeparator"), (b"x|1=2|3=4", "NoBeginString")])
def test_sniff_errors(sample, code):
    with pytest.raises(SniffError) as error:
        sniff(sample)
    assert error.value.code == code


def test_sniff_layouts(msg):
    row = msg((35, "0"), (34, "1"))
    assert sniff(row.encode()).separator_name == "soh"
    found = sniff(("20260101 " + row.replace("\x01", "|") + "\r\n").encode() * 2)
    assert (found.separator, found.prefix_len, found.line_ending, found.prefix_kind) == ("|", 9, "crlf", "fixed")
    assert sniff((f"a {row}\nbcd {row}\n").encode()).prefix_len == 0  # prefixes that differ count as none


def test_recovers_after_damage(msg):
    good, bad = msg((35, "0"), (34, "1")), msg((35, "D"), (38, "")).replace("9=", "9=9")
    data = f"noise {good}\n{bad}\nmore {good}".encode()
    found = list(Framer("\x01").scan(iter([data]), 0, None))
    assert [code for _, _, code in found] == [None, "UnexpectedEof", None] or [code for _, _, code in found][::2] == [None, None]
    assert found[0][0] == 6 and found[0][1] == good.encode()


def test_blocks_and_ranges_agree(spark, tmp_path, msg):
    text = "".join(f"prefix {msg((35, 'D'), (11, f'A{i}'), (58, 'x' * (i % 50)))}\r\n" for i in range(400))
    path = tmp_path / "a.log"
    path.write_bytes(text.encode())
    whole = read_log(spark, str(path)).messages.select("ordinal", "offset", "raw").orderBy("ordinal").collect()
    split = read_log(spark, str(path), range_size=1000).messages.select("ordinal", "offset", "raw").orderBy("ordinal").collect()
    assert whole == split and [r.ordinal for r in whole] == list(range(400))
    assert all(text.encode()[r.offset :].startswith(r.raw.encode()) for r in whole)
    small = [text.encode()[i : i + 7] for i in range(0, len(text), 7)]
    assert len(list(Framer("\x01").scan(iter(small), 0, None))) == 400


def test_odd_values(spark, log_of, msg):
    rows = [msg((35, "D"), (58, "a=b")), msg((35, "D"), (58, "")), msg((35, "D"), (58, "caf\xe9")), msg((35, "8"), (58, "8=FIX.4.4"), (11, "in")), msg((35, "D"), ("0011", "zero"))]
    log = log_of(*rows)
    found = log.messages.orderBy("ordinal").select(tag(58).cast("binary").alias("v"), tag(11).alias("id"), F.size(fields()).alias("n"), checksum().alias("c"), declared_checksum().alias("d")).collect()
    assert [bytes(r.v) if r.v is not None else None for r in found] == [b"a=b", b"", b"caf\xe9", b"8=FIX.4.4", None]
    assert [r.id for r in found] == [None, None, None, "in", "zero"] and all(r.c == r.d for r in found)
    assert log.errors.count() == 0


def test_native_scan_equals_exact(spark, tmp_path, msg):
    rows = [msg((35, "D"), (11, f"A{i}")) for i in range(20)] + [msg((35, "D"), (11, "bad")).replace("9=", "9=7"), msg((35, "D"), (11, "x")).replace("\x0111=", "\x01y1=")]
    path = tmp_path / "a.log"
    path.write_text("\n".join(rows))
    exact = read_log(spark, str(path))
    native = scan_lines(spark, str(path))
    assert sorted(r.raw for r in native.where("code IS NULL").collect()) == sorted(r.raw for r in exact.messages.collect())
    assert native.where("code IS NOT NULL").count() == exact.errors.count() == 2


def test_sources_continue_and_gzip_members(spark, tmp_path, msg):
    rows = [msg((35, "D"), (11, f"A{i}")) for i in range(6)]
    (tmp_path / "a.log").write_text("\n".join(rows[:2]))
    (tmp_path / "b.LOG.GZ").write_bytes(gzip.compress(rows[2].encode()) + gzip.compress("\n".join(rows[3:]).encode()))
    found = read_log(spark, [str(tmp_path / "a.log"), str(tmp_path / "b.LOG.GZ")]).messages.orderBy("ordinal").select("ordinal", tag(11).alias("id")).collect()
    assert [tuple(r) for r in found] == [(i, f"A{i}") for i in range(6)]


def test_truncated_gzip_fails(spark, tmp_path, msg):
    (tmp_path / "a.log.gz").write_bytes(gzip.compress((msg((35, "D")) * 100).encode())[:-10])
    with pytest.raises(Exception):  # noqa: B017
        read_log(spark, str(tmp_path / "a.log.gz")).messages.count()


def test_empty_file(spark, tmp_path):
    from fixlake.sources.layout import LogFormat

    (tmp_path / "a.log").write_text("")
    assert read_log(spark, str(tmp_path / "a.log"), LogFormat()).messages.count() == 0


def test_many_tags_at_once_equal_single_ones(log_of, msg):
    odd = [[(35, "D"), (11, "A"), (11, "B"), (58, "x11=y")], [(35, "8"), ("0011", "Z"), (11, "Y")], [(35, "8"), (58, "\xe9\xff"), (11, "\xe9")], [(35, "0"), (111, "n"), (11, "")], [(35, "0")]]
    messages, named = log_of(*[msg(*r) for r in odd]).messages, {"kind": 35, "id": 11, "text": 58, "none": 41}
    single = messages.select("ordinal", *[tag(n).alias(c) for c, n in named.items()])
    at_once = taken(messages, ["ordinal"], named)
    binary = lambda df: [tuple(r) for r in df.select("ordinal", *[F.col(c).cast("binary") for c in named]).orderBy("ordinal").collect()]
    assert binary(at_once) == binary(single) and [r[2] for r in binary(at_once)] == [b"A", b"Z", b"\xe9", b"", None]
