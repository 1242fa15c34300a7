from fixlake.operators import sessions
from fixlake.streaming.tail import TailReader, decided, follow


def ids(reader, start, end):
    return [r[2].split("11=")[1].split("\x01")[0] for span in reader.partitions(start, end) for r in reader.read(span)]


def test_reader_offsets(tmp_path, msg):
    path = str(tmp_path / "a.log")
    a, b, c = (msg((35, "D"), (11, x)) for x in ("A", "B", "C" * 3))
    reader = TailReader([path], None, "beginning")
    start = reader.initialOffset()
    at = reader.latestOffset()
    assert at == start and reader.partitions(start, at) == []  # the file is not there yet
    with open(path, "w") as out:
        out.write(a + "\n" + b[:20])
    at1 = reader.latestOffset()
    assert ids(reader, at, at1) == ["A"] and at1["at"][path] == len(a)
    assert TailReader([path], None, "end").initialOffset()["at"][path] == len(a)  # a message that is not whole yet is not lost
    with open(path, "a") as out:
        out.write(b[20:])
    at2 = reader.latestOffset()
    assert ids(reader, at1, at2) == ["B"] and ids(TailReader([path], None, "beginning", range_size=7), start, at2) == ["A", "B"]
    assert reader.latestOffset() == at2 and reader.partitions(at2, at2) == []
    with open(path, "w") as out:  # rotated
        out.write(c)
    at3 = reader.latestOffset()
    assert ids(reader, at2, at3) == ["CCC"] and at3["at"][path] == len(c)


def test_damage_does_not_hold_up(tmp_path, msg):
    """A message that never becomes whole is passed by when more than a message may be long stands behind it."""
    path, good = tmp_path / "a.log", msg((35, "D"), (11, "A"))
    path.write_text("8=FIX.4.4\x019=99999\x0135=D\x01" + good)
    path.write_text("8=FIX.4.4\x019=99999\x0135=D\x01" + good * 5)
    assert decided(str(path), 0, "\x01", 100) == len(path.read_text()) and decided(str(path), 0, "\x01") == 0


def test_sessions_of_parts(spark, log_of):
    """Counts of parts of a log add up to those of the whole, so new messages need no second look at old ones."""
    rows = [((35, "D8"[i % 2]), (49, "AB"[i % 2]), (56, "BA"[i % 2]), (34, str(i + i // 7))) for i in range(40)]
    messages = log_of(*rows).messages
    parts = [messages.where("ordinal < 15"), messages.where("ordinal >= 15")]
    whole = lambda frame: sorted(map(repr, frame.collect()))
    assert whole(sessions.of_counts(sessions.counts(parts[0]).unionByName(sessions.counts(parts[1])))) == whole(sessions.sessions(messages))
    assert whole(sessions.of_numbers(sessions.numbers(parts[0]).unionByName(sessions.numbers(parts[1])))) == whole(sessions.seq_gaps(messages)) != []


def test_follow(spark, tmp_path, msg):
    path = tmp_path / "a.log"
    path.write_text(msg((35, "D"), (11, "A")) + msg((35, "0")))
    query = follow(spark, str(path), "35=D").writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        with path.open("a") as out:
            out.write(msg((35, "D"), (11, "B")))
        query.processAllAvailable()
        import time

        for _ in range(30):
            if spark.table("followed").count() == 2:
                break
            time.sleep(0.5)
            query.processAllAvailable()
        assert spark.table("followed").count() == 2
    finally:
        query.stop()


def test_follow_from_a_place(tmp_path, msg):
    """A stream that begins where a first pass has ended takes what was written meanwhile, and nothing twice."""
    path = tmp_path / "a.log"
    path.write_text(msg((35, "D"), (11, "A")) + msg((35, "D"), (11, "B"))[:30])
    end = decided(str(path), 0, "\x01")
    path.write_text(msg((35, "D"), (11, "A")) + msg((35, "D"), (11, "B")) + msg((35, "D"), (11, "C")))
    reader = TailReader([str(path)], "\x01", str(end))
    assert ids(reader, reader.initialOffset(), reader.latestOffset()) == ["B", "C"]


def test_ordinal_runs(spark, log_of, monkeypatch):
    monkeypatch.setattr(sessions, "BLOCK", 16)
    rows = [((35, "0"), (49, "AB"[i // 5 % 2]), (56, "G"), (34, "1")) if i % 7 else ((35, "0"), (34, "1")) for i in range(60)]
    messages = log_of(*rows).messages
    parts = [sessions.ordinal_runs(messages.where(c)) for c in ("ordinal < 23", "ordinal >= 23 AND ordinal < 24", "ordinal >= 24")]
    merged = sessions.merged_runs(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert sorted(map(repr, merged.collect())) == sorted(map(repr, sessions.ordinal_runs(messages).collect()))
    found = {r.ordinal: r.sender for r in sessions.of_ordinals(merged, spark.range(70).withColumnRenamed("id", "ordinal")).collect()}
    assert found == {i: ("AB"[i // 5 % 2] if i < 60 and i % 7 else None) for i in range(70)}
    assert all(r["last"] // 16 == r["first"] // 16 for r in merged.collect())
