import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixlake.llm import substring_dedup as sd
from fixlake.llm.suffix_array import common_prefixes, suffix_array


def plain(rows, window=100):
    """(kept, removed runs) of (order, text) by definition."""
    first = {}
    for order, text in rows:
        for at in range(len(text) - window + 1):
            w = text[at : at + window]
            first[w] = min(first.get(w, (order, at)), (order, at))
    out = []
    for order, text in rows:
        gone = bytearray(len(text))
        for at in range(len(text) - window + 1):
            if first[text[at : at + window]] != (order, at):
                gone[at : at + window] = b"\1" * window
        runs = [i for i in range(len(text)) if gone[i] and (not i or not gone[i - 1])]
        out.append((bytes(c for c, g in zip(text, gone, strict=True) if not g), len(runs)))
    return out


@pytest.mark.parametrize("kind", range(6))
def test_suffixes_are_sorted(kind):
    rng = random.Random(kind)
    for n in (0, 1, 31, 33, 200, 1500):
        body = {
            0: [rng.randint(1, 2) for _ in range(n)], 1: [rng.randint(1, 60000) for _ in range(n)], 2: [1] * n, 3: list(range(n, 0, -1)),
            4: [1, 2, 2, 1, 3] * (n // 5), 5: [2] * n + [1, 3] + [2] * n,
        }[kind]
        s = [*body, 0]
        assert suffix_array(np.array(s, dtype=np.int32), max(s) + 1).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_common_prefixes_end_with_their_string():
    data = np.frombuffer(b"abcabcabx\0abcabcabcab\0bcabc\0", dtype=np.uint8)
    ends = np.flatnonzero(data == 0)
    left = ends[np.searchsorted(ends, np.arange(len(data)))] - np.arange(len(data))
    array = suffix_array(np.append(np.where(left > 0, data.astype(np.int16) + 2, 1), 0), 258)[1:]
    found = common_prefixes(data, array, left)
    for before, at in zip(array[:-1].tolist(), array[1:].tolist(), strict=True):
        same = 0
        while same < min(left[before], left[at]) and data[before + same] == data[at + same]:
            same += 1
        assert found[at] == same


def documents():
    rng = random.Random(3)
    words = ["".join(rng.choices("aeinorst", k=rng.randint(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    passage, boiler = prose(40), prose(25)
    rows = [(i, prose(rng.randint(1, 60))) for i in range(40)]
    rows += [(100 + i, prose(8) + passage + prose(rng.randint(0, 9))) for i in range(25)]
    rows += [(200 + i, prose(60) if i % 2 else boiler[i:] + "é" * i + boiler) for i in range(12)]
    rows += [(300, "a" * 5000), (301, "ab" * 400), (302, "a" * 99), (303, "a" * 100), (304, ""), (305, None), (306, passage * 3), (307, "\0" * 300)]
    rows += [(308, prose(30_000)), (400, rows[3][1]), (401, rows[41][1]), (402, "é" * 200), (2**62, passage)]
    rows.append((403, rows[-5][1][1000:160_000]))
    return rows


@pytest.mark.parametrize(("hot", "segment"), [(sd.HOT, sd.SEGMENT), (1500, sd.SEGMENT)])
def test_equals_definition(spark, hot, segment):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (bytes(r["kept"]), len(r["removed"])) for r in sd.remove_repeats(df, hot=hot).collect()}
    rows.sort()
    want = plain([(i, (t or "").encode()) for i, t in rows])
    assert got == {i: w for (i, _), w in zip(rows, want, strict=True)}


def test_spans_are_what_is_missing(spark):
    df = spark.createDataFrame([(1, "x" * 250, 7), (2, "y" * 30 + "x" * 120 + "z", 8)], "doc_id long, text string, kept int").withColumn("removed", F.lit("other"))
    out = {r["doc_id"]: r for r in sd.remove_repeats(df).collect()}
    assert [tuple(x) for x in out[1]["removed"]] == [(1, 250)] and bytes(out[1]["kept"]) == b"x"
    assert [tuple(x) for x in out[2]["removed"]] == [(30, 150)] and bytes(out[2]["kept"]) == b"y" * 30 + b"z"


def test_repeated_and_null_ids(spark):
    text, other = "lorem ipsum " * 3 + "abcdefgh" * 20, "dolor sit amet " * 9
    rows = [(5, text), (5, text), (5, other), (None, text), (None, text), (7, None), (6, other)]
    out = sorted((r[0] if r[0] is not None else 99, r[1], r[2]) for r in sd.removed_bytes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed").collect())
    alone = {t: len(t) - len(plain([(0, t.encode())])[0][0]) for t in (text, other)}
    assert out == sorted([(5, len(text), alone[text])] * 2 + [(5, len(other), alone[other]), (6, len(other), len(other)), (7, 0, 0)] + [(99, len(text), len(text))] * 2)


def test_empty_table_and_bad_sizes(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sd.removed_bytes(empty).collect() == []
    with pytest.raises(ValueError):
        sd.remove_repeats(empty, gram=24)


def test_query_digests(spark):
    text = "".join(random.Random(1).choices("abcdef", k=180))
    row = sd.removed_bytes(spark.createDataFrame([(1, text), (2, "<" + text + ">")], "doc_id long, text string")).where("doc_id = 2").first()
    assert tuple(row) == (2, 182, 180, 1, hashlib.sha256(b"<>").hexdigest())


def test_chunks_cover_each_window_once():
    rng = random.Random(2)
    texts = [bytes(rng.choices(b"abc", k=k)) for k in (0, 99, 100, 250, 70_000, 300_000, 5, 1000)] + [b"", b"q" * 3000]
    offsets = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    seen = np.zeros(len(data), dtype=int)
    for begins, sizes, _, _ in sd.chunks(data, offsets, 100, 32, twice=True):
        for b, n in zip(begins.tolist(), sizes.tolist(), strict=True):
            seen[b : b + n] += 1
    want = np.concatenate([np.arange(len(t)) + 100 <= len(t) for t in texts])
    assert (seen == want).all()


@pytest.mark.parametrize("local", [sd.LOCAL, 400])
def test_hot_strings_are_not_sent_window_by_window(spark, local):
    """Long lines of few symbols under one hot anchor make rows for their different windows, not for each byte, and equal the definition."""
    line = "the same line again and again, " * 90
    rows = [(i, line[i % 7 :] + "x" * (i % 5)) for i in range(40)] + [(40 + i, "a" * (1500 + i)) for i in range(10)] + [(60, line * 3), (60, line * 3), (61, line[5:400] + "?" + line)]
    docs = sd._based(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text")
    found = sd._occurrences(docs, "text", 100, 32)
    wanted = found.groupBy("a", "h", "n").agg(F.min(F.struct("d", "t", "s")).alias("o")).select("o.*", "n", "a", F.lit(True).alias("hot"))
    windows = wanted.agg(F.sum("n")).first()[0]
    assert windows > 20_000 and sd._pieces(docs, "text", wanted, 100, local).count() < windows / 5
    got = {r["doc_id"]: bytes(r["kept"]) for r in sd.remove_repeats(docs.select("doc_id", "text"), hot=1).collect()}
    texts = {i: t.encode() for i, t in rows}
    assert got == {i: w[0] for i, w in zip(texts, plain(list(texts.items())), strict=True)}
