import random

import numpy as np
import pytest

from fixlake.functions.graph import connected_components
from fixlake.llm import near_copies
from tests.llm.test_dedup import components


def plain_shingles(text) -> frozenset:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, vocabulary, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
    return words


@pytest.fixture(scope="module")
def corpus():
    """Near copies of similarities clear of the threshold, odd rows, and unlike texts that share half of their words."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one two"), (5, "ONE\ttwo"), (6, "one two three four five"), (7, "one two three four five six seven")]
    shared = [rng.choice(vocabulary) for _ in range(150)]
    for i in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(150, 500))]
        at = 100 + 10 * i
        rows += [(at, " ".join(base)), (at + 1, " ".join(base).upper()), (at + 2, " ".join(edited(rng, base, vocabulary, 1)))]
        rows += [(at + 3, " ".join(edited(rng, base, vocabulary, len(base) // 8))), (at + 4, " ".join([*shared, *edited(rng, base[:150], vocabulary, 60)]))]
    long = [rng.choice(vocabulary) for _ in range(30_000)]
    rows += [(900, " ".join(long)), (901, " ".join(edited(rng, long, vocabulary, 200)))]
    sets = {i: plain_shingles(t) for i, t in rows}
    return rows, sets


def test_components_equal_exact_similarity(spark, corpus):
    rows, sets = corpus
    between = [s for i in sets for j in sets if i < j and 0.74 < (s := alike(sets[i], sets[j])) < 0.83]
    assert not between  # the estimate decides near the threshold only
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, fp string, component int, same string")
    found = near_copies.near_components(df).collect()
    want = components(sets, lambda a, b: alike(a, b) >= 0.8)
    assert len(found) == len(rows) and {r.doc_id: r.component for r in found} == want
    kept = near_copies.keep_first(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in want if want[i] == i}
    assert near_copies.near_components(df.limit(0)).collect() == [] and near_copies.keep_first(df.limit(0)).collect() == []


def test_tiles_lose_no_link(spark):
    """A key whose rows are spread over tile pairs, and blocks with more groups than pivots, link as brute force does."""
    rng = np.random.default_rng(6)
    prints = []
    for _ in range(30):
        base = rng.integers(0, 2, 1024, dtype=np.uint8)
        for _ in range(15):
            bits = base.copy()
            bits[rng.choice(1024, rng.integers(0, 120), replace=False)] ^= 1
            prints.append(np.packbits(bits, bitorder="little").tobytes())
    fps = np.frombuffer(b"".join(prints), dtype="<u8").reshape(-1, 16)
    nodes = dict(enumerate(fps))
    want = components(nodes, lambda a, b: int(np.bitwise_count(a ^ b).sum()) <= near_copies.RADIUS)
    assert len(set(want.values())) >= 30
    df = spark.createDataFrame([(i, p, [1, 2 + i % 3]) for i, p in enumerate(prints)], "node long, fp binary, keys array<long>")
    for tile in (40, 10_000):
        found = {r.node: r.component for r in connected_components(near_copies.near_links(df, tile=tile)).collect()}
        assert {i: found.get(i, i) for i in nodes} == want
    for step, pivots in ((7, 0), (64, 3)):
        for sides in (np.zeros(len(fps), dtype=int), np.arange(len(fps)) % 2):
            pairs = [(int(a), int(b)) for x, y in near_copies.block_pairs(fps, sides, near_copies.RADIUS, step, pivots) for a, b in zip(x, y, strict=True)]
            assert all(np.bitwise_count(fps[a] ^ fps[b]).sum() <= near_copies.RADIUS for a, b in pairs)
            if not sides.any():
                known = near_copies.spanning(len(fps), [(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))])
                assert len(known) == len(fps) - len(set(want.values()))


def test_odd_rows(spark):
    rows = [(None, "a b c"), (None, "a b c"), (5, "a b c"), (5, "q r s t"), (9, "q r s t"), (9, "q r s t"), (7, "z z z z z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_copies.near_components(df).collect()
    assert len(got) == 7 and {(r.doc_id, r.component) for r in got} == {(None, None), (5, 5), (9, 5), (7, 7)}
    kept = [r.doc_id for r in near_copies.keep_first(df).collect()]
    assert sorted(k for k in kept if k is not None) == [5, 7] and kept.count(None) == 2


def test_recall_near_the_threshold():
    """Of sets of similarity 0.8 to 0.85, nine in ten or more share a key and lie within the radius; of those below 0.7, few do."""
    rng = np.random.default_rng(7)
    hit, total, wrong, low = 0, 0, 0, 0
    for _ in range(400):
        size, similar = int(rng.integers(60, 600)), rng.choice([0.8, 0.85, 0.68])
        common = round(2 * similar / (1 + similar) * size)
        x = rng.integers(0, 1 << 63, 2 * size - common, dtype=np.uint64)
        (f, a), (g, b) = near_copies.wide_fingerprint(x[:size]), near_copies.wide_fingerprint(x[size - common :])
        found = bool(set(near_copies.block_keys(a)) & set(near_copies.block_keys(b))) and int(np.bitwise_count(f ^ g).sum()) <= near_copies.RADIUS
        if similar >= 0.8:
            hit, total = hit + found, total + 1
        else:
            wrong, low = wrong + found, low + 1
    assert hit / total >= 0.9 and wrong / low <= 0.02


def test_pairs_at_the_threshold_are_decided_exactly(spark):
    """Pairs of exactly 0.8 link whatever their size, pairs just below do not; the fingerprints of many lie on the other side."""
    rng, rows = random.Random(8), []
    for trial in range(40):
        for common, more, fewer in ((4, 1, 0), (8, 1, 1), (20, 5, 0), (28, 7, 0), (40, 5, 5), (120, 30, 0), (15, 4, 0), (39, 5, 5), (300, 80, 0)):
            words = [f"w{trial}-{common}-{more}-{rng.random()}" for _ in range(common + 4 + more + fewer)]
            at = len(rows)
            rows += [(at, " ".join(words[fewer:])), (at + 1, " ".join(words[: len(words) - more]))]
    sets = {i: plain_shingles(t) for i, t in rows}
    want = {i: alike(sets[i], sets[i + 1]) >= 0.8 for i in range(0, len(rows), 2)}
    assert len(set(want.values())) == 2
    meet = {i: bool(set(near_copies.describe(rows[i][1])[2]) & set(near_copies.describe(rows[i + 1][1])[2])) for i in want}
    found = {r.doc_id: r.component for r in near_copies.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i + 1] == (i if want[i] and meet[i] else i + 1) for i in want)
    assert sum(meet[i] for i in want if want[i]) >= 0.97 * sum(want.values())


def unlike(rng, n, words=300, changed=9):
    """Texts that differ from one another in scattered words, so that they are near the threshold but below it."""
    base = [f"b{i}" for i in range(words)]
    return [(i, " ".join(edited(rng, base, [f"x{i}y{k}" for k in range(40)], changed))) for i in range(n)]


@pytest.mark.parametrize("tile", [near_copies.SET_TILE, 20])
def test_groups_just_below_the_threshold_make_no_rows(spark, tile):
    rows = unlike(random.Random(9), 120)
    rows += [(1000 + i, t + f" tail{i}") for i, t in rows[:10]]  # and a few links among them
    sets = {i: plain_shingles(t) for i, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marked = near_copies.per_row(df, ["doc_id", "text"], lambda k, t: (k, *near_copies.describe(t)), "doc_id long, same binary, fp binary, keys array<long>, size long")
    nodes = marked.selectExpr("doc_id AS node", "fp", "keys", "size", "doc_id AS group")
    links = [(r.src, r.dst) for r in near_copies.wide_links(nodes, df.selectExpr("doc_id AS node", "text"), tile).collect()]
    want = components(sets, lambda a, b: alike(a, b) >= 0.8)
    assert all(alike(sets[a], sets[b]) >= 0.8 for a, b in links) and 10 <= len(set(links)) < 100
    assert {r.doc_id: r.component for r in near_copies.near_components(df).collect()} == want
    assert sum(1 for i in want if want[i] != i) >= 10


def test_texts_of_rows_that_meet_none_are_not_gathered(spark, monkeypatch):
    """Links are looked for among the rows that share a key only, and their texts are gathered once for both rounds."""
    rng = random.Random(11)
    rows = [(i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(60))) for i in range(200)]
    rows += [(500 + i, rows[i][1] + " tail") for i in range(6)]
    seen = {}
    for name in ("near_links", "wide_links"):
        monkeypatch.setattr(near_copies, name, lambda *a, name=name, inner=getattr(near_copies, name): (seen.update({name: [d.select("node").distinct().count() for d in a if hasattr(d, "select")]}), inner(*a))[1])
    found = {r.doc_id: r.component for r in near_copies.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: i - 500 if i >= 500 else i for i, _ in rows}
    assert seen["near_links"] == [12] and seen["wide_links"] == [12, 12]
