import random

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

from fixlake.functions.graph import connected_components
from fixlake.llm import blocks, embedding_dedup, line_dedup, simhash


def plain_fingerprint(text) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes: dict, linked) -> dict:
    names = sorted(nodes)
    up = {n: n for n in names}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if linked(nodes[a], nodes[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {n: top(n) for n in names}


def test_simhash_equals_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one two"), (5, "É x\x85y z"), (6, "one"), (7, "ONE\ttwo")]
    for i in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        rows += [(100 + 10 * i, " ".join(base)), (101 + 10 * i, " ".join([*base, "end"])), (102 + 10 * i, " ".join(base).upper())]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_dedup(df).collect()}
    prints = {i: plain_fingerprint(t) for i, t in rows}
    want = components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints} and got[0][1] == got[1][1] == got[2][1] == 0
    assert simhash.simhash_dedup(df.limit(0)).collect() == []


def test_simhash_finds_every_pair_in_tiles(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = set()
    for b in base:
        for _ in range(60):
            x = int(b)
            for bit in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(bit)
            prints.add(x)
    nodes = dict(enumerate(sorted(prints)))
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in nodes.items()], "node long, fp long")
    want = components(nodes, lambda a, b: (a ^ b).bit_count() <= 3)
    for tile in (10, 10_000):
        found = {r.node: r.component for r in connected_components(simhash.near_links(df, tile=tile)).collect()}
        assert {i: found.get(i, i) for i in nodes} == want


def test_simhash_odd_rows(spark):
    rows = [(None, "a b c"), (None, "a b c"), (5, "a b c"), (5, "q r s t"), (9, "q r s t"), (9, "q r s t"), (7, "z z z z z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.simhash_dedup(df).collect()
    assert len(got) == 7 and {(r.doc_id, r.component_id) for r in got} == {(None, None), (5, 5), (9, 5), (7, 7)}
    kept = [r.doc_id for r in simhash.keep_first(df).collect()]
    assert sorted(k for k in kept if k is not None) == [5, 7] and kept.count(None) == 2


def test_blocks_meet_once(spark):
    df = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 3), (3, 1)) for i in range(n)], "k long, id long")
    out = blocks.dealt(df, "k", "id", 10).toPandas()
    for k, n in ((1, 50), (2, 3)):
        met = {}
        for _, g in out[out.k == k].groupby(["_i", "_j"]):
            ids, side, two = g.id.tolist(), g._side.tolist(), g._i.iloc[0] != g._j.iloc[0]
            for x in range(len(ids)):
                for y in range(x):
                    if not two or side[x] != side[y]:
                        met[frozenset((ids[x], ids[y]))] = met.get(frozenset((ids[x], ids[y])), 0) + 1
        assert len(met) == n * (n - 1) // 2 and set(met.values()) == {1}


@pytest.mark.parametrize("edges", [[], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], [(5, 5), (None, 3), (2, 1)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    nodes = {x: x for e in real for x in e}
    want = components(nodes, lambda a, b: (a, b) in real or (b, a) in real)
    assert got == want


def documents(seed=0, n=60):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefg") * rng.randint(1, 4) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    passages = [[rng.choice(pool) for _ in range(rng.randint(3, 9))] for _ in range(5)] + [[" ".join(f"word{i}" for i in range(60))]]
    rows = []
    for i in range(n):
        lines = [rng.choice(pool) + str(rng.random()) for _ in range(rng.randint(0, 8))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(lines))
            lines[at:at] = rng.choice(passages)
        rows.append((i, "\n".join(lines)))
    return [*rows, (n, rows[3][1]), (n + 1, ""), (n + 2, "\n\n\n"), (n + 3, "\n\n\n"), (n + 4, "x\n" * 500)]


def test_lines_equal_sql(spark):
    rows = documents()
    got = {(r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()}
    frame = pd.DataFrame(rows, columns=["doc_id", "text"])
    con = duckdb.connect()
    con.register("documents", frame)
    want = set(con.sql(line_dedup.SQL).fetchall())
    assert got == want and sum(n for _, _, n in got) > 20
    again = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert again == {i: t for i, t, _ in got}


def test_long_passage_goes_but_for_its_first_place(spark):
    passage = " ".join(f"word{i}" for i in range(55))
    rows = [(i, f"own line {i}\n{passage}\nlast line {i}") for i in range(5)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [passage in got[i] for i in range(5)] == [True, False, False, False, False] and got[4] == "own line 4\nlast line 4"


def test_lines_keep_other_columns_and_rows(spark):
    rows = [(1, None, "a"), (1, "p q\nr s", "b"), (1, "p q\nr s", "b"), (None, "p q\nr s", "c"), (2, "p q\nr s", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed string")
    got = sorted(map(tuple, line_dedup.dedup_lines(df).collect()), key=repr)
    assert got == sorted([(1, None, "a"), (1, "p q\nr s", "b"), (1, "p q\nr s", "b"), (None, "", "c"), (2, "", "d")], key=repr)
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


def test_lines_are_native(spark, capsys):
    line_dedup.dedup_lines(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")).explain()
    assert "Python" not in capsys.readouterr().out


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(150, 64))
    near = np.concatenate([b + 0.03 * rng.normal(size=(20, 64)) * np.linalg.norm(b) / 8 * 4 for b in base[:6]])
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.concatenate([base, near, base[:20], 2 * base[20:25]]))]
    return [*rows, (900, None), (901, []), (902, [0.0] * 64), (903, [float("nan")] * 64), (904, [None, 1.0]), (905, [1.0, 0.0]), (906, [1.0, 0.01])]


def test_embeddings_against_brute_force(spark):
    rows = vectors()
    good = {i: np.array(v, dtype=np.float64) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    pairs = {(a, b) for a in unit for b in unit if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95}
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int")
    for tile in (4096, 7):
        got = {r.vec_id: r for r in embedding_dedup.embedding_dedup(df, tile=tile).collect()}
        links = {i: sum(a == i for a, _ in pairs) for i, _ in rows}
        assert len(got) == len(rows) and all(got[i].n_links <= links[i] for i in got)
        assert sum(r.n_links for r in got.values()) >= 0.9 * len(pairs) and len(pairs) > 1000
        want = components({i: i for i, _ in rows}, lambda a, b: (a, b) in pairs)
        assert np.mean([got[i].component_id == want[i] for i in want]) >= 0.97 and all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (900, 901, 902, 903, 904)) and got[906].component_id == 905


def test_embeddings_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(1, v), (1, v), (2, v), (None, v), (3, [3.0, -2.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_dedup(df).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, False), (3, 0, 3, True)], key=repr)
    assert embedding_dedup.embedding_dedup(df.limit(0)).collect() == []


def test_embeddings_with_repeated_ids(spark):
    """Rows that share an id have the links of their own vectors, and one component."""
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 1.0, 0.01]), (7, [1.0, 0.0, 0.001]), (9, [0.0, 0.0, 1.0]), (9, None), (8, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, embedding_dedup.embedding_dedup(df).collect()))
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (7, 1, 1, False), (8, 0, 8, True), (9, 0, 9, True), (9, 0, 9, True)]


def test_embeddings_in_double_precision(spark):
    """Components beyond the range and the digits of 32-bit floats count."""
    turn = lambda x: [float(1e300 * np.cos(x)), float(1e300 * np.sin(x))]
    at = np.arccos(0.95)
    df = spark.createDataFrame([(1, turn(0.0)), (2, turn(at - 1e-9)), (3, turn(-at - 1e-9)), (4, [0.0, -1e-300])], "vec_id long, embedding array<double>")
    ladder = ((1 << 62, 1, 0.2, 40),)  # wide cells, so that every pair meets
    assert {r.vec_id: r.n_links for r in embedding_dedup.embedding_dedup(df, ladder=ladder).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}


def test_ladder_finds_planted_pairs():
    """Each line of the ladder finds nine of ten pairs of cosine 0.95 to 0.96 at least."""
    rng = np.random.default_rng(6)
    for size in (64, 384):
        a, b = rng.normal(size=(2, 600, size))
        a /= np.linalg.norm(a, axis=1)[:, None]
        b -= (a * b).sum(axis=1)[:, None] * a
        b /= np.linalg.norm(b, axis=1)[:, None]
        cosine = rng.uniform(0.95, 0.96, size=(600, 1))
        b = cosine * a + np.sqrt(1 - cosine**2) * b
        for _, blocks_, scale, tables in embedding_dedup.LADDER:
            (oa, pa_), (ob, pb) = (embedding_dedup.cell_keys(x, tables, blocks_, scale) for x in (a, b))
            pa_, pb = pa_.reshape(600, tables, -1), pb.reshape(600, tables, -1)
            met = (oa == ob) | (oa[:, :, None] == pb).any(axis=2) | (ob[:, :, None] == pa_).any(axis=2)
            assert met.any(axis=1).mean() >= 0.94, (size, blocks_, scale)


def test_e8_points_are_nearest():
    rng = np.random.default_rng(5)
    x = 2 * rng.normal(size=(200, 8))
    best, other = embedding_dedup.nearest_e8(x)
    roots = [np.array(p) for p in {tuple(s) for s in _roots()}]
    near = ((2 * x - best) ** 2).sum(axis=1)
    for r in roots:  # no neighbouring lattice point is nearer
        assert (((2 * x - (best + 2 * r)) ** 2).sum(axis=1) >= near - 1e-9).all()
    assert (((2 * x - other) ** 2).sum(axis=1) >= near - 1e-9).all()


def _roots():
    import itertools

    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            yield v
    for signs in itertools.product((0.5, -0.5), repeat=8):
        if sum(s < 0 for s in signs) % 2 == 0:
            yield list(signs)
