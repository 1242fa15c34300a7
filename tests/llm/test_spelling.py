import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fixlake.llm import spelling as sp


def edited(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_words(rows, least=7):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2 and len(w) >= least}


def plain_forms(words):
    near = {w: [x for x in words if edited(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 10 * n:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


def test_words_of_texts(spark):
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdeéñÀ", k=rng.randint(5, 12))) for _ in range(60)]
    ends = [" ", ".", "\n", "ā", "€", "1", "¿", "中", "-"]
    rows = [(i, "".join(rng.choice((str.upper, str))(rng.choice(base)) + rng.choice(ends) for _ in range(80))) for i in range(60)]
    rows += [(1, None), (2, ""), (None, "Repeated repeated ×××××××"), (3, rows[3][1]), (3, rows[3][1]), (4, "×" * 7), (5, "plainascii Plainascii " * 3), (6, "x" * 9_000_000), (6, ("longer words " * 700_000))]
    got = {r["word"]: r["n"] for r in sp.words(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == plain_words(rows)


@pytest.mark.parametrize("tile", [sp.TILE, 3])
def test_equals_definition(spark, tile):
    rng = random.Random(8)
    roots = ["".join(rng.choices("abcdeno", k=rng.randint(8, 12))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "abababab", "élèveabc"]
    words = Counter()
    for root in roots:
        words[root] = rng.choice([5, 200, 3000])
        for _ in range(12):
            w = list(root)
            for _ in range(rng.randint(1, 2)):
                i = rng.randrange(len(w))
                rng.choice((lambda: w.insert(i, rng.choice("abx")), lambda: w.pop(i), lambda: w.__setitem__(i, rng.choice("aby"))))()
            if len(w) >= 7:
                words["".join(w)] = rng.choice([2, 20, 20, 300])
    words["z" * 3000] = 50
    words["z" * 2999] = 2
    got = sp.spelling_forms(spark.createDataFrame(list(words.items()), "word string, n long").repartition(4), tile=tile)
    want = plain_forms(words)
    assert {tuple(r) for r in got.collect()} == want and any(r[2] != r[1] for r in want if r[1])


def test_chains_and_ties(spark):
    words = {"abcdefg": 1, "abcdefgh": 10, "abcdefghi": 100, "abcdefghij": 1000, "abcdefghijk": 10000, "mnopqrs": 5, "mnopqrt": 50, "mnopqru": 50, "vwvwvwv": 9, "vwvwvww": 89}
    got = {r["word"]: (r["form"], r["root"], r["n_near"], r["form_n"]) for r in sp.spelling_forms(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got["abcdefg"] == ("abcdefgh", "abcdefghijk", 1, 10) and got["abcdefghij"] == ("abcdefghijk", "abcdefghijk", 2, 10000)
    assert got["mnopqrs"] == ("mnopqrt", "mnopqrt", 2, 50) and got["mnopqrt"] == (None, "mnopqrt", 2, None) and got["vwvwvwv"] == (None, "vwvwvwv", 1, None)


def test_near_words_share_a_signature():
    rng = random.Random(6)
    for _ in range(300):
        a = rng.choices(range(97, 103), k=rng.randint(7, 12))
        b = list(a)
        i = rng.randrange(len(b))
        kind = rng.randrange(3)
        if kind == 0:
            b.insert(i, 120)
        elif kind == 1 and len(b) > 7:
            b.pop(i)
        else:
            b[i] = 121
        x, y = (sp.signatures(np.array([w], dtype=np.uint32), 5, 3)[0] for w in (a, b))
        shared = np.flatnonzero(x == y)
        assert len(shared)
        points, lengths = np.array(a + b, dtype=np.uint32), np.array([len(a), len(b)])
        found = [q for q in shared if len(sp.near_in(points, lengths, np.array([0]), np.array([1]), np.array([q]), 5, 3)[0])]
        assert found == [shared[0]]


def test_empty_table(spark):
    assert sp.spelling_variants(spark.createDataFrame([], "doc_id long, text string, word string, n long")).collect() == []


def test_subsets_leave_out_two_parts():
    assert all(any(not set(s) & set(d) for s in sp._subsets(5)) for d in itertools.combinations(range(5), 2))
