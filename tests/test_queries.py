import os
import sys

import pytest

import __spark_entry__ as entry
from fixlake import queries
from tests.oracle import connect, rows

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@needs_data
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_equals_sql(spark, name):
    got = rows(queries.QUERIES[name](spark, SF).toPandas())
    if name in queries.ORACLE_SQL:
        assert got == rows(connect(SF).sql(queries.ORACLE_SQL[name]).df())
    else:
        assert got[1]


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_optional_part(tmp_path):
    import subprocess

    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('fixlake.llm'):\n"
        "            raise ModuleNotFoundError(name, name='fixlake.llm' if name.startswith('fixlake.llm') else name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "assert 'consolidated' in e.queries() and not [q for q in e.queries() if q.startswith('op')] and 'pipeline' not in e.queries()\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("gzip", [False, True])
def test_a_log_grows_from_its_parts(spark, gzip):
    from pyspark.sql import functions as F

    rows = spark.range(3000).select(F.col("id").alias("pos"), F.concat(F.lit("m"), F.xxhash64("id").cast("string")).alias("record"))
    parts = queries._written(spark, rows, gzip=gzip)
    whole = "".join(r.record + "\n" for r in rows.collect()).encode()
    got = []
    for share in (0.0, 0.6, 1):
        queries._grown(spark, f"{parts}.log", parts, share)
        with open(f"{parts}.log".removeprefix("file://"), "rb") as log:
            got.append(log.read())
    assert got[0] == b"" and got[2] == whole and whole.startswith(got[1]) and 0.55 < len(got[1]) / len(whole) < 0.65


@needs_data
def test_a_followed_log_is_not_held_twice(spark, monkeypatch):
    """Parts that are yet to come wait compressed; when the orders have all of the log, neither they nor the log are left."""
    from fixlake.sources.frames import file_sizes

    made = {}

    def grown(spark, path, parts, share, f=queries._grown):
        f(spark, path, parts, share)
        made.setdefault(path, []).append((file_sizes(spark, [path])[0][1], sum(n for _, n in file_sizes(spark, [parts]))))
        made["parts"] = parts

    monkeypatch.setattr(queries, "_grown", grown)
    assert queries.followed_consolidated(spark, SF).count() > 0
    parts = made.pop("parts")
    (path, sizes), = made.items()
    assert sizes[-1][1] < sizes[-1][0] / 3 and sizes[0][0] < sizes[1][0]
    assert not [p for p in (path, parts) if os.path.exists(p.removeprefix("file://"))]
