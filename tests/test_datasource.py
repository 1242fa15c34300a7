import json

import pytest
from pyspark.sql import functions as F
from tests.conftest import message

from fixlake.functions.tokens import read
from fixlake.sources.datasource import FixReader, batches, register
from fixlake.sources.log import read_log


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    out = []
    for i in range(300):
        row = [(35, "D8G"[i % 3]), (49, "AB"[i % 2]), (56, "GW"), (34, str(i)), (11, f"O{i % 20}")] + [(58, "caf\xe9")] * (i % 17 == 0) + [(37, f"X{i}")] * (i % 3 == 1)
        out.append(message(*row).replace("\x0156=", "\x01x56=", 1) if i % 31 == 7 else message(*row))
    path = tmp_path_factory.mktemp("fix") / "a.log"
    path.write_bytes("\n".join(out).encode("latin-1"))
    return str(path)


@pytest.fixture
def load(spark, path):
    register(spark)
    return lambda **options: spark.read.format("fix").options(path=path, range_size="3000", **options).load()


def rows(frame):
    return sorted(map(repr, frame.collect()))


FILTERS = ["t35 = 'D'", "t35 IN ('D', '8') AND t49 = 'A'", "t37 IS NULL", "t37 IS NOT NULL AND t11 LIKE 'O1%'", "t11 LIKE '%5'", "t58 <=> 'x'", "t11 LIKE '%1%' AND t34 > 100", "NOT t35 = 'D'", "t35 <> 'D' OR t37 = 'X4'",
           "t58 = 'x'", "NOT t37 = 'X4'", "raw LIKE '%11=O7%'", "offset = 0", "offset > 5000"]


@pytest.mark.parametrize("where", FILTERS)
def test_equals_read_log(spark, path, load, where):
    log = read_log(spark, path).messages
    every = log.select("offset", *[read(log, t).alias(f"t{t}") for t in (35, 49, 34, 11, 37)], F.when(read(log, 58).isNotNull(), "y").alias("t58"), "raw")
    assert rows(load().where(where).select("offset", "t35", "t11")) == rows(every.where(where).select("offset", "t35", "t11"))


def test_filters_are_pushed(spark, load):
    """What is pushed Spark doesn't apply again, what isn't it does."""
    rows = load().where("t35 = 'D' AND t49 IN ('A', 'C') AND t34 > 100")
    plan = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    pushed, kept = (plan.split(name)[1].split("\n")[0] for name in ("PushedFilters:", "Condition :"))
    assert "EqualTo(t35,D)" in pushed and "In(t49" in pushed and "t34" in kept and "t35" not in kept


def test_pushed_filters_make_no_rows(path):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = FixReader([path], None, None, 5000)
    left = list(reader.pushFilters([EqualTo(("t37",), "X4"), GreaterThan(("t34",), "1")]))
    assert len(left) == 1 and len(reader.partitions()) > 3
    assert sum(b.num_rows for span in reader.partitions() for b in batches(span, reader.filters)) == 1


def test_a_batch_ends_where_a_stream_stands(spark, path, load, tmp_path):
    register(spark)
    live = tmp_path / "live.log"
    data = open(path, "rb").read()
    live.write_bytes(data[: len(data) // 2])
    stream = spark.readStream.format("fix").option("path", str(live)).load().where("t35 = 'D'")
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    offsets = json.loads(sorted((tmp_path / "cp/offsets").glob("[0-9]*"))[-1].read_text().split("\n")[2])
    live.write_bytes(data)
    until = spark.read.format("fix").option("path", str(live)).option("until", json.dumps(offsets)).load().where("t35 = 'D'")
    assert rows(until) == rows(spark.read.schema(until.schema).parquet(str(tmp_path / "out"))) and 30 < until.count() < load().where("t35 = 'D'").count()
