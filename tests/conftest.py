import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def message(*fields: tuple[int, str], sep: str = "\x01", begin: str = "FIX.4.4") -> str:
    body = "".join(f"{t}={v}{sep}" for t, v in fields)
    head = f"8={begin}{sep}9={len(body.encode('latin-1'))}{sep}{body}"
    return head + f"10={sum(head.encode('latin-1')) % 256:03}{sep}"


@pytest.fixture(scope="session")
def msg():
    return message


@pytest.fixture
def log_of(spark, tmp_path):
    """A log from messages, each a list of fields or a whole text."""
    from fixlake.sources.log import read_log

    count = [0]

    def make(*rows, sep="\x01", **options):
        count[0] += 1
        path = tmp_path / f"{count[0]}.log"
        path.write_bytes("\n".join(r if isinstance(r, str) else message(*r, sep=sep) for r in rows).encode("latin-1") + b"\n")
        return read_log(spark, str(path), **options)

    return make
