"""Compare queries with their SQL over the same tables: python tests/oracle.py SF_DIR [NAME...]"""

import decimal
import numbers
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (numbers.Number, decimal.Decimal)) and not isinstance(v, bool) else v
    return list(frame.columns), sorted(repr([plain(v) for v in r]) for r in frame.astype(object).where(frame.notna(), None).values.tolist())


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main(sf_dir, names):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), entry.oracle_sql()
    for name, f in entry.queries().items():
        if names and name not in names or not names and (name.startswith("op") or name == "pipeline"):
            continue
        began = time.time()
        try:
            got = rows(f(spark, sf_dir).toPandas())
            took = time.time() - began
            want = rows(con.sql(sql[name]).df()) if name in sql else None
        except Exception as error:  # noqa: BLE001
            print(name, "ERROR", str(error)[:600], flush=True)
            continue
        verdict = "rows only" if want is None else "ok" if got == want else "DIFFERENT"
        print(f"{name}: {verdict}, {len(got[1])} rows, {took:.1f} s", flush=True)
        if verdict == "DIFFERENT":
            print("  ", got[0], want[0], len(want[1]))
            for a, b in [(a, b) for a, b in zip(got[1], want[1], strict=False) if a != b][:2]:
                print("   got ", a[:400], "\n   want", b[:400])


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
