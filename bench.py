"""Headline operators over a log on disk, rendered once from the tables at $BENCH_SF_DIR (not timed), on local[$BENCH_CPUS]; prints one JSON line.

`save` frames the log, takes its tags and writes it as columns; `scan_*` frame the text on disk as a part of their time. All others read the saved log, as an index is read: each makes all
of its rows. `consolidated_text` is consolidation from the text on disk.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    from pyspark.sql import SparkSession

    from fixlake.functions.tokens import read, tag
    from fixlake.operators import consolidate, histogram, orders, sessions, stats
    from fixlake.operators.views import filtered
    from fixlake.plans.dsl import to_column
    from fixlake.sources import synth
    from fixlake.sources.log import read_log, scan_lines

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def rendered(folder: str, sf_dir: str) -> str:
        table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        lines = synth.order_flow(table("orders"), table("lineitem"))
        lines.repartitionByRange(int(CPUS), "pos").sortWithinPartitions("pos").select("record").write.text(f"{folder}/parts")
        with open(f"{folder}/orders.log", "wb") as out:
            for part in sorted(p for p in os.listdir(f"{folder}/parts") if p.startswith("part-")):
                with open(f"{folder}/parts/{part}", "rb") as one:
                    out.write(one.read())
        return f"{folder}/orders.log"

    def queries(path: str) -> dict:
        log = read_log(spark, path)
        saved = []
        stored = lambda: saved[0].messages
        return {
            "save": lambda: saved.append(log.save(f"{os.path.dirname(path)}/saved")),
            "scan_native": lambda: scan_lines(spark, path, log.format).where(to_column("35=D")).select(tag(11)),
            "scan_exact": lambda: log.messages.where(to_column("35=D")).select("ordinal", tag(11)),
            "consolidated_text": lambda: consolidate.consolidated(log.messages),
            "filter_eq": lambda: filtered(stored(), "35=D").select("ordinal", read(stored(), 11)),
            "filter_regex": lambda: filtered(stored(), '11~"^O[0-9]*7$"').select("ordinal"),
            "message_types": lambda: stats.message_types(stored()),
            "sessions": lambda: sessions.sessions(stored()),
            "histogram": lambda: histogram.histogram(stored(), 60_000_000_000),
            "clordid_top": lambda: stats.order_counts(stored()),
            "timeline": lambda: orders.timeline(stored(), "O1"),
            "consolidated": lambda: consolidate.consolidated(stored()),
        }

    took = {}
    with tempfile.TemporaryDirectory() as small, tempfile.TemporaryDirectory() as folder:
        warm = "/root/testdata/sf0.001" if os.path.isdir("/root/testdata/sf0.001") else SF_DIR
        path = rendered(folder, SF_DIR)
        for name, make in [*((None, m) for m in queries(rendered(small, warm)).values()), *queries(path).items()]:
            began = time.perf_counter()
            made = make()
            if made is not None:
                made.write.format("noop").mode("overwrite").save()
            if name:
                took[name] = round(time.perf_counter() - began, 3)
        size = round(os.path.getsize(path) / 1e6, 1)
    print(json.dumps({"metric": "seconds of all headline operators", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")), "log_mb": size}))


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    main()
