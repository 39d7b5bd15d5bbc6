"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS], one JSON line: the best of three warm runs of each.

Beside them the file job, as like as can be to the one whose times are published: a day of 300 files with a line every
three seconds, from files to the day's CSV. Its seconds are in queries, its rows and rows a second beside them.
"""

from __future__ import annotations

import json
import os
import random
import shutil
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

from tickfold.plans.catalogue import QUERIES
from tickfold.plans.job import factor_job

NAMES = ("cross_mean_all", "cross_partial_final", "lag_prev", "lag_prewindow_carry", "session_filter", "book_depth", "alpha_16", "alpha_19", "dup_rows_averaged", "gappy_mean", "parse_lines", "validate_verdict", "day_partitioned_sorted", "runtime_stats", "runtime_hist")
#: Rounds after the first, which also compiles.
RUNS = 3
#: Files and the days they are of; the sessions' seconds, from five minutes before.
STOCKS, DAYS = 300, ("0102",)
TICKS = (*range(33_900, 41_401, 3), *range(46_800, 54_001, 3))


def write_tree(root: Path) -> int:
    """Files <day>/<stock>/snapshot.csv, of eight different contents; how many lines of data there are."""
    dice, contents = random.Random(1), []
    for _ in range(8):
        lines = ["tradingDay,tradeTime" + "".join(f",c{i}" for i in range(2, 57))]
        for sec in TICKS:
            px = dice.randint(100_000, 200_000)
            book = [str(x) for level in range(10) for x in (px - level, dice.randint(100, 9999), px + 1 + level, dice.randint(100, 9999))]
            clock = f"{sec // 3600:02d}{sec // 60 % 60:02d}{sec % 60:02d}"
            lines.append(",".join([f"2024{DAYS[0]}", clock, clock + "000", "XSHE", "000001", *["12345"] * 7, str(dice.randint(1, 10**7)), str(dice.randint(1, 10**7)), "1", "1", "0", *book]))
        contents.append("\n".join(lines) + "\n")
    for day in DAYS:
        for stock in range(STOCKS):
            folder = root / day / f"{stock:06d}"
            folder.mkdir(parents=True)
            (folder / "snapshot.csv").write_text(contents[stock % 8])
    return len(DAYS) * STOCKS * len(TICKS)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    best: dict[str, float] = {}
    scratch = Path(tempfile.mkdtemp(prefix="bench-"))
    try:
        rows = write_tree(scratch / "tree")
        for k in range(1 + RUNS):
            for name in NAMES:
                began = time.time()
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                took = time.time() - began
                best[name] = min(best.get(name, took), took) if k else took
            took = factor_job(spark, str(scratch / "tree"), str(scratch / f"out{k}"))
            best["file_job_300_files"] = min(best["file_job_300_files"], took) if k else took
    finally:
        shutil.rmtree(scratch)
    best = {k: round(v, 3) for k, v in best.items()}
    job = best["file_job_300_files"]
    print(json.dumps({"metric": "order-book factor queries and the file job, total of best warm runs", "value": round(sum(best.values()), 3), "unit": "sec", "queries": best, "sf": sf_dir.rstrip("/").rpartition("sf")[2], "file_job_rows": rows, "file_job_rows_per_sec": round(rows / job)}))


if __name__ == "__main__":
    main()
