"""Headline runs on dump files made from the benchmark tables; prints one JSON line.

The dump files are written before the clock starts.  Every run goes from compressed
files to published output; the figure is the median of three runs after a warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import dump_fixtures as fx
from dumpsieve.operators.counters import per_file_stats
from dumpsieve.operators.predicates import tag_matches
from dumpsieve.functions.json_lines import parse_ndjson
from dumpsieve.plans.csv_run import run_csv
from dumpsieve.plans.filter_run import run_filter, write_lines
from dumpsieve.sources.scan import ingest, only_lines, read_staged, scan_dump_lines, shared_folder
from dumpsieve.specs import CsvSpec, FilterSpec

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
COPIES = int(os.environ.get("BENCH_COPIES", "1"))  # how often the lines are repeated


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def events(spark: SparkSession) -> DataFrame:
    line = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("subreddit"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("author"), F.col("props").alias("body"),
        F.col("value").alias("score"), F.unix_timestamp("ts").alias("created_utc"),
    ))
    return fx.table(spark, SF_DIR, "events").select(line.alias("value"))


def write_dump_files(spark: SparkSession) -> str:
    """Folders ``docs``, ``talk`` and ``events``, each of one file per CPU."""
    root = shared_folder(spark, "bench")
    lines = {"docs/RS": fx.submissions(spark, SF_DIR), "talk/RC": fx.comments(spark, SF_DIR), "events/RC": events(spark)}
    for name, rows in lines.items():
        copied = rows.select("value", F.explode(F.sequence(F.lit(1), F.lit(COPIES))).alias("copy"))
        dealt = copied.repartition(int(CPUS)).withColumn("part", F.spark_partition_id().cast("string"))
        folder, prefix = name.split("/")
        write_lines(dealt.select(F.concat(F.lit(prefix + "_"), "part", F.lit(".zst")).alias("out"), "value"), f"{root}/{folder}")
    return root


def main() -> None:
    spark = session()
    root = write_dump_files(spark)
    staged = shared_folder(spark, "bench-staged")
    ingest(spark, f"{root}/docs", staged)

    def fresh() -> str:
        return shared_folder(spark, "bench-out")

    def matching(folder: str, **options):
        return lambda: run_filter(spark, f"{root}/{folder}", fresh(), FilterSpec(**options))

    def tabled(folder: str):
        return lambda: run_csv(spark, f"{root}/{folder}", fresh(), CsvSpec())

    def sunk(make):
        return lambda: make().write.format("noop").mode("overwrite").save()

    exact = FilterSpec("subreddit", "src7")
    runs = {
        "filter_exact": matching("docs", field="subreddit", value="src7"),
        "filter_partial": matching("docs", field="selftext", value="tion des", partial=True),
        "filter_regex": matching("docs", field="selftext", value=r"(?i)\bth[a-z]+ing\b", regex=True),
        "filter_events": matching("events", field="subreddit", value="purchase"),
        "csv_submissions": tabled("docs"),
        "csv_comments": tabled("talk"),
        "csv_events": tabled("events"),
        "match_from_zst": sunk(lambda: tag_matches(only_lines(scan_dump_lines(spark, f"{root}/docs")), exact).where("matched")),
        "match_from_staged": sunk(lambda: tag_matches(only_lines(read_staged(spark, staged)), exact).where("matched")),
        "per_file_stats": sunk(lambda: per_file_stats(parse_ndjson(only_lines(scan_dump_lines(spark, f"{root}/events")), []))),
    }
    counts = {f: only_lines(scan_dump_lines(spark, f"{root}/{f}")).count() for f in ("docs", "talk", "events")}
    seconds = {}
    for name, run in runs.items():
        run()
        times = []
        for _ in range(3):
            began = time.perf_counter()
            run()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    rates = {}
    for name, took in seconds.items():
        folder = "events" if "events" in name or name == "per_file_stats" else "talk" if "comments" in name else "docs"
        rates[name] = round(counts[folder] / took)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "lines_per_sec": rates, "sf": os.path.basename(SF_DIR.rstrip("/")),
        "cpus": int(CPUS), "copies": COPIES,
    }))


if __name__ == "__main__":
    main()
