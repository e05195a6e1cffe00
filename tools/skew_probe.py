"""Measure how the skew-safe operators spread a hot user over tasks.

Usage: python tools/skew_probe.py [sf_dir]

Derives a skewed rating log from the fixture (a third of all rows re-assigned to
one user), then runs each operator and its naive ``Window.partitionBy(user)``
form with Spark's event log written to a fresh scratch folder.  For every
variant it reports the most shuffle records read by any single task: close to
the hot user's row count means the whole group sat in one task.  This is a
diagnostic, not a registered query.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time
from collections import defaultdict

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from pyspark.sql import SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def session(log_dir: str) -> SparkSession:
    return (SparkSession.builder.master("local[8]").appName("skew-probe")
            .config("spark.sql.shuffle.partitions", "32")
            .config("spark.sql.adaptive.enabled", "true")
            # keep all 32 shuffle partitions: with coalescing, AQE merges small stages
            # into a few tasks and the busiest task no longer reflects data placement
            .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.enabled", "false")
            .config("spark.eventLog.enabled", "true")
            .config("spark.eventLog.dir", log_dir)
            .config("spark.eventLog.compress", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())


def stage_balance(log_file: str, job_group: str) -> tuple[int, int, int]:
    """The busiest task over the shuffle stages of a job group: its records, the
    records of its stage, and the stage's task count."""
    jobs, stages_of = set(), {}
    per_stage = defaultdict(list)
    files = sorted(glob.glob(os.path.join(log_file, "*"))) if os.path.isdir(log_file) else [log_file]
    for path in files:
        for line in open(path):
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                props = ev.get("Properties", {})
                if props.get("spark.jobGroup.id") == job_group:
                    jobs.add(ev["Job ID"])
                    for sid in ev.get("Stage IDs", []):
                        stages_of[sid] = ev["Job ID"]
            elif kind == "SparkListenerTaskEnd" and ev.get("Stage ID") in stages_of:
                m = ev.get("Task Metrics") or {}
                rd = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                per_stage[ev["Stage ID"]].append(rd)
    worst = (0, 0, 0)  # (records of the busiest task, records of its stage, tasks of its stage)
    for recs in per_stage.values():
        if recs and max(recs) > worst[0]:
            worst = (max(recs), sum(recs), len(recs))
    return worst


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="skew-probe-events-")
    spark = session(log_dir)
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skew-probe-ckpt-"))
    from cinelytics import fixtures as fx
    from cinelytics.operators import model as mdl
    from cinelytics.operators import recommend as rec
    from cinelytics.plans.ranking import row_number_within, running_max_within

    ratings = fx.ratings_v(spark, sf_dir)
    # a third of the rows go to user 0 (derived from the fixture, for this probe only)
    skewed = ratings.withColumn("userid", F.when(F.col("movieid") % 3 == 0, F.lit(0)).otherwise(F.col("userid")))
    skewed = skewed.checkpoint(eager=True)
    skewed_rows = skewed.count()
    scores = mdl.popularity_scores(fx.movieinfo_v(spark, sf_dir), skewed)
    seen = skewed.select("userid", "movieid")
    order = [F.col("ts").desc(), F.col("movieid").asc(), F.col("rating").desc()]
    variants = {
        "row_number_within (history order)": lambda: row_number_within(skewed, ["userid"], order, "pos"),
        "naive Window.partitionBy(user) row_number": lambda: skewed.withColumn(
            "pos", F.row_number().over(Window.partitionBy("userid").orderBy(*order))),
        "running_max_within (progress bar)": lambda: running_max_within(
            skewed, ["userid"], [F.col("ts").asc(), F.col("movieid").asc()], "rating", "m"),
        "naive Window running max": lambda: skewed.withColumn("m", F.max("rating").over(
            Window.partitionBy("userid").orderBy("ts", "movieid").rowsBetween(Window.unboundedPreceding, 0))),
        "top_unseen_per_user (flagship plan)": lambda: rec.top_unseen_per_user(None, seen, scores, 10),
    }
    rows = []
    for i, (name, build) in enumerate(variants.items()):
        group = f"probe-{i}"
        spark.sparkContext.setJobGroup(group, name)
        t0 = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        rows.append((name, group, round(time.perf_counter() - t0, 2)))
    spark.stop()
    log_file = max(glob.glob(os.path.join(log_dir, "*")), key=os.path.getmtime)
    print(f"skewed input: {sf_dir}, user 0 holds one third of the rows; event log {log_file}\n")
    hot = skewed_rows // 3
    print(f"hot user rows: ~{hot}\n")
    print("| variant | seconds | most records read by one task | that stage's records / tasks |")
    print("| --- | --- | --- | --- |")
    for name, group, secs in rows:
        top, total, tasks = stage_balance(log_file, group)
        print(f"| {name} | {secs} | {top} | {total} / {tasks} |")


if __name__ == "__main__":
    main()
