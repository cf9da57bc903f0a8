"""Measure the largest task of a per-run counter when one run holds a third of all rows.

Runs the same counter twice, as a plain ``row_number() OVER (PARTITION BY run)`` and
with ``operators.sequence.running_index`` (bucketed), and reads the largest
task's shuffle-read record count from Spark's event log (written to a new scratch
folder; the UI stays off).

    python -m tools.skew_probe [rows]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile


def max_task_records(log_dir: str, job_group: str) -> tuple[int, int]:
    """(largest shuffle-read records of one task, number of tasks) for stages run under ``job_group``."""
    events = []
    for path in sorted(glob.glob(f"{log_dir}/**/*", recursive=True)):
        if os.path.isfile(path) and not path.endswith(".crc"):
            with open(path, encoding="utf-8") as fh:
                events.extend(json.loads(line) for line in fh if line.startswith("{"))
    stage_group: dict[int, str] = {}
    for e in events:
        if e["Event"] == "SparkListenerJobStart":
            g = (e.get("Properties") or {}).get("spark.jobGroup.id")
            for sid in e.get("Stage IDs", []):
                stage_group[sid] = g
    best, n = 0, 0
    for e in events:
        if e["Event"] == "SparkListenerTaskEnd" and stage_group.get(e["Stage ID"]) == job_group:
            m = e.get("Task Metrics") or {}
            best = max(best, (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0))
            n += 1
    return best, n


def main() -> None:
    sys.path.insert(0, ".")
    rows = int(sys.argv[1]) if len(sys.argv) > 1 else 3_000_000
    log_dir = tempfile.mkdtemp(prefix="tracefold-eventlog-")
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tracefold.operators.sequence import running_index
    from tracefold.session import build_session
    spark = build_session(shuffle_partitions=64, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir, "spark.eventLog.compress": "false",
        "spark.eventLog.rolling.enabled": "false",
        "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    # one run holds a third of all rows; the rest is spread over 10,000 runs
    df = spark.range(rows).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("r"), (F.col("id") % 10_000).cast("string")))
        .alias("run_id"), (F.col("id") * 7919 % (rows * 10)).alias("seq"))
    sc = spark.sparkContext
    sc.setJobGroup("plain", "plain window")
    plain = df.withColumn("i", F.row_number().over(Window.partitionBy("run_id").orderBy("seq")) - 1)
    plain.write.format("noop").mode("overwrite").save()
    sc.setJobGroup("bucketed", "bucketed running index")
    width = max(rows // 1000, 1) * 10
    bucketed = running_index(df, ["run_id"], ["seq"], F.floor(F.col("seq") / width), "i")
    bucketed.write.format("noop").mode("overwrite").save()
    from tracefold.operators.sequence import lag_in_order
    sc.setJobGroup("plain_lag", "plain lag")
    df.withColumn("prev", F.lag("seq").over(Window.partitionBy("run_id").orderBy("seq"))) \
      .write.format("noop").mode("overwrite").save()
    sc.setJobGroup("bucketed_lag", "bucketed lag")
    lag_in_order(df, ["run_id"], "seq", F.floor(F.col("seq") / width), ["seq"]).write.format("noop").mode("overwrite").save()
    # run-state fold (W10): partial aggregates and a join on run_id; broadcast joins off, as on a large cluster
    from tracefold.operators.runs import fold_run_state
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    updates = df.select("run_id", "seq",
                        F.element_at(F.array(F.lit("set_messages"), F.lit("set_pending"), F.lit("clear")),
                                     (F.col("seq") % 3 + 1).cast("int")).alias("kind"),
                        F.col("seq").cast("string").alias("messages"), F.lit(None).cast("string").alias("pending"),
                        F.lit("m").alias("model"), F.timestamp_seconds(F.col("seq")).alias("written_at"))
    sc.setJobGroup("fold", "run-state fold")
    fold_run_state(updates).write.format("noop").mode("overwrite").save()
    spark.stop()
    for g in ("plain", "bucketed", "plain_lag", "bucketed_lag", "fold"):
        rec, n = max_task_records(log_dir, g)
        print(json.dumps({"variant": g, "rows": rows, "largest_task_shuffle_records": rec, "tasks": n}))


if __name__ == "__main__":
    main()
