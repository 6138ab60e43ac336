"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS (timed runs per query after
one warm-up run; the median counts). ``python bench.py compare`` instead times
alternative plans of the same results against the ones the library uses.
"""

from __future__ import annotations

import json
import os
import random
import statistics
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession, Window as W, functions as F

from cohortloom.config import StudyConfig
from cohortloom.operators import concepts, cycles, propensity
from cohortloom.plans import registry, study
from cohortloom.session import materialize

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = (
    "cohort_generate",
    "pull_all_counts",
    "baseline",
    "four_cycles",
    "range_join_outcomes",
    "cycle_outcomes",
    "itt_analysis",
    "iptw_km",
    "curve_diff",
    "balance_table",
    "iptw_km_glm",
)


TRAFFIC = "traffic of "


def session(folder: str) -> SparkSession:
    Path(folder, "log").mkdir()
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("cohortloom-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.rolling.enabled", "false")
        .config("spark.eventLog.compress", "false")
        .config("spark.eventLog.dir", Path(folder, "log").as_uri())
        .config("spark.checkpoint.dir", folder)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(build) -> float:
    """Median time from building the query to the end of a no-op write."""
    times = []
    for _ in range(RUNS + 1):
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times[1:]), 3)


def traffic(folder: str) -> dict[str, dict[str, int]]:
    """Rows read from files and bytes shuffled by each described run, from Spark's event log."""
    described: dict[int, str] = {}
    moved: dict[str, dict[str, int]] = {}
    for path in Path(folder).iterdir():
        for line in path.read_text().splitlines():
            event = json.loads(line)
            if event["Event"] == "SparkListenerJobStart":
                name = (event.get("Properties") or {}).get("spark.job.description", "")
                described.update({stage: name for stage in event["Stage IDs"]})
            elif event["Event"] == "SparkListenerTaskEnd" and described.get(event["Stage ID"], "").startswith(TRAFFIC):
                sums = moved.setdefault(described[event["Stage ID"]].removeprefix(TRAFFIC), {"rows_read": 0, "shuffle_bytes": 0})
                metrics = event.get("Task Metrics") or {}
                sums["rows_read"] += metrics.get("Input Metrics", {}).get("Records Read", 0)
                sums["shuffle_bytes"] += metrics.get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
    return moved


def headline(spark: SparkSession) -> dict[str, float]:
    """Seconds by query, in mixed order, so that none always runs last; one more run of each is described for ``traffic``."""
    queries, times = registry.queries(), {}
    order = list(HEADLINE)
    random.Random(2).shuffle(order)
    for name in order:
        times[name] = seconds(lambda: queries[name](spark, SF_DIR))
        spark.sparkContext.setJobDescription(TRAFFIC + name)
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        spark.sparkContext.setJobDescription(None)
    return {name: times[name] for name in HEADLINE}


def comparisons(spark: SparkSession) -> dict[str, float]:
    config = StudyConfig()
    result = {}

    def inputs():
        return registry.Inputs(spark, SF_DIR)

    def pulls_apart():
        study_in = inputs()
        parts = [concepts.count_pulls(study_in.pulled(pull.concept_set)) for pull in config.pulls()]
        for part in parts[1:]:
            part.write.format("noop").mode("overwrite").save()
        return parts[0]

    result["twelve_pulls_one_job"] = seconds(lambda: registry.queries()["pull_all_counts"](spark, SF_DIR))
    result["twelve_pulls_twelve_jobs"] = seconds(pulls_apart)

    treatments = materialize(inputs().pulled(*config.treatment_sets), "treatments")

    def by_fold():
        rows = treatments.join(cycles.anchors_by_person(treatments, config), "person_id")
        return cycles.four_cycles(cycles.annotate_cycles(rows, config), config)

    def by_windows():
        left, found = treatments, None
        for number in range(1, config.max_cycles + 1):
            anchored = left.withColumn("day_1", F.min("date").over(W.partitionBy("person_id")))
            inside = F.col("date") <= F.date_add("day_1", config.cycle_days)
            part = anchored.where(inside).withColumn("cycle", F.lit(number))
            found = part if found is None else found.unionByName(part)
            left = anchored.where(~inside).drop("day_1")
        return found

    result["cycles_fold"] = seconds(by_fold)
    result["cycles_window_passes"] = seconds(by_windows)

    timelines = materialize(inputs().timelines(), "timelines")
    analysis = materialize(study.itt_rows(timelines, config), "itt")
    cells = materialize(study.analysis_cells(analysis, config), "cells")

    def fit_cells():
        return propensity.fit_propensity(cells, config.covariates, freq="n").table(spark)

    def fit_rows():
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import GeneralizedLinearRegression

        labelled = analysis.withColumn("label", (F.col("IUI") == "IUI").cast("double"))
        features = VectorAssembler(inputCols=list(config.covariates), outputCol="features").transform(labelled)
        model = GeneralizedLinearRegression(family="binomial", link="logit", tol=1e-12, maxIter=100).fit(features)
        return spark.createDataFrame([(float(model.intercept),)], "intercept double")

    result["fit_on_strata"] = seconds(fit_cells)
    result["fit_on_rows"] = seconds(fit_rows)
    return result


def main() -> None:
    compare = sys.argv[1:] == ["compare"]
    with tempfile.TemporaryDirectory(prefix="cohortloom-bench-") as folder:
        spark = session(folder)
        timed = comparisons(spark) if compare else headline(spark)
        spark.stop()
        moved = None if compare else traffic(str(Path(folder, "log")))
    line = {
        "metric": "compare" if compare else "headline_total",
        "value": round(sum(timed.values()), 3),
        "unit": "sec",
        "queries": timed,
        "sf": Path(SF_DIR).name.removeprefix("sf"),
    }
    print(json.dumps(line | ({"traffic": moved} if moved else {})))


if __name__ == "__main__":
    main()
