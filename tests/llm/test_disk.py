"""What stored tables and the rounds of components leave on disk and cost in tasks."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from weftline.llm import common, components


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p for d in dirs for p in Path(d.getPath()).rglob("shuffle_*")}


def test_stored_tables_leave_no_shuffle_files(spark):
    """The pipeline took more than 0.7032 GB of disk on check_h, as shuffle files stayed until the driver collected its garbage."""
    held = spark.conf.get(common.CLEANUP, None)
    before = shuffle_files(spark)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    stored = common.checkpointed(df)
    assert sorted(map(tuple, stored.collect())) == [(k, 143 if k < 6 else 142) for k in range(7)]
    for _ in range(100):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(common.CLEANUP, None) == held
    assert df.count() == 7 and stored.count() == 7


def test_rounds_over_few_edges_have_few_tasks(spark):
    """Rounds over a few thousand edges ran in as many tasks as the session has partitions, about twelve times a round."""
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    edges = common.checkpointed(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long"))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("stars", "rounds")
        roots = components.stars(edges)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("stars") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(x.numCompletedTasks for s in stages if (x := tracker.getStageInfo(s)))
    assert {r.node: r.root for r in roots.collect()} == {i: 0 for i in range(1, 61)}
    assert tasks < 250, tasks
