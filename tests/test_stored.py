"""What a stored step leaves on disk beside its table."""

import time

from pyspark.sql import functions as F

from aislefix.sources.tables import materialize

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {path for path in files.mkString(";").split(";") if "shuffle_" in path}


def test_stored_steps_leave_no_shuffle_files(spark):
    rows = spark.range(5000).groupBy(F.pmod("id", F.lit(11)).alias("k")).count()
    before, setting = _shuffle_files(spark), spark.conf.get(CLEANUP)
    rows.collect()
    assert _shuffle_files(spark) - before
    before |= _shuffle_files(spark)
    stored = materialize(rows, "counted")
    until = time.time() + 10
    while _shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before and spark.conf.get(CLEANUP) == setting
    assert stored.count() == 11
