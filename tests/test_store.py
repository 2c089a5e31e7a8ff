"""Tables in the shared folder, and what they leave on disk."""

import glob
import time

from pyspark.sql import functions as F

from tidemark import store


def shuffle_files(spark):
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in top for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}


def test_kept_tables_leave_no_shuffle_behind(spark):
    before = shuffle_files(spark)
    made = spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).count().repartition(3, "count")
    out = store.keep(made)
    for _ in range(50):  # files are deleted soon after
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert out.count() == 5000 and made.count() == 5000
    assert spark.conf.get(store.SHUFFLES_GO) == spark.sparkContext.getConf().get(store.SHUFFLES_GO, "false")
