import numpy as np
from pyspark.sql import functions as F

from assayer.llm.bitmap import bitmap_of, may_hold


def test_a_bitmap_takes_few_jobs_however_many_partitions(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    held = spark.conf.get(key)
    spark.conf.set(key, "false")
    spark.sparkContext.setJobGroup("bitmap", "bitmap")
    try:
        hashes = spark.range(5000).select(F.xxhash64("id").alias("h"))
        known = np.array([r.h for r in hashes.collect()], np.int64)
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("bitmap"))
        bitmap = bitmap_of(hashes, "h", 5000)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("bitmap")) - before
    finally:
        spark.conf.set(key, held)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert may_hold(bitmap, known).all()
    assert jobs <= 3
