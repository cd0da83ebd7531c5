"""What steps leave on the executors' disks."""

import os

from pyspark.sql import functions as F

from leadlake import session
from leadlake.llm import common


def test_a_step_leaves_no_shuffle_files(spark, monkeypatch):
    """The plans stay in reach, as a listener's would, and no garbage is collected."""
    monkeypatch.setattr(common, "release", lambda spark: None)
    local = spark.sparkContext.getConf().get("spark.local.dir")
    files = lambda: {os.path.join(at, f) for at, _, names in os.walk(local) for f in names if f.startswith("shuffle_")}
    for step in (common.store, common.checkpoint, session.stored, session.checkpointed):
        before = files()
        df = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count()
        assert step(df).count() == 100
        assert not {f for f in files() - before if f.endswith(".data") and os.path.getsize(f) > 400}, step
