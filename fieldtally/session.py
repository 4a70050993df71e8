"""Session settings that suit the jobs in this package.

Library functions never change the caller's session; this helper is for
scripts, tests and the benchmark.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    app_name: str = "fieldtally",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    driver_memory: str | None = None,
    checkpoint_dir: str | None = None,
) -> SparkSession:
    """Create a session in UTC with adaptive execution on.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the
    submit command names the first, and adaptive execution merges the
    second from the cluster's own setting. ``checkpoint_dir`` must be a folder
    all machines share; leave it unset where the cluster names one.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory is not None:
        builder = builder.config("spark.driver.memory", driver_memory)
    if checkpoint_dir is not None:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return builder.getOrCreate()


