"""Session settings for analytics over wide purchase histories."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "larkspur", master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC; the cluster's own settings win where none is given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    fixed = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**fixed, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; only a local session may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    import tempfile

    return "file://" + tempfile.mkdtemp(prefix="larkspur-")
