"""Tables that are written once and read by several plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session, whose tasks run on this machine, may go without it; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="glyphlake-"))
    return _OWN[0]


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table under ``spark.checkpoint.dir``: lineage ends here, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/glyphlake/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame, times: int = 1) -> DataFrame:
    """A scan of fewer partitions than cores (a small table in one file) dealt out over the cores, for what follows is costly.

    Only for plans without a shuffle; such a scan is at most a few file splits, and a larger one passes as it is. For narrow
    rows ``times`` asks for more partitions a core: splits of one file can be empty, since a row group is read whole.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= times * cores else scan.repartition(cores)
