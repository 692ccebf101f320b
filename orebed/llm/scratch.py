"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where it is unset (local tests)."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="orebed-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class Scratch:
    """Writes tables below the shared folder, so lost executors cost no lineage."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.base = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(conf).delete(path, True)

    def free_shuffles(self) -> None:
        """Lets Spark delete the shuffle files of finished phases."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def most_frequent(counts: DataFrame, column: str, limit: int) -> DataFrame:
    """The rows with the greatest counts, at most ``limit`` of them.

    A histogram of 512 steps at most gives the least count for which the rows fit, so no
    task sends more than its share; rows of the last step that does not fit stay out. If that
    is the first step, a share of its rows is taken, by hash.
    """
    step = F.floor(F.log2(F.col(column).cast("double")) * 8).cast("int")
    seen = {r["step"]: r["n"] for r in counts.select(step.alias("step")).groupBy("step").agg(F.count("*").alias("n")).collect()}
    least, total = None, 0
    for s in sorted(seen, reverse=True):
        total += seen[s]
        if total > limit:
            break
        least = s
    if least is not None or not seen:
        return counts.where(step >= (least or 0))
    top = max(seen)
    share = int(0.95 * limit / seen[top] * (1 << 30))
    return counts.where((step == top) & (F.pmod(F.xxhash64(*counts.columns), F.lit(1 << 30)) < share))
