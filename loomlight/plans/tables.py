"""Steps that several later ones read, written once to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset and all runs on this machine."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not got:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        got = have.get() if have.isDefined() else None
    if not got:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = tempfile.mkdtemp(prefix="loomlight-")
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors.

    The table goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomlight-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def staged(spark: SparkSession, steps: list[tuple[str, str]], cuts: tuple[str, ...], query) -> DataFrame:
    """The last of the named steps; those in `cuts` are written and read by the ones after them."""
    steps = [list(s) for s in steps]
    at = {name: k for k, (name, _) in enumerate(steps)}
    for name in (c for c in cuts if c in at):
        k = at[name]
        table = written(spark.sql(query(*map(tuple, steps[: k + 1]), ("", f"select * from {name}"))), name)
        view = f"loomlight_{name}_{uuid.uuid4().hex}"
        table.createOrReplaceTempView(view)
        steps[k][1] = f"select * from {view}"
    return spark.sql(query(*map(tuple, steps)))
