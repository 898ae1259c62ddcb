"""Session settings and the shared folder for checkpoints and staged tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def build_session(app_name: str = "fluxgauge", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the engine relies on; extra settings by keyword dict."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Row windows cost far more per byte than scans do, so small partitions pay.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf.pop("settings", {}),
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the one session setting results depend on: zone-less hours need UTC.

    A local session left at the default of 200 partitions also gets one per core, as every
    stream would otherwise open 200 state stores. Clusters keep their setting.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    context = spark.sparkContext
    if context.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        spark.conf.set("spark.sql.shuffle.partitions", str(context.defaultParallelism))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; on a local master, a fresh one if unset."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = _local_dirs.get(context.applicationId)
        if path is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            path = _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="run-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def stored(df: DataFrame) -> DataFrame:
    """``df`` itself if it only reads, filters and projects stored files, else a stored copy."""
    plan = df._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    steps = re.findall(r"^[\s:+-]*(\w+)", text, flags=re.MULTILINE)
    scan = steps[-1] == "Relation" and set(steps) <= {"Project", "Filter", "Relation"}
    return df if scan and plan.deterministic() and "subquery" not in text else materialize(df)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, for plans that use it repeatedly.

    Cuts the lineage like a checkpoint, but keeps column pruning and filter pushdown, and its
    true size is known to the optimiser, which broadcasts it only below its own threshold.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
