"""Session defaults and the shared folder that jobs may write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Session settings the jobs are written for.  All of them are plain Spark settings.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    # The JVM never compiles a method beyond 8000 bytes of code; past that, split methods are faster
    # than one fused method that stays interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "zonedeck", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder the cluster shares (``spark.checkpoint.dir``).

    On a cluster the setting must be there, because a driver-local folder is not
    visible to executors.  In local mode an unset value falls back to a new
    temporary folder.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="zonedeck-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/zonedeck/{purpose}-{uuid.uuid4().hex}"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back: what was costly is done once, and lineage ends there."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_bound(spark: SparkSession) -> int:
    """The session's own broadcast limit; -1 (broadcast switched off) gives 0."""
    raw = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").lower()
    for unit, factor in (("kb", 1 << 10), ("mb", 1 << 20), ("gb", 1 << 30), ("k", 1 << 10),
                         ("m", 1 << 20), ("g", 1 << 30), ("b", 1)):
        if raw.endswith(unit):
            return max(0, int(raw[: -len(unit)]) * factor)
    return max(0, int(raw))


def scans_only(df: DataFrame) -> bool:
    """Whether the plan only filters and projects tables, and every column of open-ended size is stored as it is.

    Only then does the estimate, which starts from file sizes, say something about the rows.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    nodes = {line.lstrip(" :+-").split(" ", 1)[0].split("[", 1)[0] for line in plan.toString().splitlines()}
    if not nodes <= {"Project", "Filter", "Relation"}:
        return False
    leaves = plan.collectLeaves()
    stored = {a.exprId().id() for i in range(leaves.size())
              for a in (leaves.apply(i).output().apply(j) for j in range(leaves.apply(i).output().size()))}
    outputs = [plan.output().apply(i) for i in range(plan.output().size())]
    fixed = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "decimal")
    return all(a.dataType().simpleString().startswith(fixed) or a.exprId().id() in stored for a in outputs)


def fits_broadcast(df: DataFrame) -> bool:
    """Whether a table is small enough to broadcast.

    Catalyst's estimate decides first.  It guesses text lengths and does not know how far an exploded list
    grows, so a table with computed texts, joins or generated rows is measured as well; its input has then
    already passed the estimate.
    """
    bound = broadcast_bound(df.sparkSession)
    if plan_bytes(df) > bound:
        return False
    if scans_only(df):
        return True
    size = df.select(F.octet_length(F.to_json(F.struct("*"))).alias("b")).agg(F.sum("b")).first()[0]
    return (size or 0) <= bound


#: Below this size a table is not worth spreading.
SPREAD_BYTES = 64 << 10


def spread(df: DataFrame) -> DataFrame:
    """Give a scan at least one partition per core before costly per-row work.

    Only a table stored in fewer splits than the session has cores is touched, such as one small
    file with a single row group; a scan of many splits stays as it is, with no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if plan_bytes(df) < SPREAD_BYTES or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
