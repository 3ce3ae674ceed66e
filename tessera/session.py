"""Session helpers: building a session for tests/bench, the shared work folder,
size checks for broadcasts and lineage cuts.

On a cluster the session comes from the caller and ``spark.checkpoint.dir``
names the shared folder; we only set one ourselves when it is unset (local
tests)."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper bound on rows we are willing to broadcast for a query-side table.
DEFAULT_BROADCAST_ROWS = 200_000


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "tessera") -> SparkSession:
    builder = (
        SparkSession.builder.master(master or "local[8]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.ansi.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    return spark


# Runtime SQL settings the plans here rely on. Constraint propagation is off:
# the rendering and tokenizing expressions are large, and inferring constraints
# over them costs more optimizer time (seconds per action) than the inferred
# IS NOT NULL filters save; the filters that matter are written explicitly.
RUNTIME_CONF = {
    "spark.sql.constraintPropagation.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings and make sure a checkpoint folder is named."""
    for k, v in RUNTIME_CONF.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        # a single-process session (tests): its own folder will do
        conf_dir = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, "tables", f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing a Parquet table to the shared folder and reading it back.

    Parquet keeps the columnar layout and gives the optimizer statistics, and a
    lost executor only recomputes from this table, not from the raw input."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fits(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> bool:
    """Bounded size check: reads at most ``max_rows + 1`` rows, each time it is asked
    (an answer kept by plan would outlive the files it was about)."""
    return df.limit(max_rows + 1).count() <= max_rows


def dealt_parts(spark: SparkSession) -> int:
    """Partitions that documents are dealt into by id."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


_SHUFFLE_RE = re.compile(r"Exchange (hashpartitioning|RoundRobinPartitioning|SinglePartition|"
                         r"rangepartitioning|UnknownPartitioning)")


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy row work at least one partition per core.

    Small inputs (one file, one row group) scan as a single task; a round-robin
    repartition then costs little. Large inputs already have more partitions
    than cores, and frames coming out of a shuffle have the shuffle's partition
    count: both are returned unchanged (no extra shuffle)."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    if _SHUFFLE_RE.search(plan):
        return df
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df
