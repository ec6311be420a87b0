"""Session helpers: recommended settings and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings a job of this library expects; all are runtime SQL confs, so they
# can be applied to a session someone else created.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "neurotab") -> SparkSession:
    """Local session for tests and the benchmark (a cluster brings its own)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, local_fallback=True)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, local_fallback: bool = False) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared file system folder and is used
    as is.  Only when it is unset, the caller asks for it (tests, local
    benchmark, the local driver harness) *and* the master is local is a fresh
    folder under /tmp taken.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not local_fallback or not sc.master.startswith("local"):
        # on a cluster a machine-local folder would not survive executor loss
        raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder for checkpoints")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="neurotab-ckpt-", dir="/tmp"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables, inside the shared checkpoint folder."""
    import uuid

    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/neurotab-scratch/{name}-{uuid.uuid4().hex}"
