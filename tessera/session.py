"""Session settings and the loader of the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def session(app: str = "tessera", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the library expects: UTC, adaptive execution, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k: str(v) for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Where a local session stages tables if spark.checkpoint.dir is unset: driver and executors are one process there.
LOCAL_DIR = "/tmp/checkpoints/tessera"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, one for a local session; elsewhere that is an error."""
    at, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not at and master.startswith("local") and not master.startswith("local-cluster"):
        at = f"file://{LOCAL_DIR}"
    if not at:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return at.rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, lazily; column pruning and filters reach its parquet scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
