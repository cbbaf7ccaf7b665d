"""Session with the settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "recallframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` wins over these settings (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


#: Serves on a single machine alone, where spark.checkpoint.dir is unset.
LOCAL_DIR = "/tmp/checkpoints/recallframe"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share. Where the session names none, a local folder serves on a single
    machine; on a cluster that would lose rows, so it raises there."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return LOCAL_DIR
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
