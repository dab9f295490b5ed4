"""Session settings and shared scratch folders."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # documents can be long: small batches bound memory and overlap with Python
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    # lets decode() accept windows-1252
    "spark.sql.legacy.javaCharsets": "true",
}


def get_session(app_name: str = "lexiframe", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the runtime settings the operators rely on in a session somebody else made."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    ``spark.checkpoint.dir`` names it. A local master without that setting
    gets a temporary folder; a cluster without it is an error, because a
    machine-local folder would be lost with its machine.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="lexiframe-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, eager: bool = True) -> DataFrame:
    """Checkpoint to the shared folder: later reads see one fixed result and a short lineage."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, for functions that run there."""
    context = spark.sparkContext
    if getattr(context, "_lexiframe_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lexiframe-")) / "lexiframe-package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, Path("lexiframe") / source.relative_to(root))
    context.addPyFile(str(archive))
    context._lexiframe_shipped = True
