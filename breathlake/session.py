"""Session settings, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch sent to a Python worker. Rows that hold whole
#: recordings or documents are wide, so batches are bounded by size, not count.
ARROW_BATCH_BYTES = 16 << 20


def build(app: str = "breathlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, ANSI)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # a stage's files go with its last reader
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return tune(b.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes (a smaller setting of the user stays) and ship the package."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > ARROW_BATCH_BYTES:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, wherever it was imported from."""
    sc = spark.sparkContext
    if getattr(sc, "_breathlake_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="breathlake-"), "breathlake.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    at = os.path.join(folder, f)
                    z.write(at, os.path.relpath(at, os.path.dirname(root)))
    sc.addPyFile(path)  # the driver serves it; executors need no shared folder for it
    sc._breathlake_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` wins. Only where it is unset and the master is
    local is a folder of our own made; on a cluster its absence is an error.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = sc.getConf().get("spark.checkpoint.dir", "")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="breathlake-ckpt-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
