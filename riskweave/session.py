"""Session helpers shared by every query: code shipping and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, so that Python workers can import it.

    Texts are long rows: unless the session says otherwise, Arrow batches have 1,000 of them, not 10,000, so
    that a batch takes a few megabytes on either side.
    """
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, "1000")
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="riskweave-")) / "riskweave.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.suffix in {".py", ".json"} and "__pycache__" not in p.parts:
                z.write(p, Path(root.name) / p.relative_to(root))
    spark.sparkContext.addPyFile(str(out))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines see: ``spark.checkpoint.dir``, or in local runs without it a temporary one."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        got = spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="riskweave-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(got)
    return got


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip(os.sep)}/riskweave/{name}-{uuid.uuid4().hex}"
