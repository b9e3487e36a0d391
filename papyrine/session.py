"""Session helpers."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows and bytes of one Arrow batch sent to a Python worker.
ARROW_ROWS, ARROW_BYTES = 1000, "4m"
_SHIPPED: set[str] = set()


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder that the driver and all executors see, below spark.checkpoint.dir; a temporary one only
    where that is unset and everything runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/papyrine-kept"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Bounds each Arrow batch, so that a worker's memory follows a batch, not a partition. Results are
    computed after an operator has returned, so these settings of the session stay."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    folder = tempfile.mkdtemp()
    path = os.path.join(folder, f"{top.name}.zip")
    Path(path).write_bytes(data.getvalue())
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
