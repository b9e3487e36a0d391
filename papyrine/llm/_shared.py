"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch sent to a Python worker.
ARROW_ROWS, ARROW_BYTES = 1000, "4m"
#: Application and path of every shared folder made and not yet deleted.
_MADE: list[tuple[str, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set in ``sf_dir``, read by Spark (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds each Arrow batch, so that memory follows a batch, not a partition; and has shuffle files
    go with the query that wrote them, so that stages of one operator do not add up on disk. Results are
    computed after an operator has returned, so these settings of the session stay."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder that the driver and all executors see.

    It lies in the folder of ``spark.checkpoint.dir``. Only where that is unset and everything runs in one
    process (a local master, as in tests) a temporary folder is taken instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/papyrine-shared"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _MADE.append((spark.sparkContext.applicationId, path))
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: a cut in the lineage that
    outlives lost executors. Such tables stay until clean(), because results may read them later."""
    return Scratch(df.sparkSession).stored(df, what)


class Scratch:
    """Tables that are needed only until an operator returns."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, what: str) -> DataFrame:
        path = shared_dir(self.spark, what)
        df.write.mode("overwrite").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep: int = 0) -> None:
        """Deletes all tables, or all but the last ``keep``."""
        gone, self.paths = (self.paths[:-keep], self.paths[-keep:]) if keep else (self.paths, [])
        for path in gone:
            drop_dir(self.spark, path)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark knows."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)
    _MADE[:] = [x for x in _MADE if x[1] != path]


def clean(spark: SparkSession) -> None:
    """Deletes every table that operators of this application have stored; results that read one can
    then no longer be computed."""
    for application, path in list(_MADE):
        if application == spark.sparkContext.applicationId:
            drop_dir(spark, path)


def trimmed(function: Callable) -> Callable:
    """A function of batches that gives memory it no longer needs back to the system when its partition is
    done, so that workers that wait for their next task do not hold on to it."""

    @functools.wraps(function)
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        yield from function(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not the GNU library
            pass

    return run


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_only(docs: DataFrame, *more: str) -> DataFrame:
    """The columns that an operator needs, text null as empty."""
    return docs.select(*more, F.coalesce(F.col("text"), F.lit("")).alias("text"))
