"""What an operator needs from the session: workers that can import this package, and a shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, and keep their Arrow batches small.

    Workers may start in any folder, so what a UDF imports has to travel with the job. A batch is
    held several times over (off the heap, in Arrow, as Python strings), so 8 MB do, unless the session says otherwise.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ketframe-"), "ketframe_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one in the warehouse, or on a local master a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.partition("[")[0] == "local":
        folder = os.environ.get("KETFRAME_SHARED") or os.environ.setdefault("KETFRAME_SHARED", tempfile.mkdtemp(prefix="ketframe-shared-"))
    return (folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/ketframe").rstrip("/")


def saved(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back.

    A lost executor costs a re-read, never a recomputation of what stands before; the size of
    the written table is known to the planner, which a broadcast decision needs.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver drop what no plan refers to any more: Spark deletes the shuffle files of frames that are garbage."""
    spark.sparkContext._jvm.System.gc()


def forget(*frames: DataFrame) -> None:
    """Delete tables that ``saved`` wrote and nothing will read again."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
