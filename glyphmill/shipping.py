"""Send this package to the executors, so that Python workers can import it wherever they run."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Rows of an Arrow batch at most: texts are long, and a batch is held outside the heap.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once for each Spark context; keep Arrow batches small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    context = spark.sparkContext
    if getattr(context, "_glyphmill_shipped", False):
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()
    target = Path(folder, "glyphmill_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*")):
            if f.is_file() and "__pycache__" not in f.parts:
                z.write(f, f"{here.name}/{f.relative_to(here)}")
    context.addPyFile(str(target))
    context._glyphmill_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a session of one machine may leave it unset and gets a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return (found or f"file://{tempfile.gettempdir()}/checkpoints").rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, where its lineage ends; its files go when the application ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path
