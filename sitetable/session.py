"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

# html rows are wide: small Arrow batches keep the parse stage's memory flat
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "200",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the library's runtime settings to a session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; on a local master without one, a folder of the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_sitetable"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; nothing is written yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever file system it lies."""
    system, target = _hadoop(spark, path)
    system.delete(target, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    system, target = _hadoop(spark, path)
    return [status.getPath().getName() for status in system.listStatus(target)] if system.exists(target) else []


def read_text(spark: SparkSession, path: str) -> str:
    system, target = _hadoop(spark, path)
    stream = system.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write_bytes(system, target, text: str) -> None:
    stream = system.create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def overwrite(spark: SparkSession, path: str, text: str) -> None:
    """Make or replace a small file whole: readers see the old text or the new one."""
    system, target = _hadoop(spark, path)
    staged = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}.tmp")
    _write_bytes(system, staged, text)
    system.delete(target, False)
    system.rename(staged, target)


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file, whole, unless it is there; of several who try at once one succeeds."""
    system, target = _hadoop(spark, path)
    staged = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}.tmp")
    _write_bytes(system, staged, text)
    try:
        if system.getUri().getScheme() == "file":  # a local rename would replace the file, a link does not
            os.link(staged.toUri().getPath(), target.toUri().getPath())
        else:
            hadoop = spark._jvm.org.apache.hadoop
            context = hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
            context.rename(staged, target, spark._sc._gateway.new_array(hadoop.fs.Options.Rename, 0))
        return True
    except (FileExistsError, Py4JJavaError) as error:
        if isinstance(error, Py4JJavaError) and "FileAlreadyExists" not in str(error.java_exception):
            raise
        return False
    finally:
        system.delete(staged, False)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, in order."""
    system, target = _hadoop(spark, pattern)
    return sorted(status.getPath().toString() for status in system.globStatus(target) or ())


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: rows are written once to the shared folder and read from there."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def read_or_none(reader) -> DataFrame | None:
    """Result of ``reader()``, or None when its path or table does not exist yet."""
    try:
        return reader()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
