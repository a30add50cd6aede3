"""Intermediate tables in the folder that all executors share: they cut lineage, so a lost executor costs no more than what it was at."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset a local master gets one of its own, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        found = jsc.getCheckpointDir().get() if jsc.getCheckpointDir().isDefined() else None
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: intermediate tables are written there")
        found = f"{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def registered(spark: SparkSession, source: type) -> None:
    """Makes a Python data source known to the session, and the session known to this thread, where Spark looks sources up."""
    spark.dataSource.register(source)
    SparkSession._get_j_spark_session_class(spark._jvm).setActiveSession(spark._jsparkSession)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Folders of intermediate tables by application; each goes when the application's Python ends, as results are lazy and read them until then.
FOLDERS: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in FOLDERS:
        FOLDERS[app] = path = f"{shared_dir(spark)}/polyscope-{app}-{uuid.uuid4().hex[:8]}"

        def end() -> None:
            with contextlib.suppress(Exception):  # the application may be gone, and its folder is only in the way
                if spark.sparkContext._jsc is not None:
                    removed(spark, path)

        atexit.register(end)
    return FOLDERS[app]


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here, and a lost executor costs nothing."""
    return written_at(df, what)[0]


def written_at(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """The table of :func:`written`, and where it is."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bucketed(df: DataFrame, what: str, by: str, buckets: int, dealt: bool = True) -> DataFrame:
    """``df`` as a table in the shared folder whose files are buckets of ``by``: tables bucketed alike are joined and grouped by it without a shuffle.

    ``dealt``: rows are shuffled first, so that a bucket is one file, in order of ``by``. Otherwise each task writes a file for each bucket that it has rows of, which suits few and large rows.
    """
    spark = df.sparkSession
    name = f"{re.sub('[^a-z]', '_', what)}_{uuid.uuid4().hex}"
    writer = (df.repartition(buckets, by) if dealt else df).write.bucketBy(buckets, by)
    (writer.sortBy(by) if dealt else writer).format("parquet").option("path", f"{folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
