"""Reading tables and cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python workers, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="heddle-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/heddle.zip", "w") as z:
        for at, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    z.write(f"{at}/{f}", os.path.relpath(f"{at}/{f}", os.path.dirname(root)))
    sc.addPyFile(f"{folder}/heddle.zip")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``, pruned to ``columns`` when any are given."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one of this process if that is unset and Spark is local.

    Raises RuntimeError on a cluster without that setting, as a machine-local folder would lose data there.
    """
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="heddle-")
        atexit.register(shutil.rmtree, _own[sc.applicationId], ignore_errors=True)
    return _own[sc.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/heddle/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, *, partitions: int | None = None) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back: a lost executor costs no recomputation."""
    spark = df.sparkSession
    ship(spark)
    path = fresh_path(spark, name)
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Deletes the files of a table made by ``stage`` that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/heddle/" in path:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def put_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes ``data`` once to the shared folder and gives it to every executor; workers open it with ``local_file``.

    Executors fetch the file when a task first needs it, so it is no part of any task's closure.
    """
    path = f"{fresh_path(spark, name)}.bin"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    try:
        for i in range(0, len(data), 1 << 24):
            out.write(bytearray(data[i : i + (1 << 24)]))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def local_file(name: str) -> str:
    """Where a worker finds what ``put_file`` wrote."""
    from pyspark import SparkFiles

    return SparkFiles.get(name)


def cut(df: DataFrame) -> DataFrame:
    """``checkpoint()`` in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
