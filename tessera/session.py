"""What a session needs once."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_LOCK = threading.Lock()


def ship(spark: SparkSession | None = None) -> None:
    """Send this package to the executors once a session, so that their Python workers
    can import it whatever their working folder is."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    sc = spark.sparkContext
    with _LOCK:
        if sc.applicationId in _SHIPPED:
            return
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(), "tessera_package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(os.path.join(root, "tessera")):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, root))
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as a full URI:
    ``spark.checkpoint.dir``. Only where the cluster names none (tests on one machine) is
    a local one set. Checkpoints work from then on."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "tessera-shared")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(hadoop).toString().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder. Who reads it next takes only
    the columns that it needs, and joins know its size: rows that come out of Python are
    otherwise taken for as small as what went in, and broadcast."""
    path = f"{shared_folder(df.sparkSession)}/tessera-rows/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """The rows dealt out for much work on each: a task has about ``rows`` at most, and all
    cores have some. A small file would be one task, however long its rows take."""
    n = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, n // rows + 1, min(3 * cores, n // 64)))
