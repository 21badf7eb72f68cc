"""Session helpers shared by operators: table access and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "rillway", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """Local session with the settings the engine is tested with; on a cluster use the session given."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "10g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer splits than there are cores; larger input stays as it is read.

    For scans that heavy per-row work follows. Only what is selected from the scan is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors share: the cluster's spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            folder = known.get()
        elif not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            folder = "file://" + tempfile.mkdtemp(prefix="rillway-")
            sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def read_shared(path: str):
    """A table in the shared folder as a pandas frame, for Python workers."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSystem, LocalFileSystem

    files, at = (LocalFileSystem(), re.sub("^file:/+", "/", path)) if path.startswith("file:") else FileSystem.from_uri(path)
    return pq.read_table(at, filesystem=files).to_pandas()


_kept: dict[tuple, object] = {}


def shared_object(make, *args):
    """make(*args), kept by a Python worker for its next tasks; only the last one is."""
    key = (make.__name__, *args)
    if key not in _kept:
        _kept.clear()
        _kept[key] = make(*args)
    return _kept[key]


class Scratch:
    """Written tables that cut the lineage of iterative operators.

    Each cut is one Parquet table in the shared folder, so a lost executor costs only the step under way.
    drop() removes a table that no later step reads; the others, which results still read, go when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/rillway-{uuid.uuid4().hex}"
        path, files = self._files(self.base)
        files.mkdirs(path)
        files.deleteOnExit(path)
        self.made: dict[int, str] = {}
        self.n = 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/t{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made[id(out)] = path
        return out

    def path(self, df: DataFrame) -> str:
        """Where the executors find a table, as read_shared() takes it."""
        p, files = self._files(self.made[id(df)])
        return files.makeQualified(p).toString()

    def drop(self, df: DataFrame) -> None:
        path = self.made.pop(id(df), None)
        if path:
            p, files = self._files(path)
            files.delete(p, True)

    def clear(self) -> None:
        """Removes all tables."""
        self.made.clear()
        p, files = self._files(self.base)
        files.delete(p, True)

    def _files(self, path: str):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(sc._jsc.hadoopConfiguration())
