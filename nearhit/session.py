"""Session construction and checkpoint-directory handling."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "nearhit", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's defaults.

    On a cluster, ``master`` is left to spark-submit; locally pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting one only when unset.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that setting
    always wins. Only when nothing is configured (local tests) do we create a
    scratch folder, and only under local mode.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="nearhit-ckpt-", dir=os.environ.get("NEARHIT_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


class Scratch:
    """Tables written under the shared checkpoint folder, so that no later step depends on an executor.

    ``keep`` writes a table and reads it back; ``drop`` removes tables that
    later ones have replaced, so that a loop leaves only its last state."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.base, self.paths = spark, f"{ensure_checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}", {}
        self.made = 0

    def keep(self, df, name: str):
        self.made += 1
        path = f"{self.base}/{name}-{self.made}"
        df.write.parquet(path)
        # the shuffles behind it are spent: Spark drops their files once the JVM has collected their handles
        self.spark.sparkContext._jvm.System.gc()
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def drop(self, *tables) -> None:
        for path, kept in list(self.paths.items()):
            if any(kept is t for t in tables):
                remove(self.spark, path)
                del self.paths[path]


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark keeps it; no folder is no error."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``nearhit`` importable in executor Python workers (once per context).

    Pandas UDFs and ``applyInPandas`` functions are pickled by reference, so
    every worker must be able to import the package; ``addPyFile`` with a zip
    of it distributes it with the job, wherever the driver was started."""
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="nearhit-pkg-"), "nearhit.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(key)
