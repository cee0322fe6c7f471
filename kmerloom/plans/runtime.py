"""Lineage cuts in the folder that driver and executors share."""

import atexit
import itertools
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_serial = itertools.count()
_run = uuid.uuid4().hex
_made: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = os.path.join(tempfile.gettempdir(), f"kmerloom-{os.getuid()}")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def _drop(path: str) -> None:
    spark = _made.pop(path, None)
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit; the folder is then left to its owner
        pass


@atexit.register
def _drop_all() -> None:
    for path in list(_made):
        _drop(path)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: a lineage cut that outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kmerloom-{_run}/{next(_serial):05d}-{name}"
    df.write.parquet(path)
    _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._kmerloom_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_kmerloom_path", None):
            _drop(path)


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once a Spark context, through Spark's own file server."""
    context = spark.sparkContext
    if getattr(context, "_kmerloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="kmerloom-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "kmerloom_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for at, _, names in os.walk(os.path.join(root, "kmerloom")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    out.write(path, os.path.relpath(path, root))
    context.addPyFile(target)
    context._kmerloom_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if its files split into fewer parts than there are cores: for kernels that cost more than moving
    their rows. Tables with parts enough stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
