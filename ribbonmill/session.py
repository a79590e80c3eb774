"""Session set-up and the few settings the library reads from a session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str | int = 8, app: str = "ribbonmill", **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores if str(cores).isdigit() else 8))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RIBBONMILL_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may go without; it gets a folder of its own."""
    d = spark.conf.get("spark.checkpoint.dir", "")
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="ribbonmill_")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


_TABLES: list[str] = []


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage: a table written to the shared folder, so that a lost executor costs only its own tasks. The driver removes it when it ends, or earlier by ``clean``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/ribbonmill_{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    _TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Remove the tables that ``cut`` wrote, once the results made of them are stored; their number."""
    n = len(_TABLES)
    while _TABLES:
        fs, p = _file_system(spark, _TABLES.pop())
        fs.delete(p, True)
    return n


def ship(spark: SparkSession) -> None:
    """Makes this package importable on all executors, wherever the driver has it from; once a session's context."""
    sc = spark.sparkContext
    if getattr(sc, "_ribbonmill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="ribbonmill_"), "ribbonmill.zip")  # the driver serves it
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    sc._ribbonmill_shipped = True


def spread(df: DataFrame, *keys: str, per_core: int = 4 << 20) -> DataFrame:
    """df over all cores, by keys if any are given, if it is small; larger inputs come in enough parts by themselves and aren't moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, *keys) if 0 < size < per_core * cores else df


#: Rows up to which a table read back from ``cut`` is broadcast.
FEW = 200_000


def few(df: DataFrame) -> DataFrame:
    """df, which must be cheap to count, to be broadcast if it has few rows; larger ones are left to Spark."""
    return F.broadcast(df) if df.count() <= FEW else df


def hash_sample(df: DataFrame, total: int, key: str, n: int) -> DataFrame:
    """At most n rows of df, the first by a hash of key. A threshold on the hash comes first, so that no more than about 4 n rows leave the tasks, however many there are. total: rows of the table behind df."""
    h = F.pmod(F.xxhash64(key), F.lit(1 << 31))
    return df.where(h < min(1 << 31, int(4 * n / max(total, 1) * (1 << 31)) + 1)).orderBy(h, key).limit(n)
