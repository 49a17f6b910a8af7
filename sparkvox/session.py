"""Session helpers: a configured local session for tests and a shared scratch
location derived from ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings applied only when the session does not define them already.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session as used by tests and the bench (UI off, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sparkvox")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Local runs trade memory for speed when building cached tables;
        # cluster sessions keep Spark's compressed default.
        .config("spark.sql.inMemoryColumnarStorage.compressed", "false")
    )
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def private_folder(master: str) -> str:
    """A folder of this machine for a session whose driver and executors are
    one process; on any other master such a folder would split the data."""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
    return tempfile.mkdtemp(prefix="sparkvox-ckpt-")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; a private one is set only where
    none is configured and the session is local."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or private_folder(sc.master))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "sparkvox", f"{name}-{uuid.uuid4().hex[:12]}")


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: How large tables of words are written: numbers as differences, pages by zstd. They take half the disk of Spark's defaults.
PACKED = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}


def bucketed(df: DataFrame, n: int, col: str, name: str, path: str) -> None:
    """Write ``df``, whose rows are dealt to ``n`` partitions by ``col`` already,
    as a table bucketed the same way. A task has the rows of one bucket, so they
    are written as they come; Spark would sort them by bucket otherwise."""
    spark, key = df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, "0")
    spark.conf.set(key, "4")
    try:
        df.write.options(**PACKED).bucketBy(n, col).option("path", path).format("parquet").saveAsTable(name)
    finally:
        spark.conf.set(key, before)


def in_buckets(spark: SparkSession, path: str, n: int, col: str, name: str) -> DataFrame:
    """Files that ``bucketed`` wrote, as a table of a name that knows its buckets."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    at = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({col}) INTO {n} BUCKETS LOCATION '{at}'")
    return spark.table(name)


def buckets_of(spark: SparkSession, name: str) -> int:
    """The number of buckets of a table."""
    return int(spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").first()["data_type"])


def clear_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table of this application. Results that
    still read them fail afterwards."""
    drop_folder(spark, os.path.join(ensure_checkpoint_dir(spark), "sparkvox"))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sparkvox`` importable in executor Python workers (needed by the
    pandas UDFs and mapInPandas/applyInPandasWithState functions): the
    package's .py files are zipped once per application and added with
    ``SparkContext.addPyFile``, which ships them with every task."""
    import zipfile

    import sparkvox

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(sparkvox.__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="sparkvox-pkg-"), "sparkvox.zip")
    with zipfile.ZipFile(out, "w") as z:
        for dirpath, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)
