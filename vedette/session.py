"""Session settings and the lineage cut."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cpus: str = "8", app: str = "vedette") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers of the session, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_vedette_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="vedette-"), "vedette_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    # the driver-side process of a stateful stream does not read added files
    known = sc.environment.get("PYTHONPATH")
    sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, os.path.dirname(root)]))
    sc._vedette_shipped = True


def in_utc(spark: SparkSession) -> SparkSession:
    """All event times are UTC microseconds; pin the session zone once."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); on one machine, as in tests, a local one if none is set."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="vedette-")


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, if it is there."""
    files, at = _folder(spark, path)
    files.delete(at, True)


def make_folder(spark: SparkSession, path: str) -> None:
    files, at = _folder(spark, path)
    files.mkdirs(at)


def names_in(spark: SparkSession, path: str) -> list[str]:
    files, at = _folder(spark, path)
    return [f.getPath().getName() for f in files.listStatus(at)]


def newest_number(spark: SparkSession, path: str) -> int:
    """The largest number among the names in a folder of the shared store."""
    return max(int(n) for n in names_in(spark, path) if n.isdigit())


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is used only where the session names none, as in tests.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitions for Python groups, one per configured shuffle partition.

    Group work in Python costs far more than its bytes suggest, so these partitions must
    not be merged by size afterwards; a partition count that is named is left alone.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def widen(scan: DataFrame) -> DataFrame:
    """Deal out the rows of a scan that has fewer splits than the session has cores.

    For CPU-heavy work straight on a small file; a large input has its splits and is
    returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def small_side(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Join side that should be small: computed once, counted, broadcast only within the limit.

    The planner cannot know that an aggregate over a huge table has few rows and would
    shuffle the huge table for the join. Above the limit it stays an ordinary join.
    """
    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.count() <= max_rows else kept
