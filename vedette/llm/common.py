"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import in_utc, shared_folder, ship_package


def prepared(spark: SparkSession) -> SparkSession:
    """Session with this package on the workers and times in UTC."""
    ship_package(in_utc(spark))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str) -> Column:
    """The text of a row, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def hex_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of a text in UTF-8."""
    return F.sha2(text.cast("binary"), 256)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"{wanted}_"
    return wanted


_memories: dict[str, Callable[[], object]] = {}


def only_memory(owner: str, forget: Callable[[], object]) -> None:
    """Called in a worker by an operator that remembers words: what other operators remember there goes.

    Workers are reused from stage to stage and would keep the memories of all of them.
    """
    for name in [n for n in _memories if n != owner]:
        _memories.pop(name)()
    _memories[owner] = forget


@contextmanager
def stored(df: DataFrame):
    """The rows written to the shared folder and read again; the files go when the block ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4()}"
    df.write.parquet(path)
    try:
        yield spark.read.parquet(path)
    finally:
        files = spark._jvm.org.apache.hadoop.fs.Path(path)
        files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(files, True)
