"""Query registry: name -> (Spark callable, SQL twin)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import in_utc, ship_package
from ..sources.views import duck_ctes, view


class Views:
    """Attribute access to the derived views: ``v.sec_events``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = in_utc(spark), sf_dir
        ship_package(spark)

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register ``fn(Views) -> DataFrame``; ``sql`` may start with its own WITH."""

    def wrap(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            if views:
                head = duck_ctes(views)
                body = head + (",\n" + body[5:] if body.startswith("WITH ") else "\n" + body)
            ORACLES[name] = body
        return fn

    return wrap
