"""Registry of the queries that run on the driver's tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shelf.session import scratch_path

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """The driver's tables as attributes: ``t.part``, ``t.lineitem`` …"""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def scratch(t: Tables, name: str) -> str:
    """A new folder for what a query writes and reads back."""
    return scratch_path(t.spark, name)


def query(sql: str | None = None, views: str = "", name: str | None = None):
    """Register a query under its function name, with its SQL over the named shared views."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or fn.__name__
        if key in REGISTRY:
            raise ValueError(f"query {key} is registered twice")
        from workload.adapters import with_views
        text = with_views(views.split(), sql) if sql is not None else None
        REGISTRY[key] = Query(key, fn, text)
        return fn

    return register
