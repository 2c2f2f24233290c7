"""Functions by name, registered with Spark SQL as well."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

BUILT_IN = ("methods", "run")


@dataclass(frozen=True)
class Entry:
    function: Callable
    returns: str | DataType
    vectorised: bool = False

    def udf(self) -> Callable[..., Column]:
        return F.pandas_udf(self.function, self.returns) if self.vectorised else F.udf(self.function, self.returns, useArrow=True)


@dataclass
class Registry:
    """name -> function and return type. Two names are always there: ``run`` (any function) and ``methods`` (the names)."""

    spark: SparkSession
    entries: dict[str, Entry] = field(default_factory=dict)

    def register(self, name: str, function: Callable, returns: str | DataType, vectorised: bool = False) -> Registry:
        if not callable(function):
            raise TypeError("a function is needed")
        if name in BUILT_IN:
            raise ValueError(f"{name} is taken")
        self.entries[name] = entry = Entry(function, returns, vectorised)
        self.spark.udf.register(name, entry.udf())
        return self

    def methods(self) -> list[str]:
        return sorted([*self.entries, *BUILT_IN])

    def methods_frame(self) -> DataFrame:
        return self.spark.createDataFrame([(m,) for m in self.methods()], "method string")

    def entry(self, name: str) -> Entry:
        if name not in self.entries:
            raise KeyError(f"unknown method {name!r}")
        return self.entries[name]

    def proxy(self) -> Proxy:
        return Proxy(self)


class Proxy:
    """An attribute for every registered function; calling it with columns gives a column."""

    def __init__(self, registry: Registry):
        self._registry = registry

    def __getattr__(self, name: str) -> Callable[..., Column]:
        try:
            return self._registry.entry(name).udf()
        except KeyError as e:
            raise AttributeError(str(e)) from e

    def __dir__(self) -> list[str]:
        return list(self._registry.entries)


def worker(spark: SparkSession, methods: dict[str, tuple] | None = None) -> Registry:
    """A registry with ``methods``: name -> (function, return type) or (function, return type, vectorised)."""
    registry = Registry(spark)
    for name, entry in (methods or {}).items():
        registry.register(name, *entry)
    return registry
