"""A small catalog over temporary views: databases, versions, manifests, and key constraints as metadata."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.relational import unique_violations
from quern.sources import storage


@dataclass
class Entry:
    name: str
    path: str
    fmt: str
    primary_key: tuple[str, ...] = ()
    unique: list[tuple[str, ...]] = field(default_factory=list)
    version: int = 1
    #: The objects the table had when it was added.
    manifest: list[storage.Status] = field(default_factory=list)


class Catalog:
    """Tables by lower-cased name.  Constraints are not enforced on data; ``violations`` checks them."""

    def __init__(self, spark: SparkSession):
        self.spark, self._entries, self._databases = spark, {}, {"default"}

    def create_database(self, name: str) -> None:
        """Tables of a database are named ``database.table``; their views ``database__table``."""
        if name.lower() in self._databases:
            raise ValueError(f"there is a database {name}")
        self._databases.add(name.lower())

    def drop_database(self, name: str) -> None:
        """With all its tables."""
        for t in [t for t in self._entries if t.startswith(name.lower() + ".")]:
            self.drop(t)
        self._databases.remove(name.lower())

    def databases(self) -> list[str]:
        return sorted(self._databases)

    def add(self, name: str, path: str, fmt: str = "parquet", primary_key: tuple[str, ...] = (), unique: list[tuple[str, ...]] | None = None) -> Entry:
        df = self.spark.read.format(fmt).load(path)
        for key in [primary_key, *(unique or [])]:
            if missing := set(key) - set(df.columns):
                raise ValueError(f"unknown key columns {sorted(missing)}")
        if len({frozenset(k) for k in [primary_key, *(unique or [])] if k}) != len([k for k in [primary_key, *(unique or [])] if k]):
            raise ValueError("one constraint per set of columns")
        database, _, _ = name.lower().rpartition(".")
        if database and database not in self._databases:
            raise ValueError(f"no database {database}")
        df.createOrReplaceTempView(self._view(name))
        before = self._entries.get(name.lower())
        self._entries[name.lower()] = e = Entry(name.lower(), path, fmt, primary_key, unique or [], before.version + 1 if before else 1, storage.ls(self.spark, path))
        return e

    @staticmethod
    def _view(name: str) -> str:
        return name.lower().replace(".", "__")

    def drop(self, name: str) -> None:
        self._entries.pop(name.lower())
        self.spark.catalog.dropTempView(self._view(name))

    def entry(self, name: str) -> Entry:
        return self._entries[name.lower()]

    def changed(self, name: str) -> bool:
        """Whether objects were added, removed or written again since the table was added."""
        e = self.entry(name)
        return [(x.path, x.token) for x in storage.ls(self.spark, e.path)] != [(x.path, x.token) for x in e.manifest]

    def exists(self, name: str) -> bool:
        return name.lower() in self._entries

    def names(self) -> list[str]:
        return sorted(self._entries)

    def schema(self, name: str) -> T.StructType:
        return self.table(name).schema

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self._view(self._entries[name.lower()].name))

    def partitions(self, name: str) -> DataFrame:
        """The stored objects of a table with size and time of change."""
        found = [(x.path, x.size, x.modified_ms) for x in storage.ls(self.spark, self._entries[name.lower()].path)]
        return self.spark.createDataFrame(found, "path string, size long, ms long").select("path", "size", F.timestamp_millis("ms").alias("modified"))

    def violations(self, name: str) -> dict[tuple[str, ...], DataFrame]:
        e = self._entries[name.lower()]
        return {k: unique_violations(self.table(name), k) for k in [e.primary_key, *e.unique] if k}
