"""Stored objects: status, listing, removal and a check for change, on any file system that the session reaches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Status:
    """One object; ``token`` changes when the object is written again."""

    path: str
    size: int
    modified_ms: int

    @property
    def token(self) -> str:
        return f"{self.size}-{self.modified_ms}"


def _open(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _status(f) -> Status:
    return Status(f.getPath().toString(), f.getLen(), f.getModificationTime())


def status(spark: SparkSession, path: str) -> Status | None:
    """None for what isn't there."""
    p, fs = _open(spark, path)
    return _status(fs.getFileStatus(p)) if fs.exists(p) else None


def ls(spark: SparkSession, path: str, suffix: str = "") -> list[Status]:
    """All objects below a path, by name; those that begin with ``_`` or ``.`` are no data.  A single object is listed itself."""
    p, fs = _open(spark, path)
    if not fs.exists(p):
        return []
    found, files = [], fs.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        name = f.getPath().getName()
        if name[0] not in "_." and name.endswith(suffix):
            found.append(_status(f))
    return sorted(found, key=lambda x: x.path)


def delete(spark: SparkSession, path: str) -> bool:
    """Whether there was anything to remove."""
    p, fs = _open(spark, path)
    return bool(fs.delete(p, True))


def unchanged(spark: SparkSession, seen: list[Status]) -> bool:
    """Whether all objects are still as they were listed."""
    return all((now := status(spark, x.path)) is not None and now.token == x.token for x in seen)
