"""Versioned bundles: several tables and a few numbers that belong together and count only as a whole.

A version is a folder of its own with one Parquet table per part. Its manifest, written last by a rename, names the parts with their rows, a
checksum and their schemas, so a version whose writer died, or that lost a file since, is never read: ``open_bundle`` takes the newest
complete version, or refuses.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "manifest.json"


class IncompleteBundle(ValueError):
    """No version is whole, or the one asked for is not."""


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and its constructor of paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """The whole text or nothing: written beside its place, then renamed."""
    fs, make = _files(spark, path)
    beside = make(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(beside)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    if not fs.rename(beside, make(path)):
        raise OSError(f"{path} could not be put in place")


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, make = _files(spark, path)
    if not fs.exists(make(path)):
        return None
    return "\n".join(r.value for r in spark.read.text(path).collect())


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``, sorted."""
    fs, make = _files(spark, path)
    if not fs.exists(make(path)):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(make(path)) if s.isDirectory())


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in ``path``, sorted."""
    fs, make = _files(spark, path)
    if not fs.exists(make(path)):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(make(path)) if not s.isDirectory())


def file_marks(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, length and time of every file under ``path``: they change when the data do."""
    fs, make = _files(spark, path)
    if not fs.exists(make(path)):
        return []
    found, each = [], fs.listFiles(make(path), True)
    while each.hasNext():
        s = each.next()
        found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(found)


def _measure(table: DataFrame) -> tuple[int, int]:
    """Rows, and a checksum that does not depend on their order."""
    row = table.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*table.columns)).alias("x")).first()
    return row["n"], row["x"] or 0


@dataclass(frozen=True)
class Bundle:
    spark: SparkSession
    path: str
    meta: dict
    parts: dict[str, dict]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(self.parts[name]["schema"])).parquet(f"{self.path}/{name}")


def write_bundle(spark: SparkSession, root: str, parts: dict[str, DataFrame], meta: dict, by: dict[str, str] | None = None) -> str:
    """Write a new version and return its folder; ``by`` names the column that a part's folders are cut by."""
    taken = [int(f[1:7]) for f in folders(spark, root) if f[:1] == "v" and f[1:7].isdigit()]
    path = f"{root.rstrip('/')}/v{max(taken, default=0) + 1:06d}-{uuid.uuid4().hex[:8]}"
    listed = {}
    for name, table in parts.items():
        writer = table.write.mode("error")
        (writer.partitionBy(by[name]) if by and name in by else writer).parquet(f"{path}/{name}")
        stored = spark.read.schema(table.schema).parquet(f"{path}/{name}")
        rows, checksum = _measure(stored)
        listed[name] = {"rows": rows, "checksum": checksum, "schema": stored.schema.jsonValue()}
    write_text(spark, f"{path}/{MANIFEST}", json.dumps({"meta": meta, "parts": listed}))
    return path


def open_bundle(spark: SparkSession, root: str, version: str | None = None) -> Bundle:
    """The newest complete version under ``root``, or ``version`` if it is complete."""
    for name in [version] if version else reversed(folders(spark, root)):
        path = f"{root.rstrip('/')}/{name}"
        text = read_text(spark, f"{path}/{MANIFEST}")
        if text is None:
            continue
        said = json.loads(text)
        bundle = Bundle(spark, path, said["meta"], said["parts"])
        there = set(folders(spark, path))
        if all(p in there and _measure(bundle.table(p)) == (d["rows"], d["checksum"]) for p, d in bundle.parts.items()):
            return bundle
    raise IncompleteBundle(f"no complete bundle in {root}" if version is None else f"bundle {version} in {root} is not complete")
