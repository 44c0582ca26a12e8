"""A stored table that upserts write into: rows in buckets of their key, versions that are switched at once, changes kept as history."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..operators.temporal import capture_changes


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of the table at a path, oldest first."""
    fs, folder = _files(spark, f"{path}/_versions")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"no version {version or ''} of a table at {path}")
    text = spark.read.text(f"{path}/_versions/{version or known[-1]:08d}.json", wholetext=True).first()[0]
    return json.loads(text)


def _commit(spark: SparkSession, path: str, manifest: dict) -> None:
    """The manifest as the next version, or an error if another writer was first: a rename that replaces nothing switches."""
    fs, target = _files(spark, f"{path}/_versions/{manifest['version']:08d}.json")
    _, own = _files(spark, f"{path}/_versions/.{uuid.uuid4().hex}")
    out = fs.create(own)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(own, target):
        fs.delete(own, False)
        raise RuntimeError(f"version {manifest['version']} of {path} was written meanwhile; merge again")


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.hash(F.col(key).cast("string")), F.lit(buckets)))


def _written(df: DataFrame, path: str, buckets: int) -> str:
    """df with _bucket in a new folder, a folder a bucket; its name."""
    name = f"data/{uuid.uuid4().hex}"
    df.repartition(min(buckets, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "_bucket").write.partitionBy("_bucket").parquet(f"{path}/{name}")
    return name


def create(df: DataFrame, path: str, key: str = "id", buckets: int = 16) -> None:
    """A table at a path from df, whose keys are unique and not null; its first version."""
    spark = df.sparkSession
    if versions(spark, path):
        raise ValueError(f"there is a table at {path}")
    rows = _bucketed(df, key, buckets)
    name = _written(rows, path, buckets)
    _commit(spark, path, {"version": 1, "key": key, "buckets": buckets, "schema": df.schema.jsonValue(), "at": {str(b): name for b in range(buckets)}, "history": []})


def _rows(spark: SparkSession, path: str, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
    """The rows of some buckets, or all, with _bucket: files of other buckets aren't opened."""
    schema = StructType.fromJson(manifest["schema"]).add("_bucket", IntegerType())
    by: dict[str, list[int]] = {}
    for b, name in manifest["at"].items():
        if buckets is None or int(b) in buckets:
            by.setdefault(name, []).append(int(b))
    out = None
    for name, own in by.items():
        df = spark.read.schema(schema).parquet(f"{path}/{name}").where(F.col("_bucket").isin(own))
        out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of a version, or as it is."""
    return _rows(spark, path, _manifest(spark, path, version)).drop("_bucket")


def history(spark: SparkSession, path: str) -> DataFrame | None:
    """(key, event_type, old_value, new_value, source, version) of all changes that merges have made; None before the first."""
    manifest = _manifest(spark, path)
    return spark.read.parquet(*[f"{path}/{h}" for h in manifest["history"]]) if manifest["history"] else None


def merge(fresh: DataFrame, path: str) -> int:
    """Upserts fresh, one row a key, into the table at a path and returns its version: the same one if nothing differs.

    Columns that fresh lacks keep their values; columns that the table lacks are left out. Only buckets with rows that differ are written again, into a folder of their own; fields that
    differ, but for last_updated, and rows that are new go into the history. Nothing of it is seen before the last step, which switches to the new version: a write that fails leaves the
    table as it was. A row that differs in last_updated alone counts as equal.
    """
    spark = fresh.sparkSession
    m = _manifest(spark, path)
    key, buckets = m["key"], m["buckets"]
    names = [f["name"] for f in m["schema"]["fields"]]
    own = [c for c in names if c in fresh.columns]
    new = _bucketed(fresh.select(own), key, buckets)
    base = _rows(spark, path, m)
    old = base.join(new.select(key), key, "left_semi").drop("_bucket")
    changed = capture_changes(old, new.drop("_bucket"), key, [c for c in own if c not in (key, "last_updated")])
    added = new.join(base.select(key), key, "left_anti").select(key, F.lit("created").alias("event_type"), F.lit(None).cast("string").alias("old_value"), F.lit(None).cast("string").alias("new_value"), F.lit("auto_update").alias("source"))
    name = f"history/{uuid.uuid4().hex}"
    changed.unionByName(added).withColumn("version", F.lit(m["version"] + 1)).write.parquet(f"{path}/{name}")
    events = spark.read.parquet(f"{path}/{name}")
    keys = events.select(key).distinct()
    touched = [r[0] for r in _bucketed(keys, key, buckets).select("_bucket").distinct().collect()]  # at most `buckets`
    if not touched:
        fs, p = _files(spark, f"{path}/{name}")
        fs.delete(p, True)
        return m["version"]
    part = _rows(spark, path, m, touched)
    some = new.join(keys, key, "left_semi").drop("_bucket").select(F.col(key), F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in own if c != key])
    both = part.join(some, key, "full")
    value = lambda c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in own and c != key else F.col(c)
    rows = _bucketed(both.select([value(c) for c in names]), key, buckets)
    rows = rows.select(*[F.col(c).cast(base.schema[c].dataType).alias(c) for c in names], "_bucket")
    folder = _written(rows, path, buckets)
    at = m["at"] | {str(b): folder for b in touched}
    _commit(spark, path, m | {"version": m["version"] + 1, "at": at, "history": [*m["history"], name]})
    return m["version"] + 1
