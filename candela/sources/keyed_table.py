"""A table with one row for each key, in hash buckets: a change rewrites only the buckets that its keys fall into.

A version is a folder with the rewritten buckets and a manifest, which names the folder of every bucket.  A version is
there once its manifest is complete, so a change that fails or runs again leaves the versions before it as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.operators.tables import remove, upsert

#: A bucket should be of a size that one task can merge; more buckets make a small change cheaper.
BUCKETS = 64
MANIFEST = "bucket int, buckets int, folder string"


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, root: str) -> list[int]:
    """All complete versions."""
    fs, base = _fs(spark, root)
    if not fs.exists(base):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(base)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("version=") and fs.exists(_fs(spark, f"{root}/{n}/manifest/_SUCCESS")[1]))


def _manifest(spark: SparkSession, root: str, version: int) -> dict[int, tuple[int, str]]:
    """Bucket to (number of buckets, folder); there are as many rows as buckets."""
    rows = spark.read.schema(MANIFEST).parquet(f"{root}/version={version}/manifest").collect()
    return {r["bucket"]: (r["buckets"], r["folder"]) for r in rows}


def _read(spark: SparkSession, root: str, folders: list[str], schema) -> DataFrame:
    paths = [f"{root}/{f}" for f in folders if _fs(spark, f"{root}/{f}")[0].exists(_fs(spark, f"{root}/{f}")[1])]  # a bucket without rows has none
    if not paths:
        return spark.createDataFrame([], schema)
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(*paths)


def read(spark: SparkSession, root: str, schema=None, version: int | None = None) -> DataFrame:
    """All rows of a version, by default of the latest; without any, none, which needs the schema."""
    found = versions(spark, root)
    if not found:
        return spark.createDataFrame([], schema)
    return _read(spark, root, [f for _, f in _manifest(spark, root, found[-1] if version is None else version).values()], schema)


def _write(df: DataFrame, root: str, version: int, key: str, touched: list[int], kept: dict[int, tuple[int, str]], buckets: int) -> None:
    spark = df.sparkSession
    home = f"version={version}/data"
    rows = df.withColumn("_bucket", _bucket(key, buckets))
    rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{root}/{home}")
    names = {b: f for b, (_, f) in kept.items()} | {b: f"{home}/_bucket={b}" for b in touched}
    manifest = spark.createDataFrame([(b, buckets, f) for b, f in sorted(names.items())], MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{root}/version={version}/manifest")


def create(df: DataFrame, root: str, key: str, version: int = 0, buckets: int = BUCKETS) -> None:
    """The first version, of rows with different keys."""
    _write(df, root, version, key, list(range(buckets)), {}, buckets)


def _changed(spark: SparkSession, root: str, version: int, changes: DataFrame, key: str, merge) -> None:
    """Version ``version`` from the latest complete one before it; only buckets with keys of ``changes`` are read and written."""
    before = [v for v in versions(spark, root) if v < version]
    if not before:
        create(merge(changes.limit(0), changes), root, key, version)
        return
    manifest = _manifest(spark, root, before[-1])
    buckets = next(iter(manifest.values()))[0]
    touched = sorted(r[0] for r in changes.select(_bucket(key, buckets)).distinct().collect())  # no more than there are buckets
    old = _read(spark, root, [manifest[b][1] for b in touched], merge.schema)
    _write(merge(old, changes), root, version, key, touched, {b: f for b, f in manifest.items() if b not in touched}, buckets)


def upsert_rows(spark: SparkSession, root: str, version: int, new: DataFrame, key: str, arrival: str) -> None:
    """Old rows, replaced by newer rows of the same key."""

    def merge(old: DataFrame, changes: DataFrame) -> DataFrame:
        return upsert(old, changes, key, arrival)

    merge.schema = new.schema
    _changed(spark, root, version, new, key, merge)


def delete_keys(spark: SparkSession, root: str, version: int, closed: DataFrame, key: str, schema) -> None:
    """Without the rows whose keys are in ``closed``."""

    def merge(old: DataFrame, changes: DataFrame) -> DataFrame:
        return remove(old, changes, key)

    merge.schema = schema
    if versions(spark, root):
        _changed(spark, root, version, closed.select(key), key, merge)


def remove_old(spark: SparkSession, root: str, keep: int) -> int:
    """Forget the versions before ``keep``: their manifests go, and the buckets that no later manifest names.  Returns the folders removed."""
    found = versions(spark, root)
    named = {f for v in found if v >= keep for _, f in _manifest(spark, root, v).values()}
    gone = 0
    for v in (v for v in found if v < keep):
        for _, folder in _manifest(spark, root, v).values():
            fs, path = _fs(spark, f"{root}/{folder}")
            if folder not in named and fs.exists(path):
                gone += bool(fs.delete(path, True))
        fs, path = _fs(spark, f"{root}/version={v}/manifest")
        fs.delete(path, True)
    return gone
