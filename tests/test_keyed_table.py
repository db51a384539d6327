"""Keyed tables: merges against plain dictionaries, what a small change rewrites, replays, and removal of old versions."""

from __future__ import annotations

from pathlib import Path

from candela.sources import keyed_table as kt

SCHEMA = "k long, v string, arrival long"


def content(spark, root, version=None):
    return {r["k"]: r["v"] for r in kt.read(spark, root, SCHEMA, version).collect()}


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    assert content(spark, root) == {}
    kt.create(spark.createDataFrame([(k, f"a{k}", 0) for k in range(500)], SCHEMA), root, "k", buckets=16)
    want = {k: f"a{k}" for k in range(500)}
    assert content(spark, root) == want

    new = spark.createDataFrame([(3, "late", 5), (3, "early", 2), (900, "new", 1)], SCHEMA)
    for _ in range(2):  # a change that runs again
        kt.upsert_rows(spark, root, 1, new, "k", "arrival")
    after = want | {3: "late", 900: "new"}
    assert content(spark, root) == after and content(spark, root, 0) == want
    written = [p.name for p in Path(root, "version=1", "data").iterdir() if p.name.startswith("_bucket")]
    assert 1 <= len(written) <= 2  # of 16

    kt.delete_keys(spark, root, 2, spark.createDataFrame([(3,), (4,), (12345,)], "k long"), "k", SCHEMA)
    last = {k: v for k, v in after.items() if k not in (3, 4)}
    assert content(spark, root) == last
    size = len(list(Path(root).rglob("*.parquet")))
    assert kt.remove_old(spark, root, 2) > 0
    assert kt.versions(spark, root) == [2] and content(spark, root) == last
    assert len(list(Path(root).rglob("*.parquet"))) < size


def test_first_change_makes_the_table(spark, tmp_path):
    root = str(tmp_path / "t")
    kt.delete_keys(spark, root, 0, spark.createDataFrame([(1,)], "k long"), "k", SCHEMA)
    assert kt.versions(spark, root) == []
    kt.upsert_rows(spark, root, 7, spark.createDataFrame([(1, "x", 1), (1, "y", 2)], SCHEMA), "k", "arrival")
    assert content(spark, root) == {1: "y"}
    # a version without a manifest is not there
    Path(root, "version=8", "data").mkdir(parents=True)
    assert kt.versions(spark, root) == [7]
