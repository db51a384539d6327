"""The pipeline on a small table, and the registered queries against SQL."""

import os
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from candela.functions.durable import scratch_path

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, odd_docs):
    rng = random.Random(4)
    common = "the of and to a in is that it was for on are as with his they at be this".split()

    def text(n):
        return " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("etaoinshrdlu") for _ in range(6)) for _ in range(n))

    clean = [(1000 + k, text(150)) for k in range(60)]
    long = text(3000)
    rows = clean + [(2000, clean[0][1].replace(" ", "  ", 1)), (2001, clean[0][1]), (3000, long), (3001, long.replace(" the ", " the  ", 1) + " end"), (3002, "too short")]
    rows += [(4000, clean[1][1] + " password=abcdef0123456789 " + text(50))]
    docs = odd_docs.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"), allowMissingColumns=True)
    names = ["quality rules", "exact duplicates", "near duplicates", "secret scans", "packing"]
    assert [n for n, _ in corpus_pipeline.STAGES] == names
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        path = scratch_path(spark, "stage")
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if name != "packing":
            assert after.columns == docs.columns
        docs = after
        left[name] = {r.doc_id: r for r in docs.collect()}
    ids = {k: set(v) for k, v in left.items()}
    assert 3002 not in ids["quality rules"] and {i for i, _ in clean} <= ids["quality rules"]
    assert ids["quality rules"] - ids["exact duplicates"] >= {2000, 2001} and {i for i, _ in clean} <= ids["exact duplicates"]
    assert ids["exact duplicates"] - ids["near duplicates"] == {3001}
    assert ids["secret scans"] == ids["near duplicates"] == ids["packing"]
    masked = left["secret scans"][4000]
    assert "[SECRET]" in masked.text and "abcdef0123456789" not in masked.text and masked.text.startswith(clean[1][1])


def test_empty_tables_pass_through(spark, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, no_docs, "")
        assert out.count() == 0
        if name != "packing":
            assert out.columns == no_docs.columns


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op2_secret_scans", "op9_url_filters", "op13_fill_middle"])
def test_query_equals_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, sql = entry.queries()[name](spark, SF), con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    at = [sql.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in sql.fetchall())


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)] + ["pipeline"]


def test_pipeline_runs_over_the_whole_table(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
