"""Writers: CSV, JSON summaries, markdown reports, trade tables, split datasets and models."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """With ``partition_by``, rows are gathered by it first, large values in several tasks, so that files are not tasks times values."""
    rows = df.hint("rebalance", *partition_by) if partition_by else df
    writer = rows.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown_rows(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Comparison rows as lines of a markdown table, with a sort key."""
    types = dict(df.dtypes)
    cell = lambda n: F.format_string("%.2f", n) if types[n] == "double" else F.col(n).cast("string")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(cell(n), F.lit("")) for n in columns]), F.lit(" |"))
    return df.select(F.col(key), line.alias("line"))


def markdown_report(df: DataFrame, columns: list[str], key: str, title: str) -> DataFrame:
    """Title, header and rows of the report in order, ready for a text writer."""
    spark = df.sparkSession
    head = [(0, "", f"# {title}"), (1, "", ""), (2, "", "| " + " | ".join(columns) + " |"),
            (3, "", "|" + "---|" * len(columns))]
    top = spark.createDataFrame(head, "part int, sort_key string, line string")
    body = markdown_rows(df, columns, key).select(F.lit(4).alias("part"), F.col(key).cast("string").alias("sort_key"), "line")
    return top.unionByName(body).orderBy("part", "sort_key")


# ---- trade tables ------------------------------------------------------------------------


def append_alerts(alerts: DataFrame, path: str) -> None:
    alerts.write.mode("append").parquet(path)


# ---- splits and models ----------------------------------------------------------------------


def write_splits(assigned: DataFrame, path: str) -> None:
    """Split rows partitioned by split and role, so that one split reads only its files."""
    rows = assigned.hint("rebalance", "split_num", "role")  # a large split is still written by several tasks
    rows.write.mode("overwrite").partitionBy("split_num", "role").parquet(path)


def read_split(spark: SparkSession, path: str, split_num: int, role: str) -> DataFrame:
    return spark.read.parquet(path).where((F.col("split_num") == split_num) & (F.col("role") == role))


def count_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).agg(F.count_distinct("split_num").alias("splits"))


def save_model(model: PipelineModel, path: str, features: list[str], metadata: dict) -> None:
    """Model with its feature list and metadata."""
    from pyspark.sql import SparkSession

    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    text = json.dumps({"features": features, **metadata}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    text = spark.read.text(f"{path}/metadata").first()[0]
    return PipelineModel.load(f"{path}/model"), json.loads(text)
