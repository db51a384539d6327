"""Exact duplicates by a stateful stream.

Documents arrive as a stream of files.  State keyed by the digest of the normalised text lives on disk in the
state store, has no expiry, and holds the stable identifier of the text's first document, the locator of its
content (file and row) and the number of arrivals.  Digests alone decide nothing: whenever one was seen more than
once, the bytes at both locators are compared in full.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.functions.durable import scratch_path
from candela.llm.frames import SMALL_GROUP, hot_size, lookup, normal_text, saved

ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # else each partition of the state sets aside some MB of disk for logs that stay small
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Bytes of input that one micro-batch takes in.
BATCH_BYTES = 64 << 30
LOCATOR = ["_file", "_row"]


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _glob(path: str) -> str:
    """A pattern that only this path fits: a stream can be read from a pattern even if it names a single file."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/[{name[0]}]{name[1:]}"


def _located(df: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    text = normal_text(F.col("text"))
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"),
        digest(text).alias("_digest"), text.alias("_text"),
    )


def advance(
    spark: SparkSession, path: str, state: str, digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """Take what is new under ``path`` into the state at ``state``, then return the state.

    One row for each digest: _digest, keep_id (least doc_id, null only if there is no other), keep_file and keep_row
    (locator), n.  A later call goes on where the last one stopped.
    """
    schema = spark.read.parquet(path).schema
    with _settings(spark, ON_DISK):
        arrivals = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(_glob(path))
        rows = _located(arrivals, digest).select("_digest", F.struct(F.isnull("doc_id").alias("none"), "doc_id", *LOCATOR).alias("at"))
        seen = rows.groupBy("_digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
        stream = seen.writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start()
        stream.awaitTermination()
        held = spark.read.format("statestore").load(state)
        first, n = (F.col("value")[f.name] for f in held.schema["value"].dataType.fields[:2])
        return saved(
            held.select(
                F.col("key._digest").alias("_digest"), first["doc_id"].alias("keep_id"), first["_file"].alias("keep_file"),
                first["_row"].alias("keep_row"), n.alias("n"),
            ),
            "state",
        )


def decisions(
    spark: SparkSession, path: str, state: str | None = None, digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """One row for each document under ``path``: doc_id, keep_id, group_size, kept, text_sha256, _file, _row.

    The table needs doc_id and text; other columns are ignored.  A null text is empty.  Of equal texts the least
    doc_id stays; a null doc_id stays only among null ones; of repeated rows the first by file and row.  An empty
    table gives no rows.
    """
    held = advance(spark, path, state or scratch_path(spark, "arrivals"), digest, batch_bytes)
    total = held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = held.where(F.col("n") >= hot_size(total)).select("_digest")
    docs = _located(spark.read.parquet(path), digest).withColumn("text_sha256", sha256(F.col("_text")))
    first = (F.col("_file") == F.col("keep_file")) & (F.col("_row") == F.col("keep_row"))
    hits = saved(
        lookup(docs, held, "_digest", hot, LOCATOR).select(
            "doc_id", *LOCATOR, "_digest", "text_sha256", "keep_id", "n", first.alias("kept"), F.when(F.col("n") > 1, F.col("_text")).alias("_text")
        ),
        "hits",
    )
    # full bytes of each later copy against those of the first, which is repeated for every SMALL_GROUP copies
    parts = F.ceil(F.col("n") / SMALL_GROUP).cast("int")
    repeated = hits.where("n > 1")
    firsts = repeated.where("kept").select("_digest", F.col("_text").alias("_first"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    copies = repeated.where("NOT kept").withColumn("_part", F.pmod(F.xxhash64(*LOCATOR), parts).cast("int"))
    other = saved(copies.join(firsts, ["_digest", "_part"]).where(F.col("_text") != F.col("_first")).drop("_first", "_part"), "other")
    columns = ["doc_id", "keep_id", F.col("n").alias("group_size"), "kept", "text_sha256", *LOCATOR]
    if other.limit(1).count() == 0:
        return hits.select(columns)
    # texts that only share a digest with the first: grouped by their bytes
    at = F.struct(F.isnull("doc_id").alias("none"), "doc_id", *LOCATOR)
    groups = other.groupBy("_digest", "_text").agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("m"))
    apart = other.join(groups, ["_digest", "_text"]).select(
        "doc_id", *LOCATOR, "_digest", "text_sha256", F.col("at.doc_id").alias("keep_id"), F.col("m").alias("n"),
        ((F.col("_file") == F.col("at._file")) & (F.col("_row") == F.col("at._row"))).alias("kept"),
    )
    fewer = other.groupBy("_digest").agg(F.count(F.lit(1)).alias("less"))
    same = hits.join(other.select(LOCATOR), LOCATOR, "left_anti").join(fewer, "_digest", "left").withColumn("n", F.col("n") - F.coalesce("less", F.lit(0)))
    return same.select(columns).unionByName(apart.select(columns))


def landed(docs: DataFrame) -> str:
    """Path of a DataFrame as files, for a stream to take in."""
    path = scratch_path(docs.sparkSession, "landed")
    docs.write.parquet(path)
    return path


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""
    spark, path = docs.sparkSession, landed(docs)
    dropped = decisions(spark, path).where("NOT kept").select(LOCATOR)
    rows = spark.read.parquet(path)
    located = rows.select(F.struct(*rows.columns).alias("row"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return located.join(dropped, LOCATOR, "left_anti").select("row.*")
