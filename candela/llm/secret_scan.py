"""Secrets, by an incremental ledger of content-addressed texts.

Every version of every document is addressed by the SHA-256 of its bytes.  The ledger holds the spans found in each
blob by each version of each rule, empty lists too.  Only pairs of blob and rule version that it lacks are scanned,
a blob once however many documents hold it, and the findings are joined back to all of these.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.functions.durable import scratch_path
from candela.llm.frames import hot_size, saved, spread_join


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern`` that do not overlap, if group ``group`` has ``least`` characters or more."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


# fixed values: the base rules, in their order.  Where a match is a whole run of characters of one class, the least
# length is part of the pattern.
RULES = (
    Rule(
        "assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)
SPANS = "array<struct<start:bigint,end:bigint>>"


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) in code points, end exclusive: the pattern cuts the text into gaps and matches, whose
    lengths add up to the places."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    held = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.pattern, -1)

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(gaps_, i))
        end = start + F.length(F.get(found_, i))
        fits = F.length(F.get(held_, i)) >= rule.least
        return F.struct(
            end.cast("long").alias("at"),
            F.when(fits, F.concat(acc["out"], F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))))).otherwise(acc["out"]).alias("out"),
        )

    # the three arrays are bound once, as the element of an array, and not computed again for each match
    parts = F.array(F.struct(found.alias("found"), held.alias("held"), gaps.alias("gaps")))

    def places(p: Column) -> Column:
        nonlocal gaps_, found_, held_
        gaps_, found_, held_ = p["gaps"], p["found"], p["held"]
        none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found_) - 1), none, step, lambda acc: acc["out"])

    gaps_ = found_ = held_ = None
    return F.when(text.rlike(rule.pattern), F.transform(parts, places)[0]).otherwise(F.array().cast(SPANS))


def blob_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _chosen(ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    wanted = F.lit(False)
    for r in rules:
        wanted = wanted | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    return ledger.where(wanted)


#: What the folder of all versions is called, after the ledger's name.
VERSIONS = "-versions"


def _kept(spark: SparkSession, ledger: str) -> DataFrame:
    """doc_id, blob and the number of the run that first saw them, of all versions."""
    schema = "doc_id bigint, blob string, seen int"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{ledger}{VERSIONS}")
    return spark.read.schema(schema).parquet(f"{ledger}{VERSIONS}")


def history(spark: SparkSession, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, blob, seen, kind, version and spans: all findings in all versions that any run has seen, with every document
    that ever had the text, whether it still has or not."""
    schema = f"blob string, kind string, version int, spans {SPANS}"
    found = _chosen(spark.read.schema(schema).parquet(ledger), rules).where(F.size("spans") > 0)
    each = found.groupBy("blob").agg(F.collect_list(F.struct("kind", "version", "spans")).alias("f"))
    versions = _kept(spark, ledger)
    hot = versions.groupBy("blob").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= hot_size(versions.count()))
    return spread_join(versions, each, "blob", hot, ["doc_id"]).select("doc_id", "blob", "seen", F.explode("f").alias("f")).select("doc_id", "blob", "seen", "f.*")


def scan(docs: DataFrame, ledger: str, rules: Sequence[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """Bring the ledger at path ``ledger`` up to date with ``docs`` and ``rules``.

    Returns (versions, findings): doc_id and blob of every row of ``docs``, and the ledger's rows blob, kind,
    version, spans for these rules.  What is already in the ledger is not scanned.  Each new pair of document and blob is
    noted for good beside the ledger, so that findings keep their documents when texts change (``history``).
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), blob_of(text).alias("blob"))
    versions = saved(rows.select("doc_id", "blob"), "versions")
    kept = _kept(spark, ledger)
    seen = (kept.agg(F.coalesce(F.max("seen"), F.lit(0))).first()[0]) + 1
    new = versions.distinct().alias("v").join(kept.alias("k"), (F.col("v.blob") == F.col("k.blob")) & F.col("v.doc_id").eqNullSafe(F.col("k.doc_id")), "left_anti")
    new.withColumn("seen", F.lit(seen)).write.mode("append").parquet(f"{ledger}{VERSIONS}")
    schema = f"blob string, kind string, version int, spans {SPANS}"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(ledger)
    known = spark.read.schema(schema).parquet(ledger)

    seen = _chosen(known, rules).groupBy("blob").agg(F.collect_set("kind").alias("seen"))
    blobs = versions.groupBy("blob").agg(F.min("doc_id").alias("holder"))
    missing = F.array_except(F.array(*[F.lit(r.kind) for r in rules]), F.coalesce("seen", F.array().cast("array<string>")))
    todo = blobs.join(seen, "blob", "left").select("blob", "holder", missing.alias("missing")).where(F.size("missing") > 0)
    fresh = rows.join(todo.withColumnRenamed("blob", "own"), (F.col("blob") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("holder")))
    found = F.array(*[
        F.when(F.array_contains("missing", r.kind), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans")))
        for r in rules
    ])
    scanned = fresh.select("blob", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("blob", "f.*")
    # rows repeated with id and all are scanned as often, and noted once
    scanned.dropDuplicates(["blob", "kind", "version"]).write.mode("append").parquet(ledger)
    return versions, _chosen(spark.read.schema(schema).parquet(ledger), rules)


def _by_blob(versions: DataFrame, findings: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """versions with ``found``, the array of all (start, place of the kind, end), in this order."""
    order = F.lit(None).cast("int")
    for k, r in enumerate(rules):
        order = F.when(F.col("kind") == r.kind, k).otherwise(order)
    each = findings.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order.alias("kind"), s["end"].alias("end"))).alias("s"))
    table = each.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("found"))
    total = versions.count()
    hot = versions.groupBy("blob").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= hot_size(total))
    return spread_join(versions, table, "blob", hot, ["doc_id"])


def secret_spans(docs: DataFrame, ledger: str | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, n_<kind> for each rule, base_sha256, spans and blob of every document.

    ``docs`` needs doc_id and text; other columns are ignored.  A null text is empty and has no spans.  Repeated rows
    have a result each; an empty table gives none.
    """
    versions, findings = scan(docs, ledger or scratch_path(docs.sparkSession, "ledger"), rules)
    names = F.array(*[F.lit(r.kind) for r in rules])

    def joined(keep: Column) -> Column:
        return F.array_join(F.transform(keep, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    def of_kind(k: int) -> Column:
        return F.filter("found", lambda s: s["kind"] == k)

    base = len(RULES)
    return _by_blob(versions, findings, rules).select(
        "doc_id",
        *[F.size(of_kind(k)).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(rules)],
        F.sha2(joined(F.filter("found", lambda s: s["kind"] < base)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"), "blob",
    )


MASK = "[SECRET]"


def masked(docs: DataFrame, ledger: str | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with every found span of the text replaced by MASK, overlapping ones by one; n_chars follows the text.

    A null text has no spans and stays null; repeated rows stay as many as they are; an empty table gives no rows.
    """
    ledger = ledger or scratch_path(docs.sparkSession, "ledger")
    versions, findings = scan(docs, ledger, rules)
    dirty = saved(_by_blob(versions.distinct(), findings, rules).where(F.size("found") > 0).groupBy("blob").agg(F.first("found").alias("found")), "dirty")

    text = F.col("row.text")

    def cut(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        inside = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] < acc["at"], inside).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit(MASK)).alias("out")))

    none = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("found", none, cut, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    rows = docs.select(blob_of(F.coalesce("text", F.lit(""))).alias("blob"), F.struct(*docs.columns).alias("row"))
    hot = versions.groupBy("blob").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= hot_size(versions.count()))
    rows = spread_join(rows, dirty, "blob", hot, ["row.doc_id"], "left")
    rows = rows.select("row", F.when(F.col("found").isNotNull(), clean).alias("masked"))
    new = {"text": F.coalesce("masked", text)}
    if "n_chars" in docs.columns:
        length = F.length("masked").cast(dict(docs.dtypes)["n_chars"])
        new["n_chars"] = F.when(F.col("masked").isNotNull(), length).otherwise(F.col("row.n_chars"))
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
