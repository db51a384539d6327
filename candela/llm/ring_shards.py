"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

A key goes to the first virtual node clockwise of its hash whose shard has room.  The ring has a fixed number of
arcs, so rooms are handed out on the counts of keys by arc: in pass k, what an arc has left asks the k-th virtual
node clockwise.  That is the ring's own rule with the keys taken pass by pass.  A key then finds its shard by its
rank in its arc.  The rooms add up to the keys, so shards differ by one row at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm.frames import ranked, saved

NODES = 128
RANK_BITS = 44  # of a rank in an arc, beside 19 bits for the arc


class Ring:
    """Virtual nodes of ``shards`` shards by their place on the ring of signed 64-bit numbers."""

    def __init__(self, shards: int, nodes: int = NODES) -> None:
        if not 0 < shards * nodes < 1 << 19:
            raise ValueError("from 1 to 524287 virtual nodes")
        places = sorted(
            (int.from_bytes(hashlib.blake2b(f"{shard}/{k}".encode(), digest_size=8).digest(), "big", signed=True), shard)
            for shard in range(shards) for k in range(nodes)
        )
        self.shards = shards
        self.places = np.array([p for p, _ in places], dtype=np.int64)
        self.owner = np.array([s for _, s in places], dtype=np.int64)

    def arc(self, keys: np.ndarray) -> np.ndarray:
        """Number of the first virtual node at or clockwise of each key."""
        return np.searchsorted(self.places, keys) % len(self.places)

    def rooms(self, total: int, slack: float = 0.0) -> np.ndarray:
        """Most rows of each shard: with no slack they add up to ``total`` and differ by one."""
        most = int(total * (1 + slack))
        return most // self.shards + (np.arange(self.shards) < most % self.shards)

    def plan(self, counts: dict[int, int], slack: float = 0.0) -> list[tuple[int, int, int, int]]:
        """Rows (arc, first rank, shard, first slot) for counts of keys by arc; each holds until the next of its arc."""
        room = self.rooms(sum(counts.values()), slack).tolist()
        owner, n, load = self.owner.tolist(), len(self.owner), [0] * self.shards
        left, done, out, k = {a: c for a, c in sorted(counts.items()) if c}, dict.fromkeys(counts, 0), [], 0
        while left:
            for arc in list(left):
                shard = owner[(arc + k) % n]
                took = min(left[arc], room[shard] - load[shard])
                if took:
                    out.append((arc, done[arc], shard, load[shard]))
                    load[shard] += took
                    done[arc] += took
                    left[arc] -= took
                    if not left[arc]:
                        del left[arc]
            k += 1
        return out


def shard_keys(docs: DataFrame, ring: Ring, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    ``docs`` needs doc_id and text; other columns are ignored.  A null text has no bytes.  Null and repeated ids are
    keys like any other: equal keys share their place on the ring and spill clockwise together.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )

    @F.pandas_udf("int")
    def arc_of(keys: pd.Series) -> pd.Series:
        return pd.Series(ring.arc(keys.to_numpy(np.int64)).astype(np.int32))

    keys = saved(rows.withColumn("arc", arc_of(F.xxhash64("doc_id"))), "keys")
    counts = {r["arc"]: r["count"] for r in keys.groupBy("arc").count().collect()}
    plan = np.array(sorted(ring.plan(counts, slack)) or [(0, 0, 0, 0)], dtype=np.int64)
    starts = (plan[:, 0] << RANK_BITS) + plan[:, 1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank, arc = batch.pop("rank").to_numpy(np.int64), batch.pop("arc").to_numpy(np.int64)
            at = np.searchsorted(starts, (arc << RANK_BITS) + rank, side="right") - 1
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            batch["shard"] = plan[at, 2].astype(np.int32)
            batch["slot"] = plan[at, 3] + rank - plan[at, 1]
            yield batch

    placed = ranked(keys, "arc", ["doc_id", "text_crc32", "size"], sum(counts.values())).select("doc_id", "size", "text_crc32", "arc", "rank")
    placed = placed.mapInPandas(place, "doc_id bigint, size bigint, text_crc32 bigint, shard int, slot bigint")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
