"""Best-fit decreasing packing of token sequences.

The decisions of best fit depend on lengths alone, so they are taken once on the histogram of lengths, which has
at most ``capacity`` entries however many documents there are: equal pieces meet equal bins in blocks.  Every
piece then finds its bin by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm.byte_bpe import WordIds
from candela.llm.frames import ranked, saved

CAPACITY = 2048
END = 0
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class CapacityTree:
    """Segment tree over remaining capacities; a leaf is set while an open bin has just that much room."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)

    def put(self, room: int, there: bool) -> None:
        at = self.size + room
        self.any[at] = there
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest room of at least ``need`` that an open bin has."""
        at = self.size + need
        if self.any[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_plan(counts: Iterable[tuple[int, int]], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of ``counts`` (length, how many) into bins of ``capacity``.

    Rows (length, first rank, how many, first bin, offset): the pieces of that length with these ranks go to
    consecutive bins at that offset.  The result is that of placing the pieces one by one, longest first, each
    into the tightest open bin.  Lengths are from 1 to ``capacity``.
    """
    tree, rooms, plan, bins = CapacityTree(capacity), {}, [], 0

    def put(room: int, first: int, many: int) -> None:
        if room and many:
            rooms.setdefault(room, []).append((first, many))
            tree.put(room, True)

    for length, left in sorted(counts, reverse=True):
        rank = 0
        while left:
            room = tree.tightest(length)
            if room is None:
                each = capacity // length
                first, many, room = bins, -(-left // each), capacity
                bins += many
            else:
                first, many = rooms[room].pop()
                if not rooms[room]:
                    tree.put(room, False)
                each = room // length
            full = min(many, left // each)
            used = capacity - room
            for k in range(each if full else 0):
                plan.append((length, rank, full, first, used + k * length))
                rank += full
            put(room - each * length, first, full)
            left -= full * each
            rest = 0
            if full < many and left:
                rest = 1
                for k in range(left):
                    plan.append((length, rank, 1, first + full, used + k * length))
                    rank += 1
                put(room - left * length, first + full, 1)
                left = 0
            put(room, first + full + rest, many - full - rest)
    return plan


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole ones of ``capacity``, the first takes the remainder."""
    first = total - (total - 1) // capacity * capacity
    starts = [0, *range(first, total, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], total])]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of every document: ids of the whole text, added tokens too, then END.  A null text is empty."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = WordIds.of(vocabulary)
        end = END.to_bytes(4, "little")
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                data = ids.text(text or "") + end
                for k, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                    out.append((doc_id, k, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(pieces, PIECES)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens; one row per piece.

    ``docs`` needs doc_id and text; other columns are ignored.  Null or empty text: one piece, only the END id.
    Repeated rows are packed each for itself; an empty table gives no rows.
    """
    pieces = saved(token_pieces(docs, vocabulary, capacity), "pieces")
    counts = [(r["length"], r["count"]) for r in pieces.groupBy("length").count().collect()]
    plan = np.array(best_fit_plan(counts, capacity) or [(0, 0, 0, 0, 0)], dtype=np.int64)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    rank_bits = 48
    starts = (plan[:, 0] << rank_bits) + plan[:, 1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank = batch.pop("rank").to_numpy(np.int64)
            at = np.searchsorted(starts, (batch["length"].to_numpy(np.int64) << rank_bits) + rank, side="right") - 1
            batch["sequence_id"] = plan[at, 3] + rank - plan[at, 1]
            batch["offset"] = plan[at, 4]
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            yield batch

    order = ["doc_id", "piece", "start", "ids_crc32"]
    rows = ranked(pieces, "length", order, sum(n for _, n in counts)).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return rows.mapInPandas(place, PIECES + ", sequence_id bigint, offset bigint")
