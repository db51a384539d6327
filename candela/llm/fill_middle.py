"""Fill-in-the-middle form of documents, cut through a learned rank index.

A cut is given in code points, but a text is bytes.  The index of a text maps the rank of every code point boundary
to its byte offset: straight segments are fitted to all boundary offsets so that none is further than ``bound`` bytes
from its segment, and what is left of each offset is stored.  A cut is predicted by its segment and then put right by
its stored residual, so it is exact, whatever the rounding of the fit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: marks of the three parts, and the shares of the forms in per cent
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
#: Bytes that a boundary may lie away from its segment.
BOUND = 32
#: Boundaries that a fit looks at first; doubled as long as one segment holds them.
FIRST_SPAN = 1024


@dataclass(frozen=True)
class RankIndex:
    """Byte offset of each code point boundary of a text, as segments and residuals.

    ``starts`` are the ranks at which segments begin, ``bases`` their first offsets, ``slopes`` bytes a code point.
    """

    starts: np.ndarray
    bases: np.ndarray
    slopes: np.ndarray
    residuals: np.ndarray

    @staticmethod
    def fit(offsets: np.ndarray, bound: int = BOUND) -> RankIndex:
        """Segments for rising ``offsets``, the first of which is 0; each is as long as the cone of its slopes is open."""
        starts, bases, slopes, left = [], [], [], []
        total, at = len(offsets), 0
        while at < total:
            span = FIRST_SPAN
            while True:
                rise = offsets[at + 1 : at + span] - offsets[at]
                run = np.arange(1, len(rise) + 1)
                low, high = np.maximum.accumulate((rise - bound) / run), np.minimum.accumulate((rise + bound) / run)
                closed = np.flatnonzero(low > high)
                if len(closed) or at + span >= total:
                    break
                span *= 2
            size = int(closed[0]) if len(closed) else len(rise)
            slope = float((low[size - 1] + high[size - 1]) / 2) if size else 0.0
            starts.append(at)
            bases.append(int(offsets[at]))
            slopes.append(slope)
            steps = np.arange(size + 1)
            left.append(offsets[at : at + size + 1] - offsets[at] - np.rint(slope * steps).astype(np.int64))
            at += size + 1
        residuals = np.concatenate(left)
        most = int(np.abs(residuals).max())
        kind = np.int8 if most < 128 else np.int16 if most < 1 << 15 else np.int64
        return RankIndex(np.array(starts), np.array(bases), np.array(slopes), residuals.astype(kind))

    def offset(self, rank: int) -> int:
        """Byte offset of the boundary before code point ``rank``."""
        k = int(np.searchsorted(self.starts, rank, side="right")) - 1
        predicted = int(self.bases[k]) + int(np.rint(self.slopes[k] * (rank - int(self.starts[k]))))
        return predicted + int(self.residuals[rank])


def boundaries(data: bytes) -> np.ndarray:
    """Offsets of all code point boundaries of UTF-8 bytes, the end included."""
    first = np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)
    return np.append(first, len(data))


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """The four numbers that decide over a document; without an id, those of an empty one."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def transform(doc_id: int | None, data: bytes, bound: int = BOUND) -> tuple[bytes, str, int, int | None, int | None]:
    """(output, form, code points, prefix code points, middle code points) of a text in UTF-8."""
    offsets = boundaries(data)
    n = len(offsets) - 1
    first, second, plain, spm = draws(doc_id)
    if not data or any(m in data for m in (PREFIX, SUFFIX, MIDDLE)) or plain % 100 >= PLAIN_FROM:
        return data, "plain", n, None, None
    cuts = sorted((first % (n + 1), second % (n + 1)))
    index = RankIndex.fit(offsets, bound)
    a, b = (index.offset(c) for c in cuts)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if spm % 100 < SPM_BELOW:
        return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)), "spm", n, cuts[0], cuts[1] - cuts[0]
    return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)), "psm", n, cuts[0], cuts[1] - cuts[0]


def restore(output: bytes, form: str) -> bytes:
    """The text that ``transform`` made into ``output``: parts hold no mark, so each mark stands where it first occurs."""
    if form == "plain":
        return output
    opening, between = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, _, rest = output.removeprefix(opening).partition(between)
    other, _, middle = rest.partition(MIDDLE)
    return other + middle + one if form == "spm" else one + middle + other


SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def fill_in_middle(docs: DataFrame, bound: int = BOUND) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output (the transformed text) of every row of ``docs``.

    ``docs`` needs doc_id and text; other columns are ignored.  A null text is empty and stays plain; a row without
    an id is cut by the numbers of an empty id; repeated rows have a result each, equal for equal ids; an empty table
    gives no rows.  Time and memory grow with the length of one text.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [None if pd.isna(i) else int(i) for i in batch["doc_id"]]
            made = [transform(i, (t or "").encode(), bound) for i, t in zip(ids, batch["text"])]
            out = pd.DataFrame(made, columns=["output", "form", "n", "prefix_chars", "middle_chars"])
            out["output"] = [o.decode() for o in out["output"]]
            out = out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})
            yield out.assign(doc_id=pd.array(ids, dtype="Int64"))[["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]]

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(rows, SCHEMA)


def restored_text() -> Column:
    """The text built again from the columns output and form, as :func:`restore` does it; each mark is in an output once."""
    mark = {m: m.decode() for m in (PREFIX, SUFFIX, MIDDLE)}

    def after(text: Column, m: bytes) -> Column:
        return F.substring_index(text, mark[m], -1)

    def before(text: Column, m: bytes) -> Column:
        return F.substring_index(text, mark[m], 1)

    output = F.col("output")
    middle = after(output, MIDDLE)
    psm = F.concat(after(before(output, SUFFIX), PREFIX), middle, before(after(output, SUFFIX), MIDDLE))
    spm = F.concat(before(after(output, PREFIX), MIDDLE), middle, after(before(output, PREFIX), SUFFIX))
    return F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """``fill_in_middle``'s rows with output_sha256 and restored_sha256, of the text built again from the output, for the output.

    Both are Spark expressions: a second Python worker for each task would hold as much memory as the first.
    """
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored_text().cast("binary"), 256).alias("restored_sha256"),
    )
