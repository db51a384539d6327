"""Runs of repeated word sequences in a text, by a suffix automaton and link-cut access.

The states of a suffix automaton, under their suffix links, are a tree in which the path from the state of a prefix to
the root holds all suffixes of that prefix.  Words are taken one after another; taking the word at ``i`` gives the whole
path of its prefix the colour ``i``, so that a state's colour is the end of its last occurrence.  Before, the path is
made of segments of one older colour each.  A segment of colour ``e`` whose deepest state has length ``l`` says that
``l`` is the longest common suffix of the prefixes ending at ``e`` and at ``i``: the stretch of ``l + i - e`` words that
ends at ``i`` has the period ``i - e`` and cannot begin earlier.  If ``l`` is at least the period, the stretch ends in a
square, and as no later occurrence is nearer, the period is its smallest.  Followed over ``i``, it grows into the run.

Link-cut trees keep each segment in a splay tree; an access cuts and joins as many of them as the path has colours,
which are logarithmically many on average.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run has this many words, and periods, at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4

Run = tuple[int, int, int]  # start, length, period


def suffix_links(words: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix automaton of ``words``: link and length of each state, and the state of each prefix.  State 0 is the root."""
    link, length, steps = [-1], [0], [{}]
    ends, last = [], 0
    for i, w in enumerate(words):
        state = len(link)
        link.append(0)
        length.append(i + 1)
        steps.append({})
        at = last
        while at >= 0 and w not in steps[at]:
            steps[at][w] = state
            at = link[at]
        if at >= 0:
            to = steps[at][w]
            if length[to] == length[at] + 1:
                link[state] = to
            else:
                copy = len(link)
                link.append(link[to])
                length.append(length[at] + 1)
                steps.append(dict(steps[to]))
                while at >= 0 and steps[at].get(w) == to:
                    steps[at][w] = copy
                    at = link[at]
                link[to] = link[state] = copy
        last = state
        ends.append(state)
    return link, length, ends


def squares(words: Sequence[int], least_periods: int = 2) -> Iterator[tuple[int, int, int]]:
    """(end, start, period) for each word and each stretch of ``least_periods`` smallest periods or more that ends there and cannot begin earlier.

    ``up`` is a state's parent in the splay tree of its segment or, at the root of one, the state above the segment.
    ``less`` leads to states nearer to the root of the tree, ``more`` to deeper ones.  A segment's colour is kept at
    the root of its splay tree.
    """
    up, length, ends = suffix_links(words)
    less, more, colour = [-1] * len(up), [-1] * len(up), [-1] * len(up)

    def lift(x: int, y: int) -> int:
        """``x`` takes the place of its parent ``y``; returns the new parent of ``x``."""
        z = up[y]
        if less[y] == x:
            inner = less[y] = more[x]
            more[x] = y
        else:
            inner = more[y] = less[x]
            less[x] = y
        if inner >= 0:
            up[inner] = y
        up[y], up[x] = x, z
        if z >= 0 and less[z] == y:
            less[z] = x
        elif z >= 0 and more[z] == y:
            more[z] = x
        else:
            colour[x] = colour[y]
        return z

    times = least_periods - 1
    for i, x in enumerate(ends):
        deeper = -1
        while x >= 0:
            y = up[x]
            while y >= 0 and (less[y] == x or more[y] == x):
                z = up[y]
                if z >= 0 and (less[z] == y or more[z] == y):
                    lift(*((y, z) if (less[y] == x) == (less[z] == y) else (x, y)))
                    y = up[x]
                y = lift(x, y)
            old = colour[x]
            if old >= 0 and length[x] >= times * (i - old):
                yield i, i - length[x] - (i - old) + 1, i - old
            if more[x] >= 0:
                colour[more[x]] = old
            more[x] = deeper
            deeper, x = x, y
        colour[deeper] = i


def stretches(ids: np.ndarray, least_words: int, least_periods: int) -> Iterator[tuple[int, int]]:
    """(first, end) of all maximal stretches of words that can hold runs: every pair of neighbours in a run of so many
    periods occurs once less than that in it, at least, so rarer pairs part the runs."""
    if len(ids) < least_words:
        return
    pairs = ids[:-1].astype(np.int64) * (int(ids.max()) + 1) + ids[1:]
    _, which, counts = np.unique(pairs, return_inverse=True, return_counts=True)
    marks = np.concatenate([[0], (counts >= least_periods - 1)[which].astype(np.int8), [0]])
    change = np.flatnonzero(np.diff(marks))
    for first, end in zip(change[::2].tolist(), change[1::2].tolist()):
        if end + 1 - first >= least_words:
            yield first, end + 1


def runs(words: Sequence, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[Run]:
    """(start, length, period) of all runs by start, then period: stretches of ``least_words`` words and
    ``least_periods`` (2 or more) smallest periods at least that no neighbour extends."""
    if len(words) < least_words:
        return []
    names: dict = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words])
    out: list[Run] = []
    for first, end in stretches(ids, least_words, least_periods):
        last: dict[tuple[int, int], int] = {}
        for i, start, period in squares(ids[first:end].tolist(), least_periods):
            last[start, period] = i
        out += [(first + s, i - s + 1, p) for (s, p), i in last.items() if i - s + 1 >= least_words]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: Sequence, found: Sequence[Run]) -> list:
    """The words outside of runs and in the first period of them, whatever other run they are in after its first period."""
    if not found:
        return list(words)
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return [words[k] for k in np.flatnonzero(keep).tolist()]


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words as the query of this operator wants them: in one of ten documents, by its id, a tail repeats its beginning."""
    h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (1 + (n - a) // p))[: n - a]


SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def periodic_runs(
    docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS,
    change: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed (the kept words, joined by one space) of every row.

    ``docs`` needs doc_id and text; other columns are ignored.  ``change`` may replace the words of a text first.  A null
    text has no words and no runs; a null id is kept; repeated rows have a result each; an empty table gives no rows.
    The work is one document's at a time, in time n log n of its words and memory in proportion to its longest stretch.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text in zip(batch["doc_id"], batch["text"]):
                i = None if pd.isna(i) else int(i)
                words = (text or "").encode().split()  # bytes are split at space and tab to carriage return only
                words = change(i, words) if change else words
                found = runs(words, least_words, least_periods)
                out.append((i, len(words), [dict(zip(("start", "length", "period"), r)) for r in found], b" ".join(collapsed(words, found)).decode()))
            made = pd.DataFrame(out, columns=["doc_id", "n_words", "runs", "collapsed"])
            yield made.assign(doc_id=made["doc_id"].astype("Int64"))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(rows, SCHEMA)


def _steeper(x: Column, y: Column) -> Column:
    """Order of runs: exact exponent, falling; then start; then period."""
    rise = y["length"] * x["period"] - x["length"] * y["period"]
    step = F.when(rise != 0, rise).when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"])
    return F.signum(step).cast("int")


def digests(made: DataFrame) -> DataFrame:
    """The number of runs, the steepest one, and digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = F.get(F.array_sort("runs", _steeper), F.lit(0))
    return made.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
