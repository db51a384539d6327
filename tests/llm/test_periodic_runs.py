"""Runs against trying every period of every stretch, and rows against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from candela.llm import periodic_runs as pr


def brute(words, least_words=6, least_periods=4):
    """For each period, maximal stretches of words equal to the one a period before; kept where no divisor is a period."""
    n, out = len(words), []
    for q in range(1, n // least_periods + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            smaller = any(all(words[k] == words[k - d] for k in range(start + d, j)) for d in range(1, q))
            if length >= max(least_words, least_periods * q) and not smaller:
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([(6, 4), (2, 2), (5, 3)]))
def test_runs_of_small_alphabets(words, least):
    assert pr.runs(words, *least) == brute(words, *least)


@pytest.mark.parametrize("seed", range(30))
def test_runs_of_built_texts(seed):
    draw = random.Random(seed)
    words = []
    while len(words) < 300:
        unit = [draw.randrange(6) for _ in range(draw.randrange(1, 12))]
        words += (unit * draw.randrange(1, 8))[: draw.randrange(1, 60)] + [draw.randrange(40) for _ in range(draw.randrange(5))]
    assert pr.runs(words) == brute(words)
    assert pr.runs(words, 2, 2) == brute(words, 2, 2)


def test_nested_and_long_runs():
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    assert pr.runs(fib[-1], 2, 2) == brute(fib[-1], 2, 2)
    inner = ("aaaaaab" * 5) + "c"
    assert pr.runs(inner * 4) == brute(inner * 4)
    assert pr.runs("x" * 200_000) == [(0, 200_000, 1)]
    assert pr.runs(list(range(1000)) * 40) == [(0, 40_000, 1000)]
    assert pr.runs("") == [] and pr.runs("aaaaa") == [] and pr.runs("aaaaaa") == [(0, 6, 1)]


def expected(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    def digest(x):
        return hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, digest("".join(f"{s},{length},{q}\n" for s, length, q in found)),
        digest(" ".join(w for k, w in enumerate(words) if k not in gone)),
    )


def test_rows(spark):
    draw = random.Random(1)
    texts = [None, "", " \t\r", "one", "a " * 50, "a b\x0bc\n" * 9 + "q r s t u v " * 6, "é x " * 7]
    texts += [" ".join(draw.choice("abcdefgh") for _ in range(draw.randrange(80))) for _ in range(120)]
    rows = [(k if k % 9 else None, t, 0) for k, t in enumerate(texts, 1)] + [(3, "a " * 9, 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_runs int").repartition(4)
    got = pr.digests(pr.periodic_runs(docs, change=pr.repeated_tail)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(expected(i, t)) for i, t, _ in rows)
    assert any(r["n_runs"] > 1 for r in got)
    assert pr.digests(pr.periodic_runs(docs.where(F.lit(False)))).count() == 0
    plain = {r["doc_id"]: r for r in pr.periodic_runs(docs).collect()}
    assert plain[5]["collapsed"] == "a" and plain[5]["runs"][0].asDict() == {"start": 0, "length": 50, "period": 1}
