"""The Jaccard join against comparing all pairs, for each boundary between the two ways and with dense keys."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.llm import shingle_join as sj


def shingle_set(text, width=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def brute(rows, percent=85, width=4):
    """(doc_id, size, component) with components by relaxation over all pairs."""
    sets = [shingle_set(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            r = root(k)
            least[r] = min(least.get(r, doc_id), doc_id)
    return sorted((str(i), len(sets[k]), str(least.get(root(k)) if sets[k] else i)) for k, (i, _) in enumerate(rows))


def corpus(seed, n, families=6):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    passage = [draw.choice(vocabulary) for _ in range(40)]
    bases = [[draw.choice(vocabulary) for _ in range(draw.choice((9, 12, 17, 24, 60, 150, 400)))] for _ in range(families)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "ONE two"), (4, "one\x0bTwo"), (5, "a b c"), (6, "a b c d"), (7, "a b c d"), (None, "a b c d"), (None, "alone in the world here")]
    for k in range(10, n):
        kind = draw.random()
        if kind < 0.55:
            words = list(draw.choice(bases))
            for _ in range(draw.randrange(4)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            if draw.random() < 0.3:
                words += [draw.choice(vocabulary) for _ in range(draw.randrange(4))]
        elif kind < 0.75:
            words = passage + [draw.choice(vocabulary) for _ in range(draw.randrange(12))]
        else:
            words = [draw.choice(vocabulary) for _ in range(draw.randrange(1, 60))]
        rows.append((k, " ".join(words)))
    draw.shuffle(rows)
    return rows


def result(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id int, text string, size int").repartition(4)
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in sj.similar_documents(docs, **options).collect())


@pytest.mark.parametrize("boundary", [None, 20])
def test_components_equal_all_pairs(spark, boundary):
    rows = corpus(3, 400)
    assert result(spark, rows, most_small=boundary) == brute(rows)


def test_dense_keys_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(sj, "DENSE", 3)
    monkeypatch.setattr(sj, "BLOCK", 5)
    rows = corpus(5, 300, families=2)
    assert result(spark, rows, most_small=20) == brute(rows)
    monkeypatch.setattr(sj, "ROUNDS", 0)
    assert result(spark, rows, most_small=128) == brute(rows)


def test_other_similarity_and_width(spark):
    rows = corpus(9, 250)
    assert result(spark, rows, percent=70, width=5) == brute(rows, 70, 5)
    with pytest.raises(ValueError):
        sj.similar_documents(spark.createDataFrame([(1, "a")], "doc_id int, text string"), percent=50)


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id int, text string").where(F.lit(False))
    assert sj.similar_documents(docs).collect() == []


def test_prefixes_and_sketches_never_lose_a_pair():
    draw = np.random.default_rng(0)
    for _ in range(2000):
        n = int(draw.integers(6, 400))
        a = np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64))
        gone, new = draw.integers(0, max(1, n // 8), 2)
        b = np.unique(np.concatenate([a[int(gone) :], draw.integers(0, 1 << 63, int(new)).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common < 85 * (len(a) + len(b) - common) or common == len(a) == len(b):
            continue
        for k in (1, 2):
            pa, pb = (s[: len(s) - sj.least_common(len(s)) + k] for s in (a, b))
            assert len(np.intersect1d(pa, pb)) >= k
        x, y = sorted((sj.parity(a), sj.parity(b)), key=len)
        if len(y) > len(x):
            y = y[: len(x)] ^ y[len(x) :]
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len(a) + len(b) - 2 * common


def test_a_group_less_similar_is_not_listed(spark, monkeypatch):
    """Small sets that are alike, but less than asked for, are kept apart by their sketches, not by their texts."""
    asked, verified = [], sj.verified
    monkeypatch.setattr(sj, "verified", lambda pairs, *more: asked.append(pairs.count()) or verified(pairs, *more))
    draw = random.Random(4)
    base = [f"w{draw.randrange(5000)}" for _ in range(43)]  # 40 of 48 shingles of a pair are shared
    rows = [(k, " ".join([*base, *(f"own{k}x{j}" for j in range(4))])) for k in range(120)]
    assert result(spark, rows, most_small=128) == brute(rows)
    assert sum(asked) < 1000, asked


def test_a_crowd_of_links_is_not_listed(spark, monkeypatch):
    """Near copies about as similar as asked for: what a forest of the closest pairs has joined is not paired again."""
    monkeypatch.setattr(sj, "ROUNDS", 0)  # no pivots before
    asked, verified = [], sj.verified
    monkeypatch.setattr(sj, "verified", lambda pairs, *more: asked.append(pairs.count()) or verified(pairs, *more))
    draw = random.Random(8)
    base = [f"w{k}" for k in range(63)]  # two copies share 52 shingles and have 4 to 16 besides
    rows = [(k, " ".join([*base[: 60 - draw.randrange(5)], *(f"own{k}x{j}" for j in range(draw.randrange(1, 6)))])) for k in range(150)]
    assert result(spark, rows, most_small=128) == brute(rows)
    assert sum(asked) < 600, asked
