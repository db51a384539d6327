"""Fingerprints, links and components against plain Python."""

import random
import re

import numpy as np
import pytest
import xxhash

from candela.llm import simhash
from candela.llm.components import components


def plain_fingerprint(text, width=4):
    words = [w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return 0
    runs = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(items, linked):
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in linked(i):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def test_fingerprints(odd_rows):
    for _, text, _ in odd_rows:
        assert simhash.fingerprint(text or "") == plain_fingerprint(text)


def test_segments_cover_the_distance():
    for distance in range(0, 9):
        for parts in range(2, 6):
            cuts = simhash.segments(distance, parts)
            missed = [next((r for a, _, r in cuts if a == 64 * k // parts), -1) + 1 for k in range(parts)]
            assert sum(missed) > distance


@pytest.mark.parametrize("parts,indexed", [(2, 1 << 15), (3, 1 << 15), (3, 8)])
def test_components_equal_brute_force(spark, monkeypatch, parts, indexed):
    monkeypatch.setattr(simhash, "INDEXED", indexed)
    rng = random.Random(parts)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = set(base)
    for _ in range(500):  # one dense ball and some scattered neighbours
        f = base[0] if rng.random() < 0.6 else rng.choice(base)
        for b in rng.sample(range(64), rng.randint(1, 6)):
            f ^= 1 << b
        prints.add(f)
    prints = np.array(sorted(prints), dtype=np.uint64)
    monkeypatch.setattr(simhash, "DENSE", 4)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    signed = prints.view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    roots = {r.node: r.root for r in components(simhash.links(df, parts=parts)).collect()}
    want = classes(prints, lambda i: np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 4))
    got = [roots.get(x, x) for x in signed]
    pairs = {(a, b) for a, b in zip(want, got)}
    assert len(pairs) == len(set(want)) == len(set(got))


def test_near_duplicates_of_odd_rows(odd_docs, odd_rows, no_docs):
    got = {}
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    prints = [plain_fingerprint(t) for _, t, _ in odd_rows]
    want = classes(prints, lambda i: [j for j, p in enumerate(prints) if bin(p ^ prints[i]).count("1") <= 4])
    least = {}
    for (i, _, _), c in zip(odd_rows, want):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in rows)
    assert got == sorted((i or 0, f"{p:016x}", least.get(c)) for (i, _, _), p, c in zip(odd_rows, prints, want))
    assert simhash.near_duplicates(no_docs).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(300)]
    star = [(5000, k) for k in range(4000, 4900)]
    found = components(spark.createDataFrame(path + star + [(7, 7)], "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in found} == {i: 0 for i in range(301)} | {k: 4000 for k in [*range(4000, 4900), 5000]}
    assert len(found) == 301 + 901


def test_similar_documents_are_found_and_confirmed(spark):
    """Near copies of a similarity of 0.8 and more: at least nine of ten are linked, and nothing that is not similar."""
    rng = random.Random(8)
    vocabulary = [f"word{k}" for k in range(9000)]
    rows, pairs = [(0, None), (1, ""), (2, "a b")], []
    while len(pairs) < 320:
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 400))]
        other = list(words)
        if rng.random() < 0.6:
            for _ in range(max(1, int(len(words) * rng.uniform(0.005, 0.025)))):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
        else:  # a block at the end
            other += [rng.choice(vocabulary) for _ in range(int(len(words) * rng.uniform(0.02, 0.35)))]
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words, other))
        s = len(a & b) / len(a | b)
        pairs.append((len(rows), len(rows) + 1, s))
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    assert len(got) == len(rows) and all(got[k] == k for k in (0, 1, 2))
    close = [got[a] == got[b] for a, b, s in pairs if 0.8 <= s < 0.85]
    assert len(close) > 40 and sum(close) >= 0.9 * len(close)
    assert sum(got[a] == got[b] for a, b, s in pairs if s >= 0.8) >= 0.95 * sum(s >= 0.8 for _, _, s in pairs)
    assert not any(got[a] == got[b] for a, b, s in pairs if s < 0.8)


def test_similar_documents_with_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TIED", 3)
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(k, " ".join(w if rng.random() > 0.004 else f"new{k}" for w in base)) for k in range(120)] + [(500 + k, " ".join(f"x{rng.randrange(5000)}" for _ in range(90))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    assert all(got[k] == 0 for k in range(120)) and all(got[500 + k] == 500 + k for k in range(40))


def test_rows_of_a_crowd_are_compared_about_once(spark, monkeypatch):
    """Once a row is tied to its crowd, the other values that it shares with rows of the same component ask for nothing."""
    monkeypatch.setattr(simhash, "TIED", 3)
    asked, verified = [], simhash.shingle_join.verified
    monkeypatch.setattr(simhash.shingle_join, "verified", lambda pairs, *more: asked.append(pairs.count()) or verified(pairs, *more))
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(k, " ".join(w if rng.random() > 0.004 else f"new{k}" for w in base)) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    assert all(got[k] == 0 for k in range(300))
    assert sum(asked) < 2 * len(rows), asked


def test_a_group_less_similar_is_not_listed(spark, monkeypatch):
    """Rows of a group that are alike, but less than asked for, share many values; their sketches keep them apart."""
    asked, verified = [], simhash.shingle_join.verified
    monkeypatch.setattr(simhash.shingle_join, "verified", lambda pairs, *more: asked.append(pairs.count()) or verified(pairs, *more))
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(60)]
    texts = []
    for k in range(150):  # 56 of 80 shingles of a pair are shared
        words = base + [f"own{k}x{j}" for j in range(12)]
        texts.append((k, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id int, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    assert all(got[k] == k for k in range(150))
    assert sum(asked) < len(texts), asked
