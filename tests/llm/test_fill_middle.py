"""Fill in the middle: the rank index against all boundaries, the forms against plain slices, and exact restoring."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from candela.llm import fill_middle as fim


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return text, "plain", n, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}", "spm", n, a, b - a
    return f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", "psm", n, a, b - a


MIXED = ["", "a", "é", "日本", "plain ascii words " * 400, "ü" * 3000 + "a" * 3000, "a𝄞é漢" * 900, "x" * 70_000 + "漢" * 70_000, "<", "<<S", "a<P>b", "<M>"]


@pytest.mark.parametrize("text", MIXED)
@pytest.mark.parametrize("bound", [1, 4, 32, 500])
def test_index_gives_every_boundary(text, bound):
    offsets = fim.boundaries(text.encode())
    assert len(offsets) == len(text) + 1
    index = fim.RankIndex.fit(offsets, bound)
    assert np.abs(index.residuals.astype(int)).max() <= bound
    ranks = range(len(offsets)) if len(offsets) < 4000 else range(0, len(offsets), 97)
    assert all(index.offset(r) == offsets[r] for r in ranks)


def test_segments_are_few():
    text = ("Größe und Maß, " * 20_000).encode()
    index = fim.RankIndex.fit(fim.boundaries(text))
    assert len(index.starts) < 20 and index.residuals.dtype == np.int8


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2000), st.text(alphabet=st.sampled_from("a<PSM>é漢𝄞 \n"), max_size=60))
def test_forms_and_restoring(doc_id, text):
    output, form, n, prefix, middle = fim.transform(doc_id, text.encode(), 2)
    assert (output.decode(), form, n, prefix, middle) == brute(doc_id, text)
    assert fim.restore(output, form) == text.encode()


def test_rows(spark):
    texts = [None, "", " ", *MIXED, "repeated", "repeated"]
    rows = [(i if i % 7 else None, t, "x") for i, t in enumerate(texts * 6, 1)] + [(5, "repeated", "x"), (5, "repeated", "x")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, form string").repartition(3)
    got = fim.digests(fim.fill_in_middle(docs)).collect()

    def digest(t):
        return hashlib.sha256(t.encode()).hexdigest()

    want = []
    for i, t, _ in rows:
        output, form, n, prefix, middle = brute(i, t)
        want.append((i, n, form, prefix, middle, digest(output), digest(t or "")))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.where(F.lit(False))).count() == 0


def test_restoring_in_spark_and_one_python_worker_a_task(spark):
    texts = ["", "<", "<<S", "S>", "ab<P", "é<M漢", "P>x<S", "\x00<\n", "a𝄞é漢" * 50]
    made = [(*fim.transform(i, t.encode())[:2], t) for i in range(40) for t in texts]
    rows = spark.createDataFrame([(o.decode(), f, t) for o, f, t in made], "output string, form string, text string")
    assert rows.where(fim.restored_text() != F.col("text")).count() == 0
    assert {f for _, f, _ in made} == {"plain", "psm", "spm"}
    docs = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    plan = fim.digests(fim.fill_in_middle(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "ArrowEvalPython" not in plan
