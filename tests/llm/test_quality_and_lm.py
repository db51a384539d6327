"""Quality rules against plain Python, and the language model on held-out documents."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from candela.llm import masked_lm, quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), failed


def english(rng, n):
    common = "the of and to a in is that it was for on are as with his they at be this".split()
    return [rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 9))) for _ in range(n)]


def test_counts(odd_rows):
    rng = random.Random(1)
    texts = [t for _, t, _ in odd_rows] + [" ".join(rng.choice("abc") for _ in range(n)) for n in (7, 8, 9, 16, 40, 300)]
    texts += ["a b c d e f g h " * 2, "line one here\nline one here\n \n\n \nother", "x" * 10_000, "a\x0bb\x0cc\x85d e"]
    for text in texts:
        assert (*quality.features(text or "")[:5], plain(text)[5]) == plain(text)


def test_distance_is_a_distance():
    p, q = np.array([1, 2, 3.0]), np.array([[1, 2, 3], [0, 0, 6]]) / 6
    a, b = quality.distances(np.array([p, p]), q)
    assert a == 0 and 0 < b < 1 and quality.distances(np.array([[1.0, 0]]), np.array([[0.0, 1]]))[0] == 1


def test_odd_texts_are_rejected_and_clean_ones_kept(spark, odd_docs, odd_rows, no_docs):
    rng = random.Random(2)
    clean = [(100 + k, " ".join(english(rng, rng.randint(30, 400))), "en") for k in range(300)]
    junk = [
        (500, " ".join(w + "###" for w in english(rng, 200)), "en"), (501, " ".join(english(rng, 200)).upper(), "en"),
        (502, " | ".join(w + "zz" for w in english(rng, 200)), "en"),
    ]
    docs = odd_docs.unionByName(spark.createDataFrame(clean + junk, "doc_id bigint, text string, lang string"), allowMissingColumns=True)
    rows = quality.quality_rules(docs).collect()
    texts = odd_rows + clean + junk
    want = Counter((i, *plain(t)) for i, t, _ in texts)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert not any(r.kept for r in rows if r.base_failed)
    kept = {r.doc_id for r in rows if r.kept}
    assert {i for i, _, _ in clean} <= kept and not kept & {500, 501, 502}
    assert quality.quality_rules(no_docs).count() == 0


def test_language_model_beats_unigrams_on_held_out_documents(spark):
    rng = random.Random(3)

    def text():
        return " ".join(f"{w} {w}s" for w in (rng.choice(["cat", "dog", "bird", "fish", "cow", "hen"]) for _ in range(rng.randint(50, 150))))

    rows = [(i, text()) for i in range(300)]
    shape = masked_lm.Shape(frequent=24, buckets=8, classes=4, batch=256, rate=0.3)
    words, network = masked_lm.train(spark.createDataFrame(rows[:200], "doc_id bigint, text string").repartition(3), shape)
    held = spark.createDataFrame(rows[200:], "doc_id bigint, text string")
    got = {r.doc_id: r for r in masked_lm.score(held, words, network).collect()}
    ids = {i: words.of(t) for i, t in rows}
    counts = np.bincount(np.concatenate([ids[i] for i in range(200)]), minlength=shape.ids) + 1.0
    logs = np.log(counts / counts.sum())
    unigram = sum(logs[ids[i]].sum() for i in range(200, 300))
    assert sum(r.log_likelihood for r in got.values()) > 0.75 * unigram  # logs are negative
    shuffled = sum(masked_lm.log_likelihood(np.random.default_rng(i).permutation(ids[i]), network) for i in range(200, 300))
    assert shuffled < sum(r.log_likelihood for r in got.values())
    for i in range(200, 220):
        around, at = masked_lm.windows([ids[i]], shape)
        brute = sum(float(network.forward(around[:, [k]], at[[k]])[0][0]) for k in range(len(at)))
        assert abs(brute - got[i].log_likelihood) < 1e-3 and got[i].n_words == len(ids[i])


def test_probabilities_add_up_and_slopes_are_right():
    shape = masked_lm.Shape(frequent=12, buckets=4, classes=4, width=3)
    network = masked_lm.Network(shape, np.random.default_rng(1).normal(0, 0.5, len(masked_lm.Network(shape).flat)).astype(np.float32))
    around = np.array([[1], [2], [3], [16]])
    total = sum(np.exp(network.forward(around, np.array([w]))[0][0]) for w in range(shape.ids))
    assert abs(total - 1) < 1e-5
    # a step of the training goes down the numerical slope
    around, words = np.random.default_rng(2).integers(0, 17, (4, 50)), np.random.default_rng(3).integers(0, 16, 50)
    moved, squares = masked_lm.Network(shape, network.flat.copy()), network.like()
    moved.train(around, words, squares)
    slope = np.sign(network.flat - moved.flat) * np.sqrt(squares.flat)
    for k in range(0, len(network.flat), 11):
        up, down = (masked_lm.Network(shape, network.flat.copy()) for _ in range(2))
        up.flat[k] += 1e-2
        down.flat[k] -= 1e-2
        numeric = (down.forward(around, words)[0].mean() - up.forward(around, words)[0].mean()) / 2e-2
        assert abs(numeric - slope[k]) < 2e-3


def test_language_model_on_odd_rows(odd_docs, odd_rows, no_docs):
    shape = masked_lm.Shape(frequent=24, buckets=8, classes=4, batch=1024)
    rows = masked_lm.pseudo_likelihood(odd_docs, shape).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert (r.mean_log_likelihood is None) == (r.n_words == 0) and (r.n_words > 0 or r.log_likelihood == 0)
    assert Counter((r.doc_id, r.n_words) for r in rows) == Counter((i, len((t or "").encode().split())) for i, t, _ in odd_rows)
    assert masked_lm.pseudo_likelihood(no_docs, shape).count() == 0


def test_rare_words_of_one_bucket_are_scored_for_themselves(spark, monkeypatch):
    """By the join and by the tasks alike: two words of a bucket differ by the log of their counts, and an unseen one is last."""
    shape = masked_lm.Shape(frequent=3, buckets=1, classes=2, batch=64)
    rows = [(k, "a b c a b c a b c often often often often seldom") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    held = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b seldom"), (3, "a b never"), (None, "a b seldom")], "doc_id bigint, text string")
    results = []
    for share in (1 << 19, 2):
        monkeypatch.setattr(masked_lm, "HEAD_SHARE", share)
        words, network = masked_lm.train(docs, shape)
        got = masked_lm.score(held, words, network).collect()
        assert sorted((r.doc_id or 0, r.n_words) for r in got) == [(0, 3), (1, 3), (1, 3), (2, 3), (3, 3)]
        results.append({r.doc_id or 0: r.log_likelihood for r in got})
        at = results[-1]
        if share > 2:
            assert abs(at[1] - at[2] - np.log(61 / 21)) < 1e-4 and abs(at[2] - at[3] - np.log(21)) < 1e-4 and at[0] == at[2]
            assert abs(words.shares[words[b"c"]] - np.log(61 / (60 + 20 + 2 + 1))) < 1e-9
    assert len(words) < 3 and masked_lm.Shape.sized(1000) == masked_lm.Shape()
    assert masked_lm.Shape.sized(10**8).ids > 4 * masked_lm.Shape().ids


def test_the_join_of_rare_words_gives_what_the_tasks_give(spark):
    shape = masked_lm.Shape(frequent=3, buckets=1, classes=2, batch=64)
    docs = spark.createDataFrame([(k, f"a b c a b c w{k % 5} Word{k}") for k in range(30)], "doc_id bigint, text string")
    words, network = masked_lm.train(docs, shape)
    want = {r.doc_id: r.log_likelihood for r in masked_lm.score(docs, words, network).collect()}
    few = [(w.decode(), 30) for w, k in words.items() if k < 3]
    totals = {0: 30 + 5 + 30 + 30}
    joined = masked_lm.Words(few, totals, words.table, shape)
    got = {r.doc_id: r.log_likelihood for r in masked_lm.score(docs, joined, network).collect()}
    assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-4 for k in want)


def test_small_languages_are_not_judged_by_others(spark):
    """A language far below the largest has its own reference; one of a few documents is only judged by the base rule."""
    rng = random.Random(4)

    def other(n):
        return [rng.choice("\u043d\u0430 \u0438 \u0441\u0435 \u0434\u0430 \u0433\u043e \u0442\u043e \u043e\u0434".split()) + rng.choice("\u0431\u0432\u0433\u0434\u0436\u0437\u043a\u043b\u043c") * rng.randint(0, 3) for _ in range(n)]

    rows = [(k, " ".join(english(rng, 4000)), "en") for k in range(60)]
    small = [(100 + k, " ".join(other(90)), "mk") for k in range(25)] + [(200, " ".join(other(90)), "xx")]
    got = quality.quality_rules(spark.createDataFrame(rows + small, "doc_id bigint, text string, lang string")).collect()
    assert len(got) == 86 and all(r.kept for r in got)
    assert all((r.char_distance is None) == (r.word_distance is None) == (r.doc_id == 200) for r in got)


def test_long_documents_do_not_outweigh_short_ones_in_the_classes(spark):
    rows = [(k, "abcdefghij " * 10, "en") for k in range(30)] + [(99, "#" * 200_000, "en")]
    known = quality.reference(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert abs(known.chars[0][quality.CLASSES.index("symbol")] - 1 / 31) < 1e-6


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    """One and six partitions, several shards: the same scores."""
    monkeypatch.setattr(masked_lm, "SHARD_WORDS", 1500)
    monkeypatch.setattr(masked_lm, "FAN_IN", 2)
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["red", "blue", "green", "sky", "sea", f"w{rng.randrange(300)}"]) for _ in range(rng.randrange(80)))) for k in range(200)]
    shape = masked_lm.Shape(frequent=24, buckets=8, classes=4, batch=256, rate=0.3)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    one, six = ({r.doc_id: r.log_likelihood for r in masked_lm.pseudo_likelihood(docs.repartition(n), shape).collect()} for n in (1, 6))
    assert len(one) == 200 and all(abs(one[k] - six[k]) < 1e-3 * max(1, abs(one[k])) for k in one)
