"""Quality rules: how far a document's characters and words stand from those of its language.

References are the histograms of the whole corpus by language: shares of character classes, and shares of the
commonest words.  Every document counts for one, however long it is.  A document is compared by Jensen-Shannon distance (base 2, the root of the divergence) with all
of them, so that a wrong language tag does no harm, and the least distance counts.  Short documents have ragged
histograms; below a least length a rule does not speak.  Nor do the distances speak on documents whose own language has
too few documents for a reference.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.llm.frames import SPACE, saved

# fixed values: classes of characters
CLASSES = ["lower", "upper", "other letter", "digit", "space", "mark", "symbol"]
MARKS = ".,;:!?'\"()-"
SYMBOLS = "#*$%&|<>"
#: Weight of a document in a reference; a whole number, so that sums do not depend on their order.
ONE = 10**9
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """Thresholds.  The base rule is: fewer than ``least_words`` words, or over ``most_repeats`` percent repeated."""

    least_words: int = 20
    #: Documents with words that a language needs for a reference, however large other languages are.
    least_documents: int = 20
    most_repeats: int = 30
    common_words: int = 64
    #: Words from which the characters are compared; the greatest distance, plus a part that falls with the root of the words.
    char_words: int = 20
    char_distance: float = 0.15
    char_ragged: float = 1.0
    #: The same for the common words.
    word_words: int = 80
    word_distance: float = 0.27
    word_ragged: float = 1.75

    def odd(self, n_words: int, chars: float, words: float | None) -> bool:
        """Whether the distances are greater than a clean document of this length shows."""
        ragged = max(n_words, 1) ** -0.5
        if n_words >= self.char_words and chars > self.char_distance + self.char_ragged * ragged:
            return True
        return words is not None and words > self.word_distance + self.word_ragged * ragged


def _class_table() -> np.ndarray:
    """Class of each byte; -1 for the later bytes of a character."""
    out = np.full(256, CLASSES.index("symbol"), dtype=np.int64)
    out[0x80:0xC0] = -1
    out[0xC0:] = CLASSES.index("other letter")
    for name, chars in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("digit", "0123456789"), ("space", BLANKS), ("mark", MARKS)):
        out[[ord(c) for c in chars]] = CLASSES.index(name)
    out[ord("A") : ord("Z") + 1] = CLASSES.index("upper")
    return out


_CLASS = _class_table()


def class_counts(data: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(data, dtype=np.uint8)] + 1, minlength=len(CLASSES) + 1)[1:]


def shared_out(counts: np.ndarray) -> np.ndarray:
    """The weight ONE of a document, by its classes; whole numbers."""
    return counts * ONE // counts.sum()


def distances(counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, from 0 to 1, of each row of ``counts`` and the same row of ``shares``."""
    p = counts / counts.sum(axis=-1, keepdims=True)
    m = (p + shares) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(shares > 0, shares * np.log2(shares / m), 0)
    return np.sqrt(np.maximum(parts.sum(axis=-1) / 2, 0))


_FACTORS = {1: 0x5851F42D4C957F2D, 2: 0x14057B7EF767814F, 4: 0x2545F4914F6CDD1D}


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of ``width`` words that occur twice or more: windows are named by doubling, so names are exact."""
    if len(words) <= width:
        return 0
    # equal windows have equal sums, so without equal sums there is nothing to find
    sums = np.fromiter(map(hash, words), dtype=np.int64, count=len(words))
    size = 1
    while size < width:
        sums = sums[:-size] * _FACTORS[size] + sums[size:]
        size *= 2
    sums.sort()
    if not (sums[1:] == sums[:-1]).any():
        return 0
    ids: dict[bytes, int] = {}
    names = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    size = 1
    while size < width:  # width is a power of two
        joined = names[:-size] * (int(names.max()) + 1) + names[size:]
        kinds, names = np.unique(joined, return_inverse=True)
        if len(kinds) == len(joined):
            return 0
        size *= 2
    again = np.flatnonzero(np.bincount(names)[names] > 1)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    edges[again] += 1
    edges[again + width] -= 1
    return int((np.cumsum(edges) > 0).sum())


def features(text: str) -> tuple[int, int, int, int, int, bytes]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the bytes of the text."""
    data = text.encode()
    words = data.split()  # bytes are split at just the white space of the rule
    blanks = sum(map(text.count, BLANKS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)] if "\n" in text else []
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeat_words(words), data


class Reference:
    """Histograms of the corpus by language: shares of the classes, and of the common words and all others."""

    def __init__(self, chars: dict[str, list[int]], words: dict[str, dict[str, int]], totals: dict[str, int]) -> None:
        known = [k for k in sorted(chars) if sum(chars[k]) and totals.get(k)]
        self.chars = np.array([np.array(chars[k]) / sum(chars[k]) for k in known]).reshape(-1, len(CLASSES))
        self.langs = set(known)
        self.width = max((len(words.get(k, ())) for k in known), default=0) + 1
        self.words = np.zeros((len(known), self.width))
        self.places: dict[bytes, list[tuple[int, int]]] = {}
        for row, k in enumerate(known):
            counts = words.get(k, {})
            for place, word in enumerate(sorted(counts)):
                self.words[row, place] = counts[word] / totals[k]
                self.places.setdefault(word.encode(), []).append((row, place))
            self.words[row, -1] = 1 - self.words[row, :-1].sum()

    def char_distance(self, counts: np.ndarray) -> float:
        return float(distances(counts, self.chars).min()) if len(self.chars) else 0.0

    def word_distance(self, data: bytes) -> float:
        """Of the words of a text with at least one word."""
        if not len(self.words):
            return 0.0
        words = data.lower().split()
        found = Counter(words)
        counts = np.zeros(self.words.shape)
        for word in self.places.keys() & found.keys():
            for at in self.places[word]:
                counts[at] = found[word]
        counts[:, -1] = len(words) - counts.sum(axis=1)
        return float(distances(counts, self.words).min())


def _language(docs: DataFrame) -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")


def reference(docs: DataFrame, rules: Rules = Rules()) -> Reference:
    """Histograms over all documents, each with the whole weight ONE.  Only the class sums and the commonest words of
    each language reach the driver."""
    rows = docs.select(_language(docs).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))

    def classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                counts = class_counts(text.encode())
                if counts.sum():
                    sums[lang] = sums.get(lang, 0) + shared_out(counts)
        yield pd.DataFrame([(k, c, int(v)) for k, x in sums.items() for c, v in enumerate(x)], columns=["lang", "class", "n"])

    by_class = rows.mapInPandas(classes, "lang string, class int, n bigint").groupBy("lang", "class").agg(F.sum("n").alias("n"))
    split = rows.select("lang", F.array_remove(F.split("text", SPACE), "").alias("words"))
    weighted = split.select("lang", F.expr(f"{ONE} div nullif(size(words), 0)").alias("weight"), F.explode("words").alias("word"))
    # letters A to Z only, as the documents are counted
    word = F.translate("word", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = weighted.groupBy("lang", word.alias("word")).agg(F.sum("weight").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    best = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rules.common_words)
    sizes = saved(split.where("size(words) > 0").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rules.least_documents), "languages")
    totals = {r["lang"]: r["n"] * ONE for r in sizes.collect()}
    chars: dict[str, list[int]] = {}
    for r in by_class.join(sizes.select("lang"), "lang", "left_semi").collect():
        chars.setdefault(r["lang"], [0] * len(CLASSES))[r["class"]] = r["n"]
    common: dict[str, dict[str, int]] = {}
    for r in best.join(sizes.select("lang"), "lang", "left_semi").select("lang", "word", "n").collect():
        common.setdefault(r["lang"], {})[r["word"]] = r["n"]
    return Reference(chars, common, totals)


SCORES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "kept boolean, char_distance double, word_distance double"
)


def judged(docs: DataFrame, known: Reference, rules: Rules = Rules()) -> DataFrame:
    """Each row of ``docs`` as the struct ``row``, and its SCORES as the struct ``quality``; no shuffle, and no name
    of ``docs`` can clash."""

    @F.pandas_udf(SCORES)
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, lang in zip(*batch):
                n, chars, symbols, lines, repeats, data = features(text or "")
                failed = n < rules.least_words or 100 * repeats > rules.most_repeats * n
                own = lang in known.langs
                c = known.char_distance(class_counts(data)) if n and own else None
                w = known.word_distance(data) if n >= rules.word_words and own else None
                out.append((n, chars, symbols, lines, repeats, failed, not failed and not (own and rules.odd(n, c, w)), c, w))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SCORES.split(", ")])

    return docs.select(F.struct(*docs.columns).alias("row"), judge("text", _language(docs)).alias("quality"))


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row for each document: doc_id, counts, base verdict, verdict, distances (null below the least length, and where
    the document's language has no reference).

    A null text has no words and fails the base rule.  Repeated rows are judged each for itself.  An empty table
    gives no rows.
    """
    return judged(docs.select("doc_id", "text", _language(docs).alias("lang")), reference(docs, rules), rules).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), "quality.*"
    )
