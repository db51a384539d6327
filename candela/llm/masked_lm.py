"""Document scores by masked pseudo-likelihood.

A window network sees the words on both sides of a place, but not the word itself, and predicts it: embeddings of
the neighbours, one for each offset, are added and squashed, and two softmax layers give the word's class and its
place in the class.  A word without an id of its own is predicted by its bucket, and by its share of the bucket in the
counts of all words of the corpus.  The sum of the log-probabilities of all words is the document's
pseudo-log-likelihood.

The network is trained in numpy inside Spark tasks: in each round every shard of the documents starts from the same
weights and is gone over once, and the weights are averaged by the words seen.  All documents take part, each in one
round; a hash decides on round, shard and order.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.functions.durable import scratch_path
from candela.llm.frames import SPACE, saved

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(range(256)).translate(bytes.maketrans(_UPPER.encode(), _LOWER.encode()))


@dataclass(frozen=True)
class Shape:
    """Sizes of the network; by default ``sized`` takes them from the number of different words."""

    frequent: int = 768  # words with an id of their own
    buckets: int = 256  # ids shared by all other words
    classes: int = 32
    width: int = 16
    offsets: tuple[int, ...] = (-2, -1, 1, 2)
    rounds: int = 2
    batch: int = 8192
    rate: float = 0.1

    @staticmethod
    def sized(different: int) -> Shape:
        """Sizes for a corpus of so many different words: ids grow with their root, classes with the root of the ids."""
        frequent = max(Shape.frequent, math.isqrt(different) // 2)
        least = frequent + frequent * Shape.buckets // Shape.frequent
        classes = max(Shape.classes, 1 << least.bit_length() // 2)
        return Shape(frequent=frequent, buckets=-(-least // classes) * classes - frequent, classes=classes)

    @property
    def ids(self) -> int:
        return self.frequent + self.buckets

    @property
    def inside(self) -> int:
        return self.ids // self.classes


#: Words with at least one in so many of all words are looked up in the tasks, the others by a join.
HEAD_SHARE = 1 << 19


class Words(dict):
    """Word to place.  The places of the commonest words come first, then one for each bucket of all other words.

    ``ids`` has the network's id of each place.  ``shares`` has the log of the word's share of its bucket, or of a
    word of the bucket that was never seen; a word counts once more than it was seen.  ``table`` is the folder of
    (word, n) of all words of the corpus, ``total`` their number.
    """

    def __init__(self, common: Sequence[tuple[str, int]], totals: dict[int, int], table: str, shape: Shape, total: int = 0) -> None:
        """``common``: the commonest words and their counts, in order; ``totals``: words and different words of each
        bucket, added up."""
        super().__init__((w.encode(), k) for k, (w, _) in enumerate(common))
        self.shape, self.table, self.known, self.total = shape, table, len(common), total
        own = min(shape.frequent, len(common))
        rest = [zlib.crc32(w.encode()) % shape.buckets for w, _ in common[own:]]
        unseen = -np.log([totals.get(b, 0) + 1.0 for b in range(shape.buckets)])
        self.ids = np.concatenate([np.arange(own), shape.frequent + np.array(rest, np.intp), np.arange(shape.frequent, shape.ids)]).astype(np.intp)
        self.shares = np.concatenate([np.zeros(own), np.log([n + 1.0 for _, n in common[own:]]) + unseen[np.array(rest, np.intp)], unseen])

    def __missing__(self, word: bytes) -> int:
        return self.known + zlib.crc32(word) % self.shape.buckets

    def of(self, text: str) -> np.ndarray:
        """Ids of all words."""
        return self.ids[self.places(text)[1]]

    def places(self, text: str) -> tuple[list[bytes], np.ndarray]:
        words = text.encode().translate(_FOLD).split()
        return words, np.fromiter(map(self.__getitem__, words), dtype=np.intp, count=len(words))


class Network:
    """Weights as one flat vector, and views of its parts."""

    def __init__(self, shape: Shape, flat: np.ndarray | None = None) -> None:
        self.shape = s = shape
        parts = {
            "embed": (len(s.offsets), s.width, s.ids + 1), "bias": (s.width, 1), "to_class": (s.classes, s.width), "class_bias": (s.classes, 1),
            "to_inside": (s.inside, s.width), "inside_bias": (s.inside, s.classes),
        }
        size = sum(int(np.prod(x)) for x in parts.values())
        if flat is None:
            flat = np.random.default_rng(7).normal(0, 0.1, size).astype(np.float32)
        self.flat, at = flat, 0
        for name, dims in parts.items():
            n = int(np.prod(dims))
            setattr(self, name, flat[at : at + n].reshape(dims))
            at += n
        if at != len(flat):
            raise ValueError("weights of another shape")

    def like(self) -> Network:
        return Network(self.shape, np.zeros_like(self.flat))

    def forward(self, around: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
        """Log-probabilities of ``words`` given the ids ``around`` them (offsets by places), and what training needs."""
        hidden = self.embed[0].take(around[0], axis=1)
        for k in range(1, len(around)):
            hidden += self.embed[k].take(around[k], axis=1)
        hidden += self.bias
        np.tanh(hidden, out=hidden)
        of_class, inside = np.divmod(words, self.shape.inside)
        places = np.arange(len(words))
        log_c = _log_softmax(self.to_class @ hidden + self.class_bias)
        log_i = _log_softmax(self.to_inside @ hidden + self.inside_bias.take(of_class, axis=1))
        return log_c[of_class, places] + log_i[inside, places], hidden, log_c, log_i, of_class, inside

    def train(self, around: np.ndarray, words: np.ndarray, squares: Network) -> None:
        """One step of gradient descent with a rate for each weight."""
        s, n = self.shape, len(words)
        _, hidden, log_c, log_i, of_class, inside = self.forward(around, words)
        places = np.arange(n)
        d_class, d_inside = np.exp(log_c, out=log_c), np.exp(log_i, out=log_i)
        d_class[of_class, places] -= 1
        d_inside[inside, places] -= 1
        slope = self.like()
        slope.to_class[:] = d_class @ hidden.T
        slope.class_bias[:, 0] = d_class.sum(axis=1)
        slope.to_inside[:] = d_inside @ hidden.T
        marks = np.zeros((n, s.classes), np.float32)
        marks[places, of_class] = 1
        slope.inside_bias[:] = d_inside @ marks
        back = (self.to_class.T @ d_class + self.to_inside.T @ d_inside) * (1 - hidden * hidden)
        slope.bias[:, 0] = back.sum(axis=1)
        for k in range(len(around)):
            for d in range(s.width):
                slope.embed[k, d] = np.bincount(around[k], weights=back[d], minlength=s.ids + 1)
        slope.flat /= n
        squares.flat += slope.flat * slope.flat
        self.flat -= s.rate * slope.flat / (np.sqrt(squares.flat) + 1e-6)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    """Over the first axis, in place."""
    x -= x.max(axis=0)
    x -= np.log(np.exp(x).sum(axis=0))
    return x


def windows(texts: list[np.ndarray], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(around, words) of all places of some documents; beyond a document's ends stands the id of nothing."""
    far, nothing = max(map(abs, shape.offsets)), shape.ids
    gap = np.full(far, nothing, np.intp)
    line = np.concatenate([gap, *(x for t in texts for x in (t, gap))])
    at = np.flatnonzero(line != nothing)
    return np.stack([line[at + k] for k in shape.offsets]), line[at]


def vocabulary(docs: DataFrame, shape: Shape | None = None) -> Words:
    """Counts of all words of all documents, in a saved table; the common ones and a sum for each bucket reach the driver."""
    spark = docs.sparkSession
    text = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    words = docs.select(F.explode(F.split(text, SPACE)).alias("word")).where("word != ''")
    path = scratch_path(spark, "words")
    words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    counts = spark.read.schema("word string, n bigint").parquet(path)
    size = counts.agg(F.count(F.lit(1)).alias("different"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
    shape = shape or Shape.sized(size["different"])
    found = counts.where(F.col("n") * HEAD_SHARE >= size["all"]).collect()
    common = sorted(((r["word"], r["n"]) for r in found), key=lambda x: (-x[1], x[0].encode()))
    bucket = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(shape.buckets)).cast("int")
    totals = {r["bucket"]: r["n"] for r in counts.groupBy(bucket.alias("bucket")).agg(F.sum(F.col("n") + 1).alias("n")).collect()}
    for word, n in common[: shape.frequent]:
        totals[zlib.crc32(word.encode()) % shape.buckets] -= n + 1
    return Words(common, totals, path, shape, size["all"])


#: Weights of one row on their way to the average, and rows that are added at a time.
CHUNK, FAN_IN = 4096, 32
#: Words of a shard, about: the network is trained on each shard for itself and then averaged.
SHARD_WORDS = 1 << 22


def _added(group: pd.DataFrame) -> pd.DataFrame:
    """One row for rows of a chunk, added in the order of their shards."""
    group = group.sort_values("part")
    total = np.sum(np.stack(group["total"].to_numpy()), axis=0)
    return pd.DataFrame({"chunk": group["chunk"].iloc[:1], "part": group["part"].iloc[:1], "seen": [group["seen"].sum()], "total": [total]})


def train(docs: DataFrame, shape: Shape | None = None) -> tuple[Words, Network]:
    """Vocabulary and network of a corpus.  Only the weights and the common words reach the driver.

    Documents are dealt into shards by a hash, and sorted by it in their shard, so the result does not depend on how
    the table is split into files or tasks.
    """
    words = vocabulary(docs, shape)
    shape = words.shape
    network = Network(shape)
    shards = max(1, round(words.total / SHARD_WORDS))
    mark = F.xxhash64("doc_id", "text")
    rows = docs.select(
        F.pmod(mark, F.lit(shape.rounds)).alias("round"), F.pmod(F.shiftright(mark, 20), F.lit(shards)).cast("int").alias("shard"), mark.alias("mark"), "text"
    )
    for k in range(shape.rounds):
        start = network.flat

        def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shard, own, squares, held, size, seen = None, None, None, [], 0, 0

            def step() -> None:
                around, at = windows(held, shape)
                for i in range(0, size, shape.batch):
                    own.train(around[:, i : i + shape.batch], at[i : i + shape.batch], squares)

            def ended() -> pd.DataFrame:
                parts = [own.flat[i : i + CHUNK].astype(np.float64) * seen for i in range(0, len(own.flat), CHUNK)]
                return pd.DataFrame({"chunk": range(len(parts)), "part": shard, "seen": seen, "total": parts})

            for batch in batches:
                for at, text in zip(batch["shard"], batch["text"]):
                    if at != shard:
                        if size:
                            step()
                        if seen + size:
                            seen += size
                            yield ended()
                        shard, own, held, size, seen = at, Network(shape, start.copy()), [], 0, 0
                        squares = own.like()
                    ids = words.of(text or "")
                    held.append(ids)
                    size += len(ids)
                    if size >= shape.batch:
                        step()
                        seen, size, held = seen + size, 0, []
            if size:
                step()
            if seen + size:
                seen += size
                yield ended()

        dealt = rows.where(F.col("round") == k).repartition(shards, "shard").sortWithinPartitions("shard", "mark")
        schema = "chunk int, part int, seen bigint, total array<double>"
        parts = saved(dealt.select("shard", "text").mapInPandas(learn, schema), "weights")
        left = shards
        while left > 1:  # a tree, so that a task adds a bounded number of rows
            left = -(-left // FAN_IN)
            place = F.floor(F.col("part") / FAN_IN).cast("int")
            parts = parts.withColumn("part", place).groupBy("chunk", "part").applyInPandas(_added, schema)
        table = parts.toPandas()
        if len(table):
            flat = network.flat.copy()
            for chunk, seen, total in zip(table["chunk"], table["seen"], table["total"]):
                flat[chunk * CHUNK : chunk * CHUNK + len(total)] = np.asarray(total) / seen
            network = Network(shape, flat)
    return words, network


def log_likelihood(ids: np.ndarray, network: Network) -> float:
    """Sum of the log-probabilities of all words of one document."""
    total, step = 0.0, network.shape.batch
    around, at = windows([ids], network.shape)
    for i in range(0, len(at), step):
        total += float(network.forward(around[:, i : i + step], at[i : i + step])[0].sum(dtype=np.float64))
    return total


def score(docs: DataFrame, words: Words, network: Network) -> DataFrame:
    """doc_id, n_words, log_likelihood and mean_log_likelihood of every document under a trained network."""
    shape = network.shape

    @F.pandas_udf("n_words bigint, log_likelihood double, rare array<string>")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            logs, held, size = [], [], 0
            counts, shares, rare = [], [], []

            def flush() -> None:
                if size:
                    around, at = windows(held, shape)
                    each = network.forward(around, at)[0].astype(np.float64)
                    sums = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum([len(x) for x in held])])]
                    logs.extend(np.diff(sums).tolist())
                else:
                    logs.extend(0.0 for _ in held)

            for text in batch:
                own, places = words.places(text or "")
                ids = words.ids[places]
                counts.append(len(ids))
                shares.append(float(words.shares[places].sum()))
                rare.append([own[k].decode() for k in np.flatnonzero(places >= words.known).tolist()])
                if len(ids) > shape.batch:  # a long document for itself, part by part
                    flush()
                    held, size = [], 0
                    logs.append(log_likelihood(ids, network))
                    continue
                held.append(ids)
                size += len(ids)
                if size >= shape.batch:
                    flush()
                    held, size = [], 0
            flush()
            yield pd.DataFrame({"n_words": counts, "log_likelihood": np.add(logs, shares), "rare": rare})

    key = F.xxhash64("doc_id", "text").alias("key")  # tells rows of one id apart
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key, scores("text").alias("s")).select("doc_id", "key", "s.*")
    rows = saved(rows, "scored")
    # what was seen of a rare word; it has counted as unseen so far.  No rare word is hot, as HEAD_SHARE bounds it
    table = docs.sparkSession.read.schema("word string, n bigint").parquet(words.table).hint("shuffle_hash")
    seen = rows.select("doc_id", "key", F.explode("rare").alias("word")).join(table, "word")
    more = seen.groupBy("doc_id", "key").agg(F.sum(F.log(F.col("n") + F.lit(1.0))).alias("more"))
    # equal rows have one score, and stay as many as they are
    both = rows.select("doc_id", "key", "n_words", "log_likelihood", F.lit(1).alias("copies"), F.lit(0.0).alias("more")).unionByName(
        more.select("doc_id", "key", "more"), allowMissingColumns=True
    )
    scored = both.groupBy("doc_id", "key").agg(
        F.max("n_words").alias("n_words"), F.max("log_likelihood").alias("log_likelihood"), F.sum("copies").alias("copies"), F.sum("more").alias("more")
    )
    out = scored.select("doc_id", "n_words", (F.col("log_likelihood") + F.col("more") / F.col("copies")).alias("log_likelihood"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy"))
    return out.drop("_copy").withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


def pseudo_likelihood(docs: DataFrame, shape: Shape | None = None) -> DataFrame:
    """Train on all documents, then score them all.

    ``docs`` needs doc_id and text; other columns are ignored.  A text without words, a null one too, scores 0 with a
    null mean.  Repeated rows are trained on and scored each for itself.  An empty table gives no rows.
    """
    words, network = train(docs, shape)
    return score(docs, words, network)
