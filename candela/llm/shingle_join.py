"""Self-join of documents on the Jaccard similarity of their shingle sets: size-aware, with a heavy and a light way.

Shingles are ordered from rare to frequent by a sketch of all documents.  Two sets of the wanted similarity share
``c`` of their shingles or more, ``c`` following from the sizes, so the first ``size - c + k`` of both hold ``k`` common ones.

* Small sets take the light way: they list all subsets of ``subset`` shingles of this prefix, and meet in equal subsets.
  One subset is shared by few sets, even where its members are shared by many, but there are many subsets.
* Large sets take the heavy way: their prefix for ``k = 1`` goes to inverted lists, which are scanned.  Lists also hold the
  small sets that are large enough to be near a large one.

The boundary is the size for which the subsets listed and the list entries scanned, both counted, are fewest.

A subset or list that many sets share is not paired out.  Each round ties its sets to one of them, and where that has
made one component of them, nothing is left to do.  Then the sets of a key are compared by their parity sketches, in
blocks, and a forest of the closest pairs between components is tried first: as many pairs as sets at most, which leave
few components of a crowd.  At last all pairs that still are between two components are listed.  Pairs are dropped whose
sketches differ in more bits than the sets may differ in shingles; all others are decided by their texts.  So the links
are exact, and none between two components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm.components import components
from candela.llm.frames import hot_keys, hot_size, lookup, saved, spread_join

WIDTH, PERCENT, SUBSET = 4, 85, 2
#: Cells of the sketch that counts shingles, as a power of two; their order sets the cost only.
CELL_BITS, SLICES = 20, 64
#: Sets larger than this never take the light way.
LARGEST_SMALL = 128
#: Sets that share a key from which they are tied to one of them before they are paired, rounds of that, and sets in a block.
DENSE, ROUNDS, BLOCK = 4, 6, 1024
#: Texts are picked by their place among so many, which bounds the table that is broadcast for it.
PLACES = 1 << 18
#: Words of a sketch at least, of one that goes to the blocks of a key, and rows that are sent to one task together; powers of two.
SHORT, LONG, BUCKET_ROWS = 8, 32, 1024
#: Words whose hashes a worker keeps.
WORDS_KEPT = 1 << 16

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of the 64-bit hashes of their different shingles."""

    def __init__(self, width: int = WIDTH):
        self.width, self.words = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Runs of ``width`` words, A to Z in lower case; all words as one if there are fewer, nothing without words."""
        words = (text or "").encode().translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        known = self.words
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        hashes = np.array([known[w] for w in words], dtype=np.uint64)
        width = min(self.width, len(words))
        out = np.full(len(words) - width + 1, width, dtype=np.uint64)
        for k in range(width):
            out = _mixed(out + hashes[k : len(hashes) - width + 1 + k])
        return np.unique(out)


def least_common(size: int, percent: int = PERCENT) -> int:
    """Shingles that a set of ``size`` shares with any set that is so similar, at least."""
    return -(-percent * size // 100)


def smallest_set(percent: int) -> int:
    """Sets with fewer shingles are so similar to equal sets only."""
    return -(-percent // (100 - percent))


def parity(tokens: np.ndarray, words: int | None = None) -> np.ndarray:
    """Parity sketch: each shingle turns one bit of a row that has a power of two of bits, two to four times as many as shingles
    and ``SHORT`` words of 64 at least, unless ``words`` are asked for.
    Sketches of two sets differ in no more bits than the sets do in shingles; a longer one folds to the length of a shorter."""
    words = words or max(SHORT, 1 << max(0, (len(tokens) - 1).bit_length() - 5))
    bits = np.bincount((tokens & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _half(bits: Column) -> Column:
    """A sketch folded to half its words: the upper half has the shingles with one more bit set in their place."""
    middle = (F.size(bits) / 2).cast("int")
    return F.zip_with(F.slice(bits, F.lit(1), middle), F.slice(bits, middle + 1, middle), lambda x, y: x.bitwiseXOR(y))


def _differ(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, d: s + d)


def possible(a: str, b: str, percent: int, bits: str = "bits") -> Column:
    """Whether sizes and sketches of the sides ``a`` and ``b`` allow the similarity.  Sizes apart by less than twice
    have sketches apart by one folding at most."""
    n, m, x, y = (F.col(f"{s}.{c}") for c in ("size", bits) for s in (a, b))
    common = F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))
    differ = (
        F.when(F.size(x) == F.size(y), _differ(x, y)).when(F.size(x) == 2 * F.size(y), _differ(_half(x), y))
        .when(2 * F.size(x) == F.size(y), _differ(x, _half(y))).otherwise(0)
    )
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (n + m - 2 * common >= differ)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _signature(tokens: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return _signed(digest >> 64), _signed(digest & (1 << 64) - 1)


_READ = "doc_id bigint, text_hash bigint, size bigint, s1 bigint, s2 bigint, slice int, part int, counts binary"


def read_sets(docs: DataFrame, width: int) -> DataFrame:
    """Of every row doc_id, text_hash, size of its set and the set's signature (s1, s2); and of every task the counts of
    all shingles it has seen by cell of the sketch, in slices."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, counts = Shingler(width), np.zeros(1 << CELL_BITS, np.int64)
        part = None
        for batch in batches:
            out, tokens = [], []
            for doc_id, text_hash, text in zip(batch["doc_id"], batch["text_hash"], batch["text"]):
                part = text_hash % 256 if part is None else part
                found = shingler(text)
                tokens.append(found)
                out.append((None if pd.isna(doc_id) else int(doc_id), text_hash, len(found), *_signature(found)))
            if tokens:
                cells = (np.concatenate(tokens) >> np.uint64(64 - CELL_BITS)).astype(np.int64)
                counts += np.bincount(cells, minlength=1 << CELL_BITS)
            made = pd.DataFrame(out, columns=["doc_id", "text_hash", "size", "s1", "s2"])
            yield made.assign(doc_id=made["doc_id"].astype("Int64"), slice=-1, part=0, counts=None)
        if part is not None:
            cut = [c.astype("<i8").tobytes() for c in np.split(counts, SLICES)]
            none = pd.array([None] * SLICES, dtype="Int64")
            yield pd.DataFrame({c: none for c in ("doc_id", "text_hash", "size", "s1", "s2")}).assign(slice=range(SLICES), part=part, counts=cut)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"), "text")
    return saved(read.mapInPandas(rows, _READ), "sets-read")


def cell_ranks(read: DataFrame) -> np.ndarray:
    """The logarithm of the number of shingles in each cell of the sketch; its size is fixed."""

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, "<i8") for c in group["counts"])
        return group.head(1)[["slice", "part"]].assign(counts=[total.tobytes()])

    parts = read.where("slice >= 0").select("slice", "part", "counts")
    for level in (F.col("part"), F.pmod("part", F.lit(16)), F.lit(0)):  # each level adds a bounded number of slices in one task
        parts = parts.withColumn("part", level.cast("int")).groupBy("slice", "part").applyInPandas(added, "slice int, part int, counts binary")
    found = {r["slice"]: np.frombuffer(r["counts"], "<i8") for r in parts.collect()}
    counts = np.concatenate([found.get(k, np.zeros((1 << CELL_BITS) // SLICES, np.int64)) for k in range(SLICES)])
    return np.log2(np.maximum(counts, 1)).astype(np.uint8)


_SETS = "s1 bigint, s2 bigint, size bigint, doc_id bigint, text_hash bigint, prefix array<bigint>, bits array<bigint>"


def different_sets(docs: DataFrame, ranks: np.ndarray, width: int, percent: int, subset: int) -> DataFrame:
    """One row for each different set that can be near another: sid, signature, size, a row that has it, its prefix in
    order, and its parity sketch of ``LONG`` words at least."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    least = smallest_set(percent)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, rank = Shingler(width), shared.value
        for batch in batches:
            out = []
            for doc_id, text_hash, text in zip(batch["doc_id"], batch["text_hash"], batch["text"]):
                tokens = shingler(text)
                if len(tokens) < least:
                    continue
                order = np.argsort(rank[(tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)], kind="stable")
                prefix = tokens[order[: len(tokens) - least_common(len(tokens), percent) + subset]].view(np.int64)
                bits = parity(tokens)
                bits = bits if len(bits) >= LONG else parity(tokens, LONG)
                out.append((*_signature(tokens), len(tokens), None if pd.isna(doc_id) else int(doc_id), text_hash, prefix, bits))
            made = pd.DataFrame(out, columns=["s1", "s2", "size", "doc_id", "text_hash", "prefix", "bits"])
            yield made.assign(doc_id=made["doc_id"].astype("Int64"))

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"), "text")
    each = read.mapInPandas(rows, _SETS).dropDuplicates(["s1", "s2"])
    return saved(each.withColumn("sid", F.monotonically_increasing_id()), "sets")


def _entries(percent: int) -> Column:
    """The shingles of a prefix that go to inverted lists."""
    n = F.col("size")
    return F.slice("prefix", F.lit(1), (n - F.ceil(F.lit(percent) * n / 100) + 1).cast("int"))


def boundary(sets: DataFrame, percent: int, subset: int) -> int:
    """Size up to which sets list subsets: the one with the fewest subsets listed and list entries scanned.

    A set scans the whole list of each of its entries.  Lists are counted over all sets that can take the light way
    or be near such a set; what larger sets cost does not depend on the boundary.
    """
    reach = LARGEST_SMALL * 100 // percent
    some = sets.where(F.col("size") <= reach).select("sid", "size", F.explode(_entries(percent)).alias("key"))
    lists = some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    scans = some.join(lists, "key").groupBy("size").agg(F.sum(F.col("n") - 1).alias("more"))
    counted = sets.where(F.col("size") <= reach).groupBy("size").agg(F.count(F.lit(1)).alias("sets"))
    rows = counted.join(scans, "size", "left").collect()  # one row for each size up to the bound
    light, heavy = np.zeros(reach + 2, dtype=object), np.zeros(reach + 2, dtype=object)
    for r in rows:
        loose = r["size"] - least_common(r["size"], percent)
        light[r["size"]] = r["sets"] * comb(loose + subset, subset)
        heavy[r["size"]] = r["sets"] * (loose + 1) + (r["more"] or 0)
    costs = [light[: x + 1].sum() + heavy[least_common(x + 1, percent) :].sum() for x in range(LARGEST_SMALL + 1)]
    return int(np.argmin(np.array(costs, dtype=float)))


@lru_cache(maxsize=None)
def _places(n: int, subset: int) -> np.ndarray:
    return np.array(list(combinations(range(n), subset)))


def keys(sets: DataFrame, most_small: int, percent: int, subset: int) -> DataFrame:
    """(key, sid): subsets of the small sets, inverted-list entries of the large sets and of those near enough to them."""

    @F.pandas_udf("array<bigint>")
    def subsets(prefixes: pd.Series) -> pd.Series:
        out = []
        for p in prefixes:
            chosen = np.asarray(p).view(np.uint64)[_places(len(p), subset)]
            key = np.full(len(chosen), subset, np.uint64)
            for k in range(subset):
                key = _mixed(key + chosen[:, k])
            out.append(key.view(np.int64))
        return pd.Series(out)

    light = sets.where(F.col("size") <= most_small).select("sid", F.explode(subsets("prefix")).alias("key"))
    heavy = sets.where(F.col("size") >= least_common(most_small + 1, percent)).select("sid", F.explode(_entries(percent)).alias("key"))
    return light.unionByName(heavy).select("key", "sid")


def hot_sides(pairs: DataFrame) -> list[tuple[str, DataFrame]]:
    """The hot keys of each side of saved pairs (a, b), counted before either side is joined."""
    least = hot_size(pairs.count())
    return [(side, pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)) for side in ("a", "b")]


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b), each there once, whose texts have the similarity."""
    pairs = saved(pairs, "candidates")
    wanted = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    holders = saved(sets.select("sid", "doc_id", "text_hash").join(wanted, "sid"), "holders")
    place = F.pmod("text_hash", F.lit(PLACES))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"), "text")
    # at most PLACES rows: most other texts need not be shuffled
    near = read.withColumn("place", place).join(F.broadcast(holders.select(place.alias("place")).distinct()), "place", "left_semi")
    same = (F.col("r.text_hash") == F.col("h.text_hash")) & F.col("r.doc_id").eqNullSafe(F.col("h.doc_id"))
    texts = near.alias("r").join(holders.alias("h"), same).select("h.sid", F.coalesce("r.text", F.lit("")).alias("text")).dropDuplicates(["sid"])
    texts = saved(texts, "texts")

    @F.pandas_udf("boolean")
    def similar(one: pd.Series, other: pd.Series) -> pd.Series:
        shingler = Shingler(width)
        kept: dict[str, np.ndarray] = {}

        def tokens(text: str) -> np.ndarray:
            if text not in kept:
                if len(kept) > 256:
                    kept.clear()
                kept[text] = shingler(text)
            return kept[text]

        out = []
        for x, y in zip(one, other):
            x, y = tokens(x), tokens(y)
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * common >= percent * (len(x) + len(y) - common))
        return pd.Series(out, dtype=bool)

    for side, hot in hot_sides(pairs):
        table = texts.select(F.col("sid").alias(side), F.col("text").alias(f"text_{side}"))
        pairs = spread_join(pairs, table, side, hot, ["a", "b"])
    return saved(pairs.where(similar("text_a", "text_b")).select("a", "b"), "links")


def _apart(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b), each there once, that are in different components and whose sizes and sketches allow the similarity."""
    pairs = saved(pairs, "pairs")
    for side, hot in hot_sides(pairs):
        table = facts.select(F.col("sid").alias(side), F.struct("size", "bits", "comp").alias(f"of_{side}"))
        pairs = spread_join(pairs, table, side, hot, ["a", "b"])
    return pairs.where((F.col("of_a.comp") != F.col("of_b.comp")) & possible("of_a", "of_b", percent)).select("a", "b")


def _named(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``members`` with ``comp``, the component of its set."""
    if labels is None:
        return members.withColumn("comp", F.col("sid"))
    named = members.drop("comp").join(labels.select(F.col("node").alias("sid"), "root"), "sid", "left")
    return named.withColumn("comp", F.coalesce("root", "sid")).drop("root")


class Block:
    """The sets of a key that meet in one task: which pairs of different components sizes and sketches allow.  Of a key
    cut into parts, ``own`` is the part of a set, and only pairs of the parts ``i`` and ``j`` are looked at."""

    SAME, FAR = -1, 1 << 30

    def __init__(self, rows: pd.DataFrame, percent: int):
        self.percent, self.i, self.j = percent, rows["i"].iloc[0], rows["j"].iloc[0]
        self.sid, self.size, self.comp, self.own = (rows[c].to_numpy() for c in ("sid", "size", "comp", "own"))
        self.bits = np.stack([self._folded(b) for b in rows["bits"]])

    @staticmethod
    def _folded(bits: np.ndarray) -> np.ndarray:
        bits = np.asarray(bits).view(np.uint64)
        while len(bits) > LONG:
            bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
        return bits

    def apart(self, k: int, others: np.ndarray) -> np.ndarray:
        """Of the sets ``others``, in how many bits they differ from set ``k``, ``FAR`` where the pair is ruled out; ``SAME``
        in its component."""
        size, n = self.size[others], self.size[k]
        may = 100 * np.minimum(size, n) >= self.percent * np.maximum(size, n)
        if self.i != self.j:
            may &= self.own[others] != self.own[k]
        out = np.full(len(others), self.FAR)
        at = others[may]
        differ = np.bitwise_count(self.bits[at] ^ self.bits[k]).sum(axis=1, dtype=np.int64)
        most = size[may] + n + 2 * (-self.percent * (size[may] + n) // (100 + self.percent))
        out[may] = np.where(differ <= most, differ, self.FAR)
        out[self.comp[others] == self.comp[k]] = self.SAME
        return out

    def every(self) -> Iterator[tuple[int, int]]:
        """All pairs that are allowed."""
        for k in range(len(self.sid) - 1):
            others = np.arange(k + 1, len(self.sid))
            far = self.apart(k, others)
            yield from ((k, x) for x in others[(far != self.SAME) & (far != self.FAR)])

    def forest(self) -> Iterator[tuple[int, int]]:
        """Of the allowed pairs, those of a least spanning forest over the components: set by set, the closest next."""
        left = np.arange(len(self.sid))
        best, source = np.full(len(left), self.FAR), np.zeros(len(left), np.int64)
        while len(left):
            at = int(best.argmin())
            k = left[at]
            if best[at] not in (self.SAME, self.FAR):
                yield source[at], k
            left, best, source = (np.delete(x, at) for x in (left, best, source))
            far = self.apart(k, left)
            closer = far < best
            best[closer], source[closer] = far[closer], k


def block_pairs(named: DataFrame, sets: DataFrame, hot: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs (a, b) of sets of different components that meet in a key of saved ``named`` (key, sid, n, comp) and are
    allowed by sizes and sketches: all, or those of a forest in each block."""
    open_keys = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("key", F.lit(True).alias("open"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    left = saved(spread_join(named, open_keys, "key", hot, ["sid"]).drop("open"), "open")
    total = left.agg(F.sum(blocks)).first()[0] or 0
    own = left.withColumn("own", F.pmod(F.xxhash64("sid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = own.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sid", "comp")
    bucket = F.pmod(F.xxhash64("key", "i", "j"), F.lit(1 + total // BUCKET_ROWS))
    placed = placed.join(sets.select("sid", "size", "bits"), "sid").withColumn("bucket", bucket)

    def paired(rows: pd.DataFrame) -> pd.DataFrame:
        out = set()
        for _, of_key in rows.sort_values("sid").groupby(["key", "i", "j"], sort=False):
            block = Block(of_key, percent)
            for x, y in block.forest() if forest else block.every():
                out.add(tuple(sorted((int(block.sid[x]), int(block.sid[y])))))
        return pd.DataFrame(list(out), columns=["a", "b"], dtype="int64")

    return placed.groupBy("bucket").applyInPandas(paired, "a bigint, b bigint")


def links(docs: DataFrame, sets: DataFrame, width: int, percent: int, subset: int, most_small: int | None = None) -> DataFrame:
    """Links (a, b) between sids that join all sets of at least ``percent`` similarity into their components."""
    most_small = boundary(sets, percent, subset) if most_small is None else most_small
    rows = keys(sets, most_small, percent, subset)
    facts = sets.select("sid", "size", "bits")
    shared = saved(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("a"), F.max("sid").alias("b")).where("n > 1"), "shared")
    # a key of two sets is their pair; only rows of the other keys go on
    larger = shared.where("n > 2").select("key", "n")
    hot = larger.where(F.col("n") >= hot_size(larger.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])).select("key", "n")
    members = saved(spread_join(rows, larger.select("key", F.col("n").alias("sets")), "key", hot, ["sid"]).withColumnRenamed("sets", "n"), "members")

    # rounds move names and sizes only; sketches are fetched for the pairs
    dense = members.where(F.col("n") > DENSE).join(sets.select("sid", "size"), "sid")
    found, labels, before = docs.sparkSession.createDataFrame([], "a bigint, b bigint"), None, None
    for turn in range(ROUNDS):
        # one pivot a key, another one each round; a set is compared with it unless they are in one component already
        named = saved(_named(dense, labels), "dense")
        open_keys = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.struct(F.xxhash64("sid", F.lit(turn)), "sid", "size", "comp")).alias("first"))
        pivots = saved(open_keys.where("low != high").select("key", F.col("first.sid").alias("b"), F.struct("first.size", "first.comp").alias("p")), "pivots")
        left = pivots.count()
        # a round that closes few keys costs more than the pairs it saves
        if left == 0 or before is not None and 4 * left > 3 * before:
            break
        before = left
        tied = named.select("key", F.col("sid").alias("a"), F.struct("size", "comp").alias("m"))
        near = F.least("m.size", "p.size") * 100 >= F.greatest("m.size", "p.size") * percent
        tied = spread_join(tied, pivots, "key", hot, ["a"]).where((F.col("m.comp") != F.col("p.comp")) & near)
        new = verified(_apart(tied.select("a", "b").distinct(), facts.withColumn("comp", F.col("sid")), percent), sets, docs, width, percent)
        if new.limit(1).count() == 0:
            break
        found = saved(found.unionByName(new), "found")
        labels = saved(components(found), "labels")

    # a forest of each key and the pairs that are keys of two, then what is still in different components
    two = shared.where("n = 2").select("a", "b")
    close = block_pairs(saved(_named(members, labels), "named"), sets, hot, percent, forest=True)
    new = verified(_apart(close.unionByName(two).distinct(), _named(facts, labels), percent), sets, docs, width, percent)
    found = saved(found.unionByName(new), "found")
    labels = saved(components(found), "labels")
    rest = block_pairs(saved(_named(members, labels), "named"), sets, hot, percent, forest=False)
    return found.unionByName(verified(_apart(rest.distinct(), _named(facts, labels), percent), sets, docs, width, percent))


def similar_documents(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, subset: int = SUBSET, most_small: int | None = None
) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable over links, the own one included) of every row.

    Two rows are linked if their sets of word shingles have a Jaccard similarity of ``percent`` or more.  ``docs`` needs
    doc_id and text; other columns are ignored.  A text without words, or null, has an empty set and is linked with
    nothing.  Repeated rows and rows of equal sets are linked; a null doc_id counts only where a component has no other.
    An empty table gives no rows.  ``subset`` shingles are common to all linked sets that differ (see ``smallest_set``).
    ``most_small`` sets the boundary between the two ways; by default it follows from their counted costs.
    """
    if not 1 <= subset <= smallest_set(percent):
        raise ValueError("sets of this similarity may share fewer shingles than a subset has")
    read = read_sets(docs, width)
    rows = read.where("slice < 0").select("doc_id", "text_hash", "size", "s1", "s2")
    sets = different_sets(docs, cell_ranks(read), width, percent, subset)
    roots = components(links(docs, sets, width, percent, subset, most_small))

    total = rows.count()
    full = rows.where("size > 0").select("doc_id", F.struct("s1", "s2").alias("set"))
    firsts = full.groupBy("set").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    named = sets.select(F.struct("s1", "s2").alias("set"), "sid").join(roots.withColumnRenamed("node", "sid"), "sid", "inner")
    classes = saved(firsts.join(named.select("set", "root"), "set", "left"), "classes")
    groups = classes.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("component_id"))
    linked = classes.where("root IS NOT NULL")
    joined = lookup(linked, groups, "root", hot_keys(linked, "root", total), ["set"])
    alone = classes.where("root IS NULL").withColumn("component_id", F.col("first"))
    of_set = saved(joined.select("set", "n", "component_id").unionByName(alone.select("set", "n", "component_id")), "of-set")
    hot = of_set.where(F.col("n") >= hot_size(total)).select("set")
    out = lookup(rows.select("doc_id", "size", F.struct("s1", "s2").alias("set")), of_set.drop("n"), "set", hot, ["doc_id"])
    component = F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))
