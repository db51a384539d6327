"""Near duplicates by SimHash and multi-index hashing.

A fingerprint is cut into segments.  If two fingerprints differ in few bits, then in some segment they differ in
very few, so it is enough to enumerate the small Hamming ball around each fingerprint's segment, to fetch the table
entries with these segment values, and to verify the whole distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm import shingle_join
from candela.llm.components import components
from candela.llm.frames import hot_keys, hot_size, lookup, saved, spread_join

BITS = 64
DISTANCE = 4
SHINGLE = 4
#: Shingles whose bits are counted at a time.
COUNT_ROWS = 1 << 16
#: Table entries of one segment value from which its pairs are not listed but spanned, the most in a block, and the
#: entries from which a value is indexed once more by its other bits.
DENSE, BLOCK, INDEXED = 32, 2048, 1 << 15
PARTS = 3

_UPPER = bytes(range(256)).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
_BIT = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingles(text: str, width: int) -> list[bytes]:
    """Runs of ``width`` words, joined by spaces; all words if there are fewer, nothing without words."""
    words = text.encode().translate(_UPPER).split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    return [joined[a : b - 1] for a, b in zip([0, *ends[:-width]], ends[width - 1 :])]


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """Unsigned fingerprint: a bit is set if it is in over half of the shingles' hashes."""
    runs = shingles(text, width)
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(runs), COUNT_ROWS):
        part = runs[k : k + COUNT_ROWS]
        hashes = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in part), dtype=np.uint64, count=len(part)).view(np.uint8).reshape(-1, 8)
        if len(part) < 512:
            counts += np.unpackbits(hashes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            counts += np.concatenate([np.bincount(hashes[:, b], minlength=256) @ _BIT for b in range(8)])
    return int(sum(1 << b for b in np.flatnonzero(2 * counts > len(runs)).tolist()))


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash (64 bits, tells rows of one id apart) and signed 64-bit fingerprint of every whole text."""

    @F.pandas_udf("bigint")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t or "", width) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col("doc_id").cast("long"), text_hash().alias("text_hash"), fp("text").alias("fp"))


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def segments(distance: int, parts: int, width: int = BITS) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each segment.  If every segment differed in more bits than its radius, the
    whole would differ in more than ``distance``."""
    cuts = [width * k // parts for k in range(parts + 1)]
    base, more = divmod(distance, parts)
    return [(a, b - a, base if k <= more else base - 1) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if k <= more or base > 0]


def _ball(bits: int, radius: int) -> list[int]:
    return [sum(1 << b for b in at) for r in range(radius + 1) for at in combinations(range(bits), r)]


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _spanned(distance: int):
    def edges(group: pd.DataFrame) -> pd.DataFrame:
        """Enough links of a block to join whatever any of its links joins."""
        table = group.loc[group["entry"], "fp"].to_numpy(np.int64).view(np.uint64)
        probes = group.loc[~group["entry"], "fp"].to_numpy(np.int64).view(np.uint64)
        near = np.bitwise_count(table[:, None] ^ probes[None, :]) <= distance
        a, b = [], []
        new_t, new_p = np.ones(len(table), bool), np.ones(len(probes), bool)
        for first in range(len(table)):
            if not new_t[first]:
                continue
            new_t[first] = False
            front = np.array([first])
            while len(front):
                reach = np.flatnonzero(near[front].any(axis=0) & new_p)
                new_p[reach] = False
                a.append(table[front[near[np.ix_(front, reach)].argmax(axis=0)]])
                b.append(probes[reach])
                front = np.flatnonzero(near[:, reach].any(axis=1) & new_t)
                new_t[front] = False
                a.append(table[front])
                b.append(probes[reach[near[np.ix_(front, reach)].argmax(axis=1)]] if len(reach) else table[front])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b))
        keep = a != b
        return pd.DataFrame({"a": a[keep].view(np.int64), "b": b[keep].view(np.int64)})

    return edges


def _cut(fp: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))


def _others(first: int, bits: int) -> Column:
    """The fingerprint without one segment, closed up."""
    above = F.lit(0).cast("long") if first + bits == BITS else F.shiftleft(F.shiftrightunsigned("fp", first + bits), first)
    return above.bitwiseOR(_cut(F.col("fp"), 0, first)) if first else above


def _second_keys(cuts: list[tuple[int, int, int]], distance: int, probing: bool) -> Column:
    """Keys of the second index: the first key with a segment of the other bits, or with the ball around it."""
    out = None
    for k, (first, bits, _) in enumerate(cuts):
        rest, each = _others(first, bits), []
        for j, (a, n, r) in enumerate(segments(distance, PARTS, BITS - bits)):
            part = rest if a == 0 and n == BITS - bits else _cut(rest, a, n)
            for mask in _ball(n, r) if probing else [0]:
                each.append(F.xxhash64("key", F.lit(j), part.bitwiseXOR(F.lit(mask).cast("long"))))
        keys = F.array_distinct(F.array(*each))
        out = F.when(F.shiftright("key", 40) == k, keys) if out is None else out.when(F.shiftright("key", 40) == k, keys)
    return out


def links(prints: DataFrame, distance: int = DISTANCE, parts: int = PARTS) -> DataFrame:
    """Links (a, b) between different fingerprints of at most ``distance`` bits.

    ``prints`` has each fingerprint once.  Every two that are so near are linked directly or, within a dense segment
    value, by a chain of such links.  ``parts`` sets the cost only.  The probes of a fingerprint are the same in a
    table of any size; a segment value with very many entries is indexed again by the bits outside of the segment.
    """
    cuts = segments(distance, parts)

    def key(k: int, place: Column) -> Column:
        return place.bitwiseOR(F.lit(k << 40))

    table = prints.select("fp", F.explode(F.array(*[key(k, _cut(F.col("fp"), a, n)) for k, (a, n, _) in enumerate(cuts)])).alias("key"))

    def ball(k: int, first: int, bits: int, radius: int) -> Column:
        masks = F.array(*[F.lit(m).cast("long") for m in _ball(bits, radius)])
        return F.transform(masks, lambda m: key(k, _cut(F.col("fp"), first, bits).bitwiseXOR(m)))

    probes = prints.select("fp", F.explode(F.concat(*[ball(k, *cut) for k, cut in enumerate(cuts)])).alias("key"))

    dense = saved(table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > DENSE), "dense")
    # sparse values: list the pairs, each once, in the first segment that shows it
    sparse = table.join(dense, "key", "left_anti")
    other = F.col("t.fp")
    seg = F.shiftright(F.col("t.key"), 40)
    earlier = F.lit(False)
    for k, (a, n, r) in enumerate(cuts[:-1]):
        earlier = earlier | ((seg > k) & (F.bit_count(_cut(F.col("p.fp").bitwiseXOR(other), a, n)) <= r))
    pairs = (
        probes.alias("p").join(sparse.alias("t"), (F.col("p.key") == F.col("t.key")) & (F.col("p.fp") < other) & (_apart(F.col("p.fp"), other) <= distance) & ~earlier)
        .select(F.col("p.fp").alias("a"), other.alias("b"))
    )
    # dense values: blocks of entries against blocks of probes, a spanning forest of each
    if dense.limit(1).count() == 0:
        return pairs
    entries = table.join(dense.select("key", "n"), "key")
    asking = probes.join(dense.select("key", "n"), "key")

    def level(df: DataFrame, large: bool, probing: bool) -> DataFrame:
        if not large:
            return df.where(F.col("n") <= INDEXED).select("key", "fp")
        return df.where(F.col("n") > INDEXED).select("fp", F.explode(_second_keys(cuts, distance, probing)).alias("key")).select("key", "fp")

    found = pairs.unionByName(_spanning(level(entries, False, False), level(asking, False, True), distance))
    if dense.where(F.col("n") > INDEXED).limit(1).count() == 0:
        return found
    return found.unionByName(_spanning(level(entries, True, False), level(asking, True, True), distance))


def _spanning(entries: DataFrame, asking: DataFrame, distance: int) -> DataFrame:
    """Spanning links of the near pairs of ``entries`` and ``asking`` (key, fp) that share a key."""
    counted = saved(entries.groupBy("key").agg(F.count(F.lit(1)).alias("entries")), "entries")
    hit = saved(asking.join(counted, "key"), "probes")
    sizes = saved(hit.groupBy("key", "entries").agg(F.count(F.lit(1)).alias("probes")), "sizes")

    def blocks(column: str) -> Column:
        return F.ceil(F.col(column) / BLOCK).cast("int")

    def own(column: str) -> Column:
        return F.pmod(F.xxhash64("fp"), blocks(column)).cast("int")

    table = entries.join(sizes, "key").select(
        "key", "fp", F.lit(True).alias("entry"), own("entries").alias("i"), F.explode(F.sequence(F.lit(0), blocks("probes") - 1)).alias("j")
    )
    probes = hit.join(sizes.drop("entries"), "key").select(
        "key", "fp", F.lit(False).alias("entry"), F.explode(F.sequence(F.lit(0), blocks("entries") - 1)).alias("i"), own("probes").alias("j")
    )
    return table.unionByName(probes).groupBy("key", "i", "j").applyInPandas(_spanned(distance), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, distance: int = DISTANCE, parts: int = PARTS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links), group_size, text_hash.

    ``docs`` needs doc_id and text; other columns are ignored.  Texts without words, null ones too, have fingerprint
    zero and link like any other.  Repeated rows are rows of their own in the group of their fingerprint; a null
    doc_id counts only where its group has no other.  An empty table gives no rows.
    """
    rows = saved(fingerprints(docs, width), "fingerprints")
    prints = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "prints")
    found = saved(links(prints.select("fp"), distance, parts), "near")
    roots = components(found).withColumnRenamed("node", "fp")
    named = saved(prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "named")
    groups = named.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("group_size"))
    total = named.count()
    of_print = saved(lookup(named, groups, "root", hot_keys(named, "root", total), ["fp"]).select("fp", "component_id", "group_size", "n"), "classes")
    hot = of_print.where(F.col("n") >= max(64, -(-rows.count() // 1024))).select("fp")
    out = lookup(rows, of_print.drop("n"), "fp", hot, ["doc_id"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "group_size", "text_hash")


# ---- near copies by similarity: several fingerprints, and links that the texts confirm --------------------

#: Fingerprints of a text; cut in three, they have 18 segments, in one of which near copies differ in one bit at most.
PRINTS = 6
#: Bits that fingerprints of near copies differ in at most: in the one with the segment, in another one, and in all; and
#: rows of a value that are tied to one.  At a similarity of 0.8 these are three deviations and more above the mean.
ONE_APART, OTHER_APART, ALL_APART, TIED = 16, 21, 96, 16
#: Words of the parity sketch that goes with each value.
SKETCH = 4
_STEPS = [np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1) for k in range(1, PRINTS + 1)]


def many_prints(tokens: np.ndarray) -> np.ndarray:
    """PRINTS fingerprints of a set of hashed shingles."""
    counts = np.zeros((PRINTS, BITS), np.int64)
    for at in range(0, len(tokens), COUNT_ROWS):
        for f, step in enumerate(_STEPS):
            x = tokens[at : at + COUNT_ROWS] + step
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            counts[f] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits((2 * counts > len(tokens)).astype(np.uint8), axis=1, bitorder="little").view(np.int64).ravel()


def _read_prints(docs: DataFrame, width: int) -> DataFrame:
    words = [f"w{k}" for k in range(SKETCH)]

    @F.pandas_udf(f"prints array<bigint>, size bigint, bits array<bigint>, {', '.join(f'{w} bigint' for w in words)}")
    def prints(texts: pd.Series) -> pd.DataFrame:
        read = shingle_join.Shingler(width)
        sets = [read(t) for t in texts]
        out = pd.DataFrame({
            "prints": [many_prints(x) if len(x) else None for x in sets], "size": [len(x) for x in sets],
            "bits": [shingle_join.parity(x) for x in sets],
        }, columns=["prints", "size", "bits"])
        out[words] = np.array([shingle_join.parity(x, SKETCH) for x in sets], np.int64).reshape(-1, SKETCH)
        return out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), prints("text").alias("of"))
    return saved(rows.select("doc_id", "text_hash", "of.*").withColumn("sid", F.monotonically_increasing_id()), "many-prints")


def _values(rows: DataFrame) -> DataFrame:
    """sid, comp, place and value of each segment, the fingerprint that it is cut from, and another one."""
    each = [
        F.struct(F.lit(3 * f + k).alias("place"), F.shiftrightunsigned(F.get("prints", F.lit(f)), a).bitwiseAND(F.lit((1 << n) - 1)).cast("int").alias("value"),
                 F.get("prints", F.lit(f)).alias("print"), F.get("prints", F.lit((f + 1) % PRINTS)).alias("other"))
        for f in range(PRINTS) for k, (a, n, _) in enumerate(segments(5, 3))
    ]
    return rows.select("sid", "comp", "size", *[f"w{k}" for k in range(SKETCH)], F.inline(F.array(*each)))


def _possible(a: str, b: str, percent: int) -> Column:
    """Whether sizes and short sketches of the sides ``a`` and ``b`` allow the similarity."""
    n, m = F.col(f"{a}.size"), F.col(f"{b}.size")
    common = F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))
    differ = sum((_apart(F.col(f"{a}.w{k}"), F.col(f"{b}.w{k}")) for k in range(1, SKETCH)), _apart(F.col(f"{a}.w0"), F.col(f"{b}.w0")))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (n + m - 2 * common >= differ)


def _far(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, d: s + d)


def similar_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable over links), text_hash of every row.

    Links are pairs of texts whose sets of ``width``-word shingles have a Jaccard similarity of ``percent`` or more, which
    the texts confirm; candidates are found by SimHash.  Each text has PRINTS fingerprints, each cut in three segments.  Two
    texts are candidates if some segment differs in one bit at most and the fingerprints in ONE_APART, OTHER_APART and
    ALL_APART bits at most.  A bit differs with the arc cosine of 2 s / (1 + s) over pi, 0.15 at s = 0.8, so that 0.95 of the pairs of that
    similarity are candidates, and more of those above.  The ball of radius one is searched through the halves of a
    segment, one of which is equal.  Rows of one value are first tied to one of them, and a component then has one row
    in each value, so hot groups are neither paired out nor met in one task.  Sizes and parity sketches of the sets rule out
    pairs that cannot have the similarity (see ``shingle_join``), which keeps the rows of a group that are less similar apart
    before they are listed.

    ``docs`` needs doc_id and text; other columns are ignored.  Null texts and those without words are linked with
    nothing.  Repeated rows are linked; a null doc_id counts only where its component has no other.  An empty table
    gives no rows.
    """
    rows = _read_prints(docs, width)
    full = rows.where("prints IS NOT NULL").drop("doc_id", "text_hash")
    facts = rows.select("sid", "doc_id", "text_hash")

    def near(pairs: DataFrame) -> DataFrame:
        """Different ones of ``pairs`` (a, b) whose fingerprints are near, confirmed by the texts."""
        one = saved(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
        for side, hot in shingle_join.hot_sides(one):
            one = spread_join(one, full.select(F.col("sid").alias(side), F.struct("prints", "size", "bits").alias(f"of_{side}")), side, hot, ["a", "b"])
        close = (_far(F.col("of_a.prints"), F.col("of_b.prints")) <= ALL_APART) & shingle_join.possible("of_a", "of_b", percent)
        return shingle_join.verified(one.where(close).select("a", "b"), facts, docs, width, percent)

    # rows of one value are tied to its smallest
    values = saved(_values(full.withColumn("comp", F.col("sid"))).select("place", "value", "sid"), "values")
    crowds = values.groupBy("place", "value").agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("b")).where(F.col("n") > TIED)
    crowds = saved(crowds.select(F.struct("place", "value").alias("at"), "n", "b"), "crowds")
    found, labels = docs.sparkSession.createDataFrame([], "a bigint, b bigint"), None
    if crowds.limit(1).count():
        crowded = values.select(F.struct("place", "value").alias("at"), F.col("sid").alias("a"))
        hot = crowds.where(F.col("n") >= hot_size(values.count())).select("at", "n")
        ties = spread_join(crowded, crowds, "at", hot, ["a"]).where("a != b").groupBy("a", "b").agg(F.max("n").alias("n"))
        ties = saved(ties, "ties")
        # first the tie of each row to its largest crowd; then those that still join two components
        best = saved(ties.groupBy("a").agg(F.max(F.struct("n", "b")).alias("m")).select("a", F.col("m.b").alias("b")), "first-ties")
        found = near(best)
        labels = saved(components(found), "tied")
        rest = saved(ties.join(best, ["a", "b"], "left_anti"), "ties")
        for side in ("a", "b"):
            rest = lookup(rest, labels.select(F.col("node").alias(side), F.col("root").alias(f"of_{side}")), side, hot_keys(rest, side, rest.count()), ["a", "b"])
        open_ = rest.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
        found = saved(found.unionByName(near(open_)), "found")
        labels = saved(components(found), "tied")

    # one row for each component and value; those that share half of a segment and differ in one bit of the other
    named = full.withColumn("comp", F.col("sid")) if labels is None else (
        full.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("root", "sid")).drop("root"))
    carried = ["print", "other", "size", *[f"w{k}" for k in range(SKETCH)]]
    each = saved(_values(named).groupBy("place", "value", "comp").agg(*[F.min_by(x, "sid").alias(x) for x in carried], F.min("sid").alias("sid")), "by-value")
    half = [(F.col("value").bitwiseAND(F.lit(1023)), F.shiftright("value", 10)), (F.shiftright("value", 10), F.col("value").bitwiseAND(F.lit(1023)))]
    cut = each.select("sid", "comp", *carried, F.inline(F.array(*[F.struct((2 * F.col("place") + h).alias("half"), same.alias("same"), rest.alias("rest")) for h, (same, rest) in enumerate(half)])))
    x, y = cut.alias("x"), cut.alias("y")
    apart = F.bit_count(F.col("x.rest").bitwiseXOR(F.col("y.rest")))
    # equal values show once, in the first half
    ball = (apart <= 1) & ((apart == 1) | (F.col("x.half") % 2 == 0))
    met = x.join(y, (F.col("x.half") == F.col("y.half")) & (F.col("x.same") == F.col("y.same")) & (F.col("x.sid") < F.col("y.sid"))
                 & (F.col("x.comp") != F.col("y.comp")) & ball & (_apart(F.col("x.print"), F.col("y.print")) <= ONE_APART) & (_apart(F.col("x.other"), F.col("y.other")) <= OTHER_APART)
                 & _possible("x", "y", percent))
    found = found.unionByName(near(met.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"))))
    roots = components(found)

    named = saved(facts.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid")), "named")
    groups = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return lookup(named, groups, "root", hot_keys(named, "root", named.count()), ["sid"]).select("doc_id", "component_id", "text_hash")
