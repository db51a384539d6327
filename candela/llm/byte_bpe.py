"""Byte-level BPE by dynamic programming over prefixes.

An encoding is valid exactly if each two neighbouring tokens are what BPE makes of their joined bytes.  So every
byte prefix of a word has one valid last token: the one that is compatible with the last token of the prefix
before it.  A table of these last tokens is the whole state: bytes can be appended without touching what is
stored, and an edit re-encodes only from its place on.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the split of text before merges, and what counts as white space in it
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
_SPLIT = regex.compile(PATTERN)
# the same split where only these characters occur, for the faster engine
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_OTHERS = re.compile("[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ſ‐-‧]")
_PLAIN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
#: Entries of one generation of a cache of encoded words.
CACHE_WORDS = 250_000
#: Entries of the cache of token pairs.
CACHE_PAIRS = 500_000
#: Longer words are encoded each time and not kept.
CACHE_BYTES = 64


def split_words(text: str) -> list[str]:
    """The pieces of a text that are encoded each for itself."""
    return (_SPLIT if _OTHERS.search(text) else _PLAIN).findall(text)


class WordCache(dict):
    """Word to encoding.  Two generations bound it: when the young one is full, it becomes the old one."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str):
        value = self.old.get(word)
        if value is None:
            value = self.encode(word)
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value


class WordIds(WordCache):
    """Word to its ids as little-endian 32-bit numbers, by the vocabulary of a tokenizer file of merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, self.added = whole["model"], {}
        for x in whole.get("added_tokens") or ():
            if x.get("single_word") or x.get("lstrip") or x.get("rstrip") or x.get("normalized") and whole.get("normalizer"):
                raise ValueError(f"added token {x['content']!r} asks for more than its own text")
            self.added[x["content"]] = x["id"].to_bytes(4, "little")
        longest = sorted(self.added, key=len, reverse=True)
        self.cuts = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        code = byte_of_character()
        words = [*code, *("".join(_merge(m)) for m in model["merges"])]  # in the order of merging
        ranks = {bytes(map(code.__getitem__, word)): rank for rank, word in enumerate(words)}
        ids = [model["vocab"][word].to_bytes(4, "little") for word in words]
        core = tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe

        def encode(word: str) -> bytes:
            return b"".join(map(ids.__getitem__, core.encode_single_piece(word.encode())))

        super().__init__(encode)

    def text(self, text: str) -> bytes:
        """Ids of a text: the file's added tokens are cut out first, what is between them is encoded by words."""
        parts = self.cuts.split(text) if self.cuts else [text]
        if len(parts) == 1:
            return b"".join(map(self.__getitem__, split_words(text)))
        return b"".join(self.added[x] if k % 2 else b"".join(map(self.__getitem__, split_words(x))) for k, x in enumerate(parts))

    @staticmethod
    @lru_cache(maxsize=2)
    def of(path: str) -> WordIds:
        """One for each Python worker and file."""
        return WordIds(path)


def _merge(merge: str | list[str]) -> tuple[str, str]:
    a, b = merge.split(" ") if isinstance(merge, str) else merge
    return a, b


@lru_cache(maxsize=1)
def byte_of_character() -> dict[str, int]:
    """Characters by which tokenizer files write bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens by rank, and which pairs of them may stand side by side."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.decimal = {rank: str(rank) for rank in self.token}
        longest: dict[bytes, int] = {}
        for token in self.rank:
            longest[token[-3:]] = max(len(token), longest.get(token[-3:], 0))
        self.longest = longest
        self.pairs: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int]] = {}

    @staticmethod
    @lru_cache(maxsize=2)
    def of(path: str) -> Vocabulary:
        return Vocabulary(path)

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens of a token's last merge: merge by rank, until two are left."""
        known = self.parts.get(token)
        if known is None:
            data = self.token[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], len(self.rank)))
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            known = self.parts[token] = (self.rank[parts[0]], self.rank[parts[1]])
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens as they are when they stand side by side.

        Merges are undone from the latest back, following the two tokens at the border.  Had these been able to
        merge before the merge that was just undone, the border would not have lasted.
        """
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is not None:
            return known
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        a, b, before, fits = left, right, len(self.rank), True
        rank, token = self.rank, self.token
        while True:
            if rank.get(token[a] + token[b], before) < before:
                fits = False
                break
            if max(len(token[a]), len(token[b])) == 1:
                break
            if a > b:
                before, a = a, self.halves(a)[1]
            else:  # of two equal pairs the left one merges first
                before, b = b + 1, self.halves(b)[0]
        self.pairs[key] = fits
        return fits


class PrefixEncoder:
    """Growing bytes of one word with the unique valid last token of each prefix."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        data, last, v = bytes(self.data), self.last, self.vocabulary
        rank, longest, token, pairs = v.rank, v.longest, v.token, v.pairs
        for end in range(len(last), len(data) + 1):
            reach = longest.get(data[end - 3 : end], 2) if end > 2 else end
            for start in range(end - reach if reach < end else 0, end):
                right = rank.get(data[start:end])
                if right is not None:
                    left = last[start]
                    if left >= 0:
                        fits = pairs.get(left << 32 | right)
                        if fits is None:
                            fits = v.compatible(left, right)
                        if not fits:
                            continue
                    last.append(right)
                    break
            else:
                raise ValueError(f"no token for byte {data[end - 1]}")

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace bytes; prefixes before ``start`` stay, and so do those behind once they agree again.  Returns how
        many table entries were made anew."""
        tail, old = bytes(self.data[stop:]), self.last[stop + 1 :]
        del self.data[start:], self.last[start + 1 :]
        self.append(new)
        made, token = len(new), self.vocabulary.token
        reach = max(self.vocabulary.longest.values())
        same = 0
        for k in range(len(tail)):
            self.append(tail[k : k + 1])
            made += 1
            # entries equal over a token's longest reach, none of them reaching back into the edit, fix the rest
            same = same + 1 if self.last[-1] == old[k] and len(token[self.last[-1]]) <= k + 1 else 0
            if same >= reach:
                self.data += tail[k + 1 :]
                self.last += old[k + 1 :]
                break
        return made

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.token[self.last[end]])
        return out[::-1]


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary.of(path)
        self.words = WordCache(lambda word: PrefixEncoder(self.vocabulary, word.encode()).ids())

    @staticmethod
    @lru_cache(maxsize=2)
    def of(path: str) -> Codec:
        return Codec(path)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, split_words(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.token.__getitem__, ids))


def encode_decode(docs: DataFrame, ranks: str, keep: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again; digests of both, and with ``keep`` ids and bytes as well.

    ``docs`` needs doc_id and text; other columns are ignored.  A null text is empty: no tokens.  Rows stand for
    themselves, so repeated rows give repeated results and an empty table gives none.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded binary" if keep else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.of(ranks)
        decimal = codec.vocabulary.decimal.__getitem__
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = codec.encode(text or "")
                decoded = codec.decode(ids)
                row = (doc_id, len(ids), hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest())
                out.append((*row, np.array(ids, dtype=np.int32), decoded) if keep else row)
            columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if keep else 4]
            yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, schema)
