"""Packing against one-by-one best fit, and the codec against the tokenizer libraries."""

import base64
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers

from candela.llm import byte_bpe, packing
from candela.llm.byte_bpe import Codec, PrefixEncoder, Vocabulary, WordIds, split_words

RANKS, IDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "a  b\n\n c\t\td", "\x1c\x1fx \x85y\xa0z", "中文字 テスト 123４５ ½ ² ٣", "don't I'LL we're  's", "", " ", "\n", "a" * 3000, "👩‍👩‍👧  x", "  x　y",
    "if(x==1){\n    return;\n}\n\n\n", "  lead", "trail  ", "été—œuvre “q”…", "0123456789" * 50, "<|endoftext|>",
]


def random_texts(n):
    rng = random.Random(n)
    return ["".join(rng.choice("ab 'st\n\té0½.　the") for _ in range(60)) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_equals_the_library_and_goes_round(library):
    codec = Codec.of(RANKS)
    for text in TEXTS + random_texts(200):
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_word_ids_equal_the_tokenizer_file():
    whole = tokenizers.Tokenizer.from_file(IDS)
    whole.encode_special_tokens = True
    ids = WordIds.of(IDS)
    for text in TEXTS + random_texts(200):
        data = b"".join(map(ids.__getitem__, split_words(text)))
        assert np.frombuffer(data, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_every_token_and_random_pairs_follow_the_merges(library):
    v, piece, rng = Vocabulary.of(RANKS), library._core_bpe.encode_single_piece, random.Random(3)
    assert all(PrefixEncoder(v, v.token[t]).ids() == [t] for t in range(0, len(v.token), 7))
    for _ in range(20_000):
        a, b = rng.randrange(rng.choice([300, 2000, 50_256])), rng.randrange(rng.choice([300, 2000, 50_256]))
        word = v.token[a] + v.token[b]
        assert v.compatible(a, b) == (word not in v.rank and piece(word) == [a, b])


def test_appends_and_edits_equal_a_new_table():
    v, rng = Vocabulary.of(RANKS), random.Random(5)
    for _ in range(100):
        data = bytes(rng.choice(b"abcdefgh in tion") for _ in range(200))
        table = PrefixEncoder(v, data[:50])
        table.append(data[50:])
        assert table.last == PrefixEncoder(v, data).last
        i = rng.randint(0, 200)
        j, new = rng.randint(i, 200), bytes(rng.choice(b"xing ") for _ in range(rng.randint(0, 9)))
        made = table.edit(i, j, new)
        data = data[:i] + new + data[j:]
        assert bytes(table.data) == data and table.last == PrefixEncoder(v, data).last
        assert made <= len(new) + 200 - j
    long = PrefixEncoder(v, b"the quick brown fox " * 500)
    assert long.edit(100, 103, b"slow") < 1000  # only near the edit


def test_bounded_cache_keeps_answers(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_WORDS", 10)
    cache = byte_bpe.WordCache(lambda word: word.upper())
    assert [cache[w] for w in map(str, [*range(40), 3, 39])] == list(map(str, [*range(40), 3, 39]))
    assert len(cache) <= 10


def one_by_one(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= length]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= length
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([10, 20, 37])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        bins, ranks = defaultdict(list), defaultdict(list)
        for length, rank, many, first, offset in packing.best_fit_plan(Counter(lengths).items(), capacity):
            ranks[length] += range(rank, rank + many)
            for k in range(many):
                bins[first + k].append((offset, length))
        assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(n)) for x, n in Counter(lengths).items()}
        for pieces in bins.values():
            ends = [0, *np.cumsum([n for _, n in sorted(pieces)]).tolist()]
            assert [a for a, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= capacity
        assert sorted(capacity - sum(n for _, n in p) for p in bins.values()) == one_by_one(lengths, capacity)


def test_cut():
    for total in (1, 2047, 2048, 2049, 4096, 10_000):
        pieces = packing.cut(total, 2048)
        assert pieces[0][0] == 0 and sum(n for _, n in pieces) == total
        assert all(n == 2048 for _, n in pieces[1:]) and 0 < pieces[0][1] <= 2048


def test_pack_odd_rows(odd_docs, odd_rows, no_docs):
    rows = packing.pack(odd_docs, IDS).collect()
    whole = tokenizers.Tokenizer.from_file(IDS)
    whole.encode_special_tokens = True
    want = Counter()
    for i, text, _ in odd_rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.update((i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(packing.cut(len(ids), 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        ends = [0, *np.cumsum([n for _, n in sorted(pieces)]).tolist()]
        assert [a for a, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 2048
    assert len(by) == len(one_by_one([r.length for r in rows], 2048))
    assert packing.pack(no_docs, IDS).count() == 0


def test_encode_decode_odd_rows(odd_docs, odd_rows, no_docs, library):
    import hashlib

    got = byte_bpe.encode_decode(odd_docs, RANKS, keep=True).collect()
    want = Counter()
    for i, text, _ in odd_rows:
        ids = library.encode_ordinary(text or "")
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want[i, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert byte_bpe.encode_decode(no_docs, RANKS).count() == 0


def test_added_tokens_are_cut_out_as_the_library_does(spark):
    """By the library as it is called: no special tokens are added, but those in the text are taken as such."""
    whole = tokenizers.Tokenizer.from_file(IDS)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext", "<|ENDOFTEXT|>", "  <|endoftext|>  z", *TEXTS, *random_texts(100)]
    ids = WordIds(IDS)
    for text in texts:
        assert np.frombuffer(ids.text(text), dtype="<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    rows = packing.pack(spark.createDataFrame([(1, texts[0])], "doc_id bigint, text string"), IDS).collect()
    want = np.array([64, 220, 50256, 275, packing.END], dtype="<u4").tobytes()
    assert [(r.length, r.ids_crc32) for r in rows] == [(5, zlib.crc32(want))]
