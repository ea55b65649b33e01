import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from tickframe.llm import byte_bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe(spark):
    return B.ByteBpe(spark, B.read_ranks(PATH), public_tokenizers.PATTERN)


def test_digests_same_as_the_library(docs, bpe, library):
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((str(r.doc_id), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = [(str(r.doc_id), *r[1:]) for r in B.digests(docs, bpe).collect()]
    assert sorted(got) == sorted(want)


def test_round_trip_keeps_columns(docs, no_docs, bpe, library):
    coded = bpe.decode(bpe.encode(docs))
    assert coded.columns == [*docs.columns, "ids", "bytes"]
    rows = coded.collect()
    assert len(rows) == docs.count()
    assert all(bytes(r.bytes).decode() == (r.text or "") and r.ids == library.encode_ordinary(r.text or "") for r in rows)
    assert bpe.decode(bpe.encode(no_docs)).count() == 0


def test_fold_and_merge_agree_with_the_library(spark, bpe, library):
    rng = random.Random(2)
    words = ["", "a", " the", "Übergröße", "日本語", "🙂🙂", " antidisestablishmentarianism", "    ", "=====", "12345"]
    words += ["".join(rng.choice("aeinrstäß") for _ in range(rng.randrange(1, 16))) for _ in range(60)]
    df = spark.createDataFrame([(w,) for w in words], "key string")
    folded = B._with_constants(df, {"ranks": bpe.ranks()}, lambda m: B.fold(B.F.col("key"), m["ranks"])).collect()
    ranks = {t: k for k, t in enumerate(bpe.tokens)}
    for r in folded:
        want = library._encode_single_piece(r.key.encode()) if r.key else []
        assert r.made == want and B.merge(r.key.encode(), ranks) == want
    for size in (65, 500, 20_000):
        for alphabet in ("a", "ab", "aeinrst"):
            word = "".join(rng.choice(alphabet) for _ in range(size))
            assert B.merge(word.encode(), ranks) == library._encode_single_piece(word.encode())


def test_no_word_is_left_out(docs, bpe, library, monkeypatch):
    """Without folded words, and with next to no memory of merged ones, every match gets the library's ids."""
    monkeypatch.setattr(B, "RECENT", 2)
    coder = B.Coder(bpe.tokens, bpe.pattern, [], [])
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        assert coder.encode(r.text) == struct.pack(f"<{len(ids)}I", *ids)
    ranks = {t: k for k, t in enumerate(bpe.tokens)}
    assert all(B.merge(t, ranks) == [k] == B._merge_long(t, ranks) for t, k in ranks.items())


def test_spaces_of_every_kind(spark, bpe, library):
    texts = ["a\x1c b\x85c\xa0 d　e\n\n f \t", "x   y  \n z\r\n", "it's WE'LL 'sa", "<|endoftext|> ok"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r.ids == library.encode_ordinary(r.text) for r in bpe.encode(df).collect())
