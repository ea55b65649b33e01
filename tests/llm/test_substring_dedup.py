import hashlib
import re
from collections import Counter

from tickframe.llm import substring_dedup as S


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def expected(rows):
    """Brute force over every window of every row."""
    first = {}
    for doc_id, text in rows:
        w = words(text)
        for k in range(len(w) - 49):
            key = tuple(w[k:k + 50])
            if doc_id is not None:
                first[key] = min(first.get(key, doc_id), doc_id)
    out = Counter()
    for doc_id, text in rows:
        w = words(text)
        gone = set()
        for k in range(len(w) - 49):
            if doc_id is not None and first[tuple(w[k:k + 50])] < doc_id:
                gone |= set(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def test_same_as_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in S.digests(docs).collect()) == expected(rows)


def test_windows_that_straddle_blocks_of_different_documents(spark):
    """A window is found although no single earlier document is the first for all of its seeds."""
    import random

    rng = random.Random(1)
    a, b, c = ([f"{p}{rng.randrange(10**6)}" for _ in range(40)] for p in "abc")
    texts = [" ".join(a + c), " ".join(c + b), " ".join(a + b + c), " ".join(c + a + b), " ".join(b + c + a)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in S.digests(df).collect()) == expected(rows)


def test_cut_texts_keep_everything_else(docs):
    before = {(r.doc_id, r.text): r for r in docs.collect()}
    after = S.without_repeats(docs)
    assert after.columns == docs.columns and after.count() == docs.count()
    digests = {(r.doc_id, r.n_removed) for r in S.digests(docs).collect()}
    whole = {d for d, n in digests if n == 0}
    for r in after.collect():
        if r.doc_id in whole or r.doc_id is None:
            assert (r.doc_id, r.text) in before
        else:
            assert r.n_chars == len(r.text)


def test_empty_table(no_docs):
    assert S.digests(no_docs).collect() == [] and S.without_repeats(no_docs).collect() == []
