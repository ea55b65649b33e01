import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tickframe.llm import ngram_lm as L


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute(rows, head, prior):
    """(n_tokens, n_known, base, score) per row from plain counts; ``head`` most frequent words have numbers."""
    train = [tokens(r.text) for r in rows if not held_out(r.doc_id)]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    words = sorted((w for w in c if w is not None), key=lambda w: (-c[w], w))
    least = c[words[head]] + 1 if len(words) > head else 1
    numbered = {w for w in words if c[w] >= least}
    name = lambda w: w if w is None or w in numbered else "class"
    pairs, left = Counter(), Counter()
    for t in train:
        s = ["start", *map(name, t)]
        pairs.update(zip(s, s[1:]))
        left.update(s[:-1])
    p1 = lambda w: (c[w] + 1) / (n + v + 1)
    p_class = (sum(c[w] + 1 for w in words if w not in numbered) + 1) / (n + v + 1)
    out = []
    for r in rows:
        t, score, before = tokens(r.text), 0.0, "start"
        for w in t:
            low = p_class if name(w) == "class" else p1(w)
            score += math.log10((pairs[before, name(w)] + prior * low) / (left[before] + prior))
            if name(w) == "class":
                score += math.log10(p1(w) / p_class)
            before = name(w)
        out.append((str(r.doc_id), held_out(r.doc_id), len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(p1(w)) for w in t), score))
    return out


@pytest.mark.parametrize("head,hot,entries", [(1 << 18, 256, 2_000_000), (50, 8, 500)])
def test_same_as_plain_counts(docs, monkeypatch, head, hot, entries):
    monkeypatch.setattr(L, "HEAD", head)
    monkeypatch.setattr(L, "HOT", hot)
    monkeypatch.setattr(L, "SHARD_ENTRIES", entries)
    rows = docs.select("doc_id", "text").collect()
    got = sorted((str(r.doc_id), *r[1:]) for r in L.score(docs).collect())
    want = sorted(brute(rows, head, L.PRIOR))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-12)
    # Probabilities are quantised in steps of CODE.
    assert all(abs(g[6] - w[6]) <= L.CODE * w[2] for g, w in zip(got, want))


def test_model_sums_to_one():
    counts = np.array([0, 5, 5, 9, 4, 1.0])
    uni = L.Unigrams(counts, n=30, v=7)
    p1 = uni.p1(held=11, held_words=3)
    assert abs(p1.sum() - 1) < 1e-12


def test_elias_fano_and_trie():
    rng = np.random.default_rng(0)
    for universe, n in ((50, 40), (1 << 20, 1000), (1 << 40, 3000), (10, 0)):
        values = np.sort(rng.integers(0, universe, n)).astype(np.uint64)
        seq = L.EliasFano(values, universe)
        seq.open(*seq.arrays())
        assert (seq.get(np.arange(n)) == values).all()
        asked = rng.integers(0, universe, 500).astype(np.uint64)
        assert (seq.successor(asked) == np.searchsorted(values, asked)).all()
    keys = np.unique(rng.integers(0, 1 << 12, 700) << L.BITS | rng.integers(0, 1 << 10, 700))
    u, w, logs = keys >> L.BITS, keys & ((1 << L.BITS) - 1), -rng.random(len(keys)) * 9
    trie = L.Trie(u, w, logs)
    assert np.abs(trie.log_p(u, w) - logs).max() <= L.CODE
    missing = np.isnan(trie.log_p(u, w + (1 << 11)))
    assert missing.all() and np.isnan(trie.log_p(np.array([1 << 15]), np.array([1]))).all()
    assert np.isnan(L.Trie(u[:0], w[:0], logs[:0]).log_p(u, w)).all()


def test_packing():
    codes = np.array([3, 3 << 40, (3 << 40) + 1], np.uint64)
    got = L.unpack(L.pack(codes, np.array([1, 70_000, 2])))
    assert (got[0] == codes).all() and got[1].tolist() == [1, 70_000, 2]


def test_no_training_and_no_documents(spark, no_docs):
    ids = [k for k in range(60) if held_out(k)][:3]
    df = spark.createDataFrame([(k, "some words") for k in ids], "doc_id long, text string")
    assert all((r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0) for r in L.score(df).collect())
    assert L.score(no_docs).count() == 0


def brute_whole(rows, prior):
    """Scores from plain counts of all pairs of words."""
    train = [tokens(r.text) for r in rows if not held_out(r.doc_id)]
    c, pairs, left = Counter(w for t in train for w in t), Counter(), Counter()
    n, v = sum(c.values()), len(c)
    for t in train:
        pairs.update(zip(["start", *t], t))
        left.update(["start", *t][:-1])
    out = []
    for r in rows:
        t = tokens(r.text)
        out.append((str(r.doc_id), held_out(r.doc_id), len(t), sum(c[w] > 0 for w in t), n,
                    sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t),
                    sum(math.log10((pairs[u, w] + prior * (c[w] + 1) / (n + v + 1)) / (left[u] + prior)) for u, w in zip(["start", *t], t))))
    return out


@pytest.mark.parametrize("head", [0, 50, 1 << 18])
def test_pairs_of_words_without_a_number_are_counted(docs, monkeypatch, head):
    monkeypatch.setattr(L, "HEAD", head)
    monkeypatch.setattr(L, "HOT", 8)
    monkeypatch.setattr(L, "SHARD_ENTRIES", 500)
    got = sorted((str(r.doc_id), *r[1:]) for r in L.score(docs, whole=True).collect())
    want = sorted(brute_whole(docs.select("doc_id", "text").collect(), L.PRIOR))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-12)
    assert all(abs(g[6] - w[6]) <= L.CODE * w[2] for g, w in zip(got, want))
