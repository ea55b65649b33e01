import random
import re

import numpy as np
import pytest

from tickframe.llm import ngram_join as J
from tickframe.llm import sets


def shingles(text, size=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1)))


def brute(rows):
    """All pairs compared."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[find(k)] = min(i, names.get(find(k), i))
    return sorted(((i, len(sets[k]), names.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)),
                  key=lambda t: tuple(map(str, t)))


def corpus(seed=3):
    """Groups of near copies, texts of one template near the threshold, shared passages, short texts."""
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(300)]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    out, template, passage = [], prose(120), prose(60)
    for n in (4, 5, 7, 8, 9, 10, 13, 30, 64, 128, 300, 1500):
        base = prose(n)
        for edits in (0, 0, 1, 1, 2, 3, max(1, n // 40), max(1, n // 30), max(1, n // 25)):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = f"own{rng.random()}"
            out.append(words + prose(rng.choice([0, 0, 0, 1, n // 12])))
    for k in range(40):
        out.append(template + prose(rng.randrange(4, 22)))
    for k in range(25):
        out.append(prose(30) + passage + prose(rng.randrange(5, 60)))
    for k in range(30):  # one large group with few changes each
        words = list(template) + prose(80)[:0] + passage
        words[rng.randrange(len(words))] = "changed"
        out.append(words)
    rng.shuffle(out)
    return [(k, " ".join(w)) for k, w in enumerate(out)]


@pytest.mark.parametrize("classes", [J.CLASSES, (3, 12), (2, 3)])
def test_equals_all_pairs(spark, rows, classes):
    data = corpus()
    made = rows(J.groups(spark.createDataFrame(data, "doc_id long, text string").repartition(2), classes=classes))
    want = brute(data)
    assert made == want
    sizes = [c for _, _, c in want]
    assert max(map(sizes.count, sizes)) > 20


def test_edge_cases(docs, no_docs, rows):
    data = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows(J.groups(docs)) == brute(data)
    assert J.groups(no_docs).count() == 0


def test_signatures_never_miss():
    """Any two alike sets share a signature whose reaches allow them, under any classes."""
    rng = np.random.default_rng(5)
    for trial in range(600):
        n = int(rng.integers(1, 260))
        base = rng.choice(2**40, n + 80, replace=False).astype(np.uint64)
        t = J.errors(n)
        a = np.sort(base[:n])
        gone, new = int(rng.integers(0, t + 1)), int(rng.integers(0, t + 2))
        b = np.sort(np.concatenate([base[gone:n], base[n:n + new]]))
        both, total = n - gone, len(a) + len(b)
        if both * 185 < total * 85 or (a == b).all() if len(a) == len(b) else both * 185 < total * 85:
            continue
        often = np.sort(rng.choice(base, int(rng.integers(0, len(base))), replace=False))
        f = J.Frequent(often, rng.integers(1, 40, len(often)), (10, 25))
        (sa, ra), (sb, rb) = J.signatures(a, f), J.signatures(b, f)
        best = {}
        for s, r in zip(sa.tolist(), ra.tolist()):
            best[s] = max(r, best.get(s, 0))
        ok = [min(best[s], r) for s, r in zip(sb.tolist(), rb.tolist()) if s in best]
        assert ok and max(ok) * 185 >= total * 85, (trial, n, gone, new)


def test_parities_never_rule_out_too_much():
    rng = np.random.default_rng(8)
    for n in (6, 40, 127, 128, 300, 1023, 1024, 5000):
        base = rng.integers(0, 2**63, n + n // 6 + 1).astype(np.uint64)
        a, b = np.unique(base[:n]), np.unique(base[n // 12:])
        x, y = (sets.parities(s).view(np.uint64) for s in (a, b))
        if len(x) != len(y):
            x, y = sorted((x, y), key=len)
            y = y[:len(x)] ^ y[len(x):]
        assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))


def test_counts_are_low_by_little():
    rng = np.random.default_rng(1)
    stream = np.concatenate([np.repeat(np.arange(5, dtype=np.uint64), 400), rng.integers(10, 4000, 6000).astype(np.uint64)])
    rng.shuffle(stream)
    held = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for part in np.split(stream, 16):
        held = J.merged_counts([held, (part, np.ones(len(part), np.int64))], 100)
    seen = dict(zip(held[0].tolist(), held[1].tolist()))
    assert len(seen) <= 100 and all(400 - len(stream) / 100 <= seen[k] <= 400 for k in range(5))


def copies_of_one(seed=4):
    """A text and copies of it with one to four words changed."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(150)]
    out = [base]
    for edits in (1, 2, 3, 4):
        for _ in range(50):
            words = list(base)
            for k in rng.sample(range(5, 145, 7), edits):
                words[k] = f"own{rng.random()}"
            out.append(words)
    rng.shuffle(out)
    return [(k, " ".join(w)) for k, w in enumerate(out)]


@pytest.mark.parametrize("classes", [J.CLASSES, (20, 100_000)])
def test_copies_of_one_text_are_not_paired(spark, rows, monkeypatch, classes):
    """Copies are compared with the text they come from; rare tokens of both sides rule out what is farther."""
    compared, verified = [], J.verified

    def counting(docs, tokens, pairs, *more):
        compared.append(pairs.distinct().count())
        return verified(docs, tokens, pairs, *more)

    monkeypatch.setattr(J, "verified", counting)
    data = copies_of_one()
    assert rows(J.groups(spark.createDataFrame(data, "doc_id long, text string"), classes=classes)) == brute(data)
    assert sum(compared) < 4 * len(data)


def test_combinations_reach_no_rare_token():
    found = np.arange(1, 148, dtype=np.uint64)
    often = np.arange(13, 148, dtype=np.uint64)  # twelve tokens are rare
    sigs, reach = J.signatures(found, J.Frequent(often, np.full(135, 20), (10, 15)))
    assert len(sigs) > 12 and reach[:12].tolist() == list(range(147, 135, -1)) and reach[12:].max() <= 135
