import random

import numpy as np
import xxhash

from tickframe.llm import simhash as H


def brute_print(text, size=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k:k + size]) for k in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, radius):
    """Smallest position reachable over pairs within the radius."""
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(prints))]


def test_groups_same_as_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_print(r.text) for r in rows]
    roots = brute_groups(prints, 2)
    names = {}
    for root, r in zip(roots, rows):
        if r.doc_id is not None:
            names[root] = min(names.get(root, r.doc_id), r.doc_id)
    want = sorted((str(r.doc_id), f"{p:016x}", names.get(root)) for r, p, root in zip(rows, prints, roots))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in H.groups(docs).collect()) == want


def clustered(n, seed=3):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(n // 20)]
    out = set()
    while len(out) < n:
        p = rng.choice(centres)
        for _ in range(rng.randrange(6)):
            p ^= 1 << rng.randrange(64)
        out.add(p)
    return sorted(out)


def test_local_links_connect_exactly_what_is_connected():
    for radius in (2, 5):
        points = clustered(1500)
        pairs = H.local_links(np.array(points, dtype=np.uint64), radius)
        assert all((points[a] ^ points[b]).bit_count() <= 64 for a, b in pairs)
        label = list(range(len(points)))

        def find(x):
            while label[x] != x:
                x = label[x]
            return x

        for a, b in pairs:
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
        assert [find(k) for k in range(len(points))] == brute_groups(points, radius)


def test_linked_points_meet_in_a_shard():
    points = np.array(clustered(3000, 5), dtype=np.uint64)
    tree = H.build_tree(points[::3], 16, 2)
    met = set()
    for _, own in H.route(points, tree, 2):
        near = np.bitwise_count(points[own][:, None] ^ points[own][None, :]) <= 2
        met |= {(int(own[a]), int(own[b])) for a, b in zip(*np.nonzero(near))}
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 2
    assert tree is not None and met == {(int(a), int(b)) for a, b in zip(*np.nonzero(near))}


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201)]
    got = {r.node: r.root for r in H.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}


def test_one_per_group(docs, no_docs):
    kept = H.one_per_group(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns
    assert 14 in ids and 15 not in ids and ids.count(11) == 1 and ids.count(None) == 2
    assert {9, 10, 13, 20} <= set(ids)
    assert H.one_per_group(no_docs).count() == 0 and H.groups(no_docs).count() == 0


def test_one_per_group_finds_every_pair_of_similarity_08(spark):
    rng = random.Random(21)
    texts = []
    for k in range(60):  # pairs at 0.75 to 0.95, by words changed in one place or in several
        words = [f"q{rng.randrange(5000)}" for _ in range(rng.randrange(80, 240))]
        other = list(words)
        for p in rng.sample(range(len(words)), max(1, round(len(words) * rng.uniform(0.005, 0.03)))):
            other[p] = "changed"
        texts += [" ".join(words), " ".join(other)]
    common = [f"line{k}" for k in range(30)]
    texts += [" ".join(common + [f"z{rng.randrange(5000)}" for _ in range(60)]) for _ in range(40)]
    sets = [set(H.shingle_hashes(t, 5).tolist()) for t in texts]
    alike = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))
             if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert len(alike) > 20
    kept = {r.doc_id for r in H.one_per_group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in alike:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    # Nothing alike is missed, and nothing below 0.8 is joined except through others.
    assert kept == {i for i in range(len(texts)) if find(i) == i}


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(1, a, "x"), (1, b, "y"), (1, a.upper(), "z"), (2, b, "w"), (3, "alone " + a[:40], "v"), (3, a, "u"), (None, a, "n"), (None, a, "n")]
    kept = H.one_per_group(spark.createDataFrame(rows, "doc_id long, text string, key string")).collect()
    assert sorted((str(r.doc_id), r.key) for r in kept) == [("1", "y"), ("1", "z"), ("3", "v"), ("None", "n"), ("None", "n")]


def test_order_counts_all_documents(spark):
    """The order of shingles comes from all documents, however many there are."""
    docs = spark.range(60_000).selectExpr("id AS doc_id", "concat('a b ', id % 20000) AS text")
    held, counts = H.frequent_shingles(docs, 2)
    n = dict(zip(held.tolist(), counts.tolist()))
    assert n[xxhash.xxh64_intdigest(b"a b", 42)] == 60_000


def test_rare_shingles_come_first():
    found = np.arange(1, 11, dtype=np.uint64)
    counts = np.array([9, 8, 1], np.int64)
    assert H._prefix(found, (found[:3], counts)).tolist() == [4, 5, 6]
    assert H._prefix(found, (found[:9], np.arange(19, 10, -1))).tolist() == [10, 9, 8]


def test_copies_of_one_text_meet_it_first(spark, monkeypatch):
    """Every copy is alike to the text it comes from, so few pairs of copies are compared or linked."""
    rng = random.Random(6)
    base = [f"b{k}" for k in range(150)]
    texts = [base]
    for edits in (1, 2, 3, 4):
        for _ in range(50):
            words = list(base)
            for k in rng.sample(range(6, 144, 8), edits):
                words[k] = f"own{rng.random()}"
            texts.append(words)
    rng.shuffle(texts)
    compared, linked, verified = [], [], H.verified

    def counting(docs, tokens, pairs, *more):
        found = verified(docs, tokens, pairs, *more)
        compared.append(pairs.distinct().count())
        linked.append(found.count())
        return found

    monkeypatch.setattr(H, "verified", counting)
    sets = [{tuple(t[k:k + 5]) for k in range(146)} for t in texts]
    data = [(k, " ".join(t)) for k, t in enumerate(texts)]
    kept = sorted(r.doc_id for r in H.one_per_group(spark.createDataFrame(data, "doc_id long, text string")).collect())
    at = texts.index(base)
    alike = {k for k, s in enumerate(sets) if 5 * len(s & sets[at]) >= 4 * len(s | sets[at])}
    assert len(alike) > 100 and kept == sorted({min(alike)} | (set(range(len(texts))) - alike))
    assert sum(compared) < 6 * len(texts) and sum(linked) < 3 * len(texts)
