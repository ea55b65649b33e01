import hashlib
import math
import random

import numpy as np
import pytest

from tickframe.llm import pivot_codes as C

LAYOUT = "vec_id long, embedding array<float>, label int, code string"


def brute(rows, parts=4, entries=256, rounds=4):
    """Every distance of every round, in plain numbers."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label, *_ in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((i, v) for i, v, _ in kept if i is not None)[:entries]
    d = len(kept[0][1]) // parts

    def part(v, j):
        return v[j * d:(j + 1) * d]

    books = [[part(v, j) for _, v in first] for j in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for j in range(parts):
            owned = {}
            for _, v, _ in kept:
                owned.setdefault(near(part(v, j), books[j])[1], []).append(part(v, j))
            for k, own in owned.items():
                books[j][k] = [sum(c) // len(own) for c in zip(*own)]
    out, labels = [], {}
    for i, v, label in kept:
        found = [near(part(v, j), books[j]) for j in range(parts)]
        error = sum(e for e, _ in found)
        labels[label] = labels.get(label, 0) + error
        out.append([i, "".join(f"{k:02x}" for _, k in found), error, label])
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, labels[label], digest) for i, c, e, label in out), key=lambda t: tuple(map(str, t)))


def vectors(n, width=8, seed=5):
    rng = random.Random(seed)
    return [(k, [rng.gauss(0, 0.4) for _ in range(width)], rng.choice([1, 2, None])) for k in range(n)]


def frame(spark, rows):
    exact = [(i, v and [None if x is None else float(np.float32(x)) for x in v], label, "x") for i, v, label in rows]
    return exact, spark.createDataFrame(exact, LAYOUT).repartition(3)


def test_equals_brute_force(spark, rows):
    data = vectors(400)
    data += [(500, None, 1), (501, [None] + [0.1] * 7, 1), (502, [float("nan")] + [0.1] * 7, 1), (503, [], 1),
             (504, [float("inf")] * 8, 2), (None, [0.2] * 8, None), (7, [-0.9] * 8, 3), data[3], data[3]]
    data += [(600 + k, [0.001953125 * (k % 2)] * 8, 9) for k in range(30)]  # ties between equal entries
    exact, df = frame(spark, data)
    assert rows(C.digests(df)) == brute(exact)


def test_fewer_vectors_than_entries(spark, rows):
    for n in (1, 5):
        exact, df = frame(spark, vectors(n))
        assert rows(C.digests(df)) == brute(exact)


def test_no_vectors(spark):
    _, df = frame(spark, [(1, None, 1)])
    assert C.digests(df).count() == 0
    assert C.digests(df.limit(0)).count() == 0


def test_other_lengths_raise(spark):
    for odd in ([0.1] * 6, [0.1] * 12):
        _, df = frame(spark, [*vectors(3), (9, odd, 1)])
        with pytest.raises(Exception, match="length"):
            C.digests(df).count()
    _, df = frame(spark, vectors(3, width=6))
    with pytest.raises(ValueError, match="equal parts"):
        C.digests(df)
    _, df = frame(spark, [(1, [1e9] * 8, 1)])
    with pytest.raises(Exception, match="component"):
        C.digests(df).count()


def test_pruning_is_exact_and_prunes():
    rng = np.random.default_rng(3)
    centres = rng.integers(-3000, 3000, (40, 16))
    parts = centres[rng.integers(0, 40, 3000)] + rng.integers(-40, 40, (3000, 16))
    entries = np.concatenate([centres, centres[:5], parts[:100]])  # equal entries: ties to the lower index
    pivots = C.pivots_of(entries)
    found = C.nearest(parts, C.pivot_distances(parts, pivots), entries, pivots)
    far = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (found.entry == far.argmin(axis=1)).all() and (found.error == far.min(axis=1)).all()
    assert found.tried < 0.5 * far.size
