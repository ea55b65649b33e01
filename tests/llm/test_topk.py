import math
import re

import numpy as np
import pytest

from tickframe.llm import topk as K


def brute(rows, k, every):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
              if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in usable if i % every == 0}):
        own = min(v for i, v in usable if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in usable if i != q and len(v) == len(own))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return out


def test_same_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(K, "SHARD", 70)
    monkeypatch.setattr(K, "BLOCK", 3)
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(0, 0.2, 8).tolist()) for k in range(300)]
    rows += [(300 + k, rows[k][1]) for k in range(20)]                      # ties
    rows += [(0, rows[0][1]), (7, rows[0][1]), (330, rows[5][1])]           # repeated ids and rows
    rows += [(400, None), (410, []), (420, [None] * 8), (430, [float("nan")] * 8), (440, [float("inf")] * 8), (None, rows[1][1]), (450, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", K.F.lit(1))
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, K.search(df, 5, 10).collect())) == brute(rows, 5, 10)


def test_few_candidates_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], schema)
    assert sorted(map(tuple, K.search(df).collect())) == [(0, 1, 1, 131072), (0, 2, 2, 131072)]
    assert K.search(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    assert K.search(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("n,dims", [(1, 1), (5, 3), (400, 16)])
def test_index_is_exact(n, dims):
    rng = np.random.default_rng(n)
    vectors = rng.integers(-3, 4, (n, dims)) if n < 100 else rng.integers(-100, 100, (n, dims))
    ids = rng.permutation(n)
    index = K.Index(ids, vectors)
    for _ in range(10):
        q = rng.integers(-5, 6, dims)
        at, scores = index.search(q, 4, int(ids[0]))
        want = sorted((-int(v @ q), int(i)) for i, v in zip(ids, vectors) if i != ids[0])[:4]
        assert [(-int(s), int(index.ids[a])) for a, s in zip(at, scores)] == want


@pytest.mark.parametrize("largest", [100, 1 << 13, 1 << 28])
def test_a_block_of_queries_is_exact(largest):
    """Each query of a block as if it were alone, with sums that need 24, 53 and more bits."""
    rng = np.random.default_rng(largest)
    vectors, queries = (rng.integers(-largest, largest, (n, 12)) for n in (500, 30))
    queries[3], queries[4, 1:], vectors[:40] = 0, 0, vectors[40]
    ids, barred = rng.permutation(500), rng.integers(0, 600, 30)
    index = K.Index(ids, vectors)
    for q, own, (at, scores) in zip(queries, barred, index.search_block(queries, 4, barred)):
        want = sorted((-int(v @ q), int(i)) for i, v in zip(ids, vectors) if i != own)[:4]
        assert [(-int(s), int(index.ids[a])) for a, s in zip(at, scores)] == want


def test_searches_stop_on_proof(monkeypatch):
    """Most queries are done before their last segments are read."""
    rng = np.random.default_rng(1)
    index = K.Index(np.arange(2000), rng.normal(0, 40, (2000, 16)).astype(np.int64))
    queries, barred = index.vectors[:50], np.arange(50)
    whole = index.search_block(queries, 5, barred)
    monkeypatch.setattr(K, "LEFT", K.LEFT[:-1])  # without the last look, at which all is read
    early = index.search_block(queries, 5, barred)
    done = [q for q, (at, _) in enumerate(early) if len(at)]
    assert len(done) > 25 and all(early[q][0].tolist() == whole[q][0].tolist() for q in done)


def test_candidates_are_not_copied_for_every_block(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 1)
    monkeypatch.setattr(K, "BLOCKS", 50)
    df = spark.createDataFrame([(k, [float(k % 7), 1.0]) for k in range(400)], "vec_id long, embedding array<float>")
    plan = K.search(df, 5, 1)._jdf.queryExecution().optimizedPlan().toString()
    copies = int(re.search(r"pmod\(xxhash64\(id#\d+L, 42\), (\d+)\) as int", plan)[1])  # by which queries are dealt out
    assert copies == max(400 // 50, 2 * spark.sparkContext.defaultParallelism)
