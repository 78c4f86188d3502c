"""MaxScore meets only the rows in postings of essential terms."""

import numpy as np

from latticework.llm import topk


def brute(ids, impacts, own, query, k=5):
    scores = sorted((-sum(int(a) * int(b) for a, b in zip(query, v, strict=True)), int(i)) for i, v in zip(ids, impacts, strict=True) if i != own)
    return [(i, -s) for s, i in scores[:k]]


def test_sparse_vectors_are_not_met_in_full():
    """A row has 6 of 60 terms; queries share terms with few rows."""
    rng = np.random.default_rng(1)
    impacts = np.zeros((800, 60), np.int64)
    for row in impacts:
        row[rng.choice(60, 6, replace=False)] = rng.integers(1, 200, 6)
    ids = rng.permutation(5_000)[:800]
    shard = topk.Shard(ids, impacts)
    for k in range(40):
        got = list(zip(*(x.tolist() for x in shard.top(impacts[k], int(ids[k]), 5)), strict=True))
        assert got == brute(ids, impacts, ids[k], impacts[k])
    assert 0 < shard.met < 0.4 * shard.held


def test_every_number_of_essential_terms():
    """Dense vectors: many terms are essential, the traversal runs all the same."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-300, 300, (4, 48))
    impacts = np.concatenate([c + rng.integers(-3, 4, (60, 48)) for c in centres])
    ids = np.arange(len(impacts))
    shard = topk.Shard(ids, impacts)
    for k in range(0, len(ids), 7):
        got = list(zip(*(x.tolist() for x in shard.top(impacts[k], k, 5)), strict=True))
        assert got == brute(ids, impacts, k, impacts[k])
    assert 0 < shard.met <= shard.held


def test_components_up_to_a_long(spark):
    rows = [(50, [float(1 << 54), 0.0]), (51, [1 / 256, 3.0]), (52, [0.0, 1.0]), (53, [-float(1 << 55), 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.embedding_top_k(frame).orderBy("rank").collect()]
    assert got == [(51, 1 << 62), (52, 0), (53, -((1 << 63) - 1))]


def test_repeated_ids(spark):
    rows = [(50, [1.0, 2.0]), (50, [1.0, 2.0]), (7, [3.0, 1.0]), (7, [3.0, 1.0]), (8, [0.0, 1.0])]
    got = topk.embedding_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(50, 1, 7), (50, 2, 7), (50, 3, 8)]
