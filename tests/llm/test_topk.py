from __future__ import annotations

import math
import random

import numpy as np
import pytest

from lumenspark.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k):
    ints = lambda v: None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(64 * float(np.float32(x))) for x in v]
    known = [(i, ints(v)) for i, v in rows]
    out = set()
    for q, v in {(q, tuple(ints(v))) for q, v in queries if ints(v) is not None}:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in known if w is not None and i != q and len(w) == len(v))
        out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize(("n", "dim", "scale", "block"), [(700, 8, 1.0, 8192), (300, 3, 0.02, 64), (15, 4, 1.0, 8192), (400, 4, 1e7, 8192), (900, 2, 1.0, 200)])
def test_equals_brute_force(spark, n, dim, scale, block):
    rng = random.Random(n)
    rows = [(i, [rng.gauss(0, scale) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(60)]
    rows += [(n + 100, None), (n + 101, [1.0] * (dim - 1) + [None]), (n + 120, [math.nan] * dim), (n + 140, [math.inf] * dim), (n + 160, [1.0] * (dim + 1)), (n + 180, [0.0] * dim)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), k=7, query_block=block, row_block=block)
    assert {tuple(r) for r in got.collect()} == brute(rows, [(i, v) for i, v in rows if i % 20 == 0], 7)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(df, df).count() == 0


def test_pruning_happens():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (20, 8)) * 400
    x = np.floor(np.repeat(centres, 400, 0) + rng.normal(0, 3, (8000, 8))).astype(np.int64)
    s = topk.Search(x[::400], np.arange(0, 8000, 400), x, np.arange(8000), 5)
    s.run()
    scores = x[::400] @ x.T
    scores[np.arange(20), np.arange(0, 8000, 400)] = -(1 << 60)
    assert (s.score == -np.sort(-scores, 1)[:, :5]).all()
    t = topk.Search(x, np.arange(8000), x, np.arange(8000), 5)
    t.run()
    leaves = lambda n: sum(map(leaves, n.children)) if n.children else 1
    assert t.pairs < 0.2 * leaves(topk.build(x.astype(float))) ** 2


def test_nets_cover_and_separate():
    x = np.random.default_rng(2).normal(0, 1, (3000, 5)) * 50
    distance = lambda a, b: np.sqrt(((a - b) ** 2).sum(-1))

    def look(node):
        assert distance(x[node.points], node.centre).max() <= node.radius
        if node.children:
            centres = np.stack([c.centre for c in node.children])
            assert node.scale <= node.radius and (centres[0] == node.centre).all()
            apart = distance(centres[:, None], centres[None]) + np.eye(len(centres)) * 1e9
            assert apart.min() >= node.scale - 1e-9 and all(c.radius <= node.scale * (1 + 1e-9) + 1e-9 for c in node.children)
            assert sorted(np.concatenate([c.points for c in node.children]).tolist()) == sorted(node.points.tolist())
            for c in node.children:
                look(c)

    look(topk.build(x))


def test_floors_keep_ties_and_prune():
    rng = np.random.default_rng(4)
    x = rng.integers(-50, 50, (2000, 3))
    free, bound = topk.Search(x[:50], np.arange(50), x, np.arange(2000), 5), None
    free.run()
    bound = topk.Search(x[:50], np.arange(50), x, np.arange(2000), 5, free.score[:, -1])
    bound.run()
    assert (free.score == bound.score).all() and (free.found == bound.found).all() and bound.pairs <= free.pairs
