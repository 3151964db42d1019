import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k):
    good = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, v in good:
        if q % 5 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "block"), [(8192, 8192), (16, 8)])
def test_against_brute_force(spark, shard, block, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "ROWS", 3)
    monkeypatch.setattr(topk, "FAN", 3)
    rng = random.Random(9)
    rows = [(i, [rng.randrange(-8, 8) / 8 for _ in range(6)]) for i in range(200)]
    rows += [(300 + i, [0.5] * 6) for i in range(20)] + [(400, None), (401, [None] * 6), (402, [float("nan")] * 6), (403, [float("inf")] + [0.0] * 5), (None, [0.1] * 6), (405, []), (410, [0.1, 0.2]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 5 == 0, 5).collect())
    assert got == brute(rows, 5)


def test_large_components_stay_exact(spark):
    rows = [(0, [1e7, 1.0]), (1, [1e7, 1 / 256]), (2, [1e7, 0.0]), (3, [-1e7, 5.0])]
    got = [(r.vec_id, r.score) for r in topk.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0, 5).orderBy("rank").collect()]
    f = [[math.floor(256 * x) for x in v] for _, v in rows]
    assert got == sorted(((i, sum(a * b for a, b in zip(f[0], f[i]))) for i in (1, 2, 3)), key=lambda x: (-x[1], x[0]))


def test_few_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(0, [1.0]), (5, [2.0])], SCHEMA).withColumns({c: F.lit(1) for c in ("shard", "block", "v", "q", "score", "rank", "query_id", "top", "label")})
    assert sorted((r.query_id, r.rank, r.vec_id) for r in topk.search(df, F.col("vec_id") % 5 == 0).collect()) == [(0, 1, 5), (5, 1, 0)]
    assert topk.search(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_scores_beyond_a_long_are_an_error():
    big = np.full((1, 3), 2**62, np.int64)
    with pytest.raises(OverflowError):
        topk._product(big, big)
    assert topk._product(big, np.array([[1, -1, 1]])).tolist() == [[2**62]]
