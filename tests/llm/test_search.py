import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlog.llm.ann import build, nearest, search


def brute(ids, x, query, k):
    at = list(ids).index(query)
    scores = x @ x[at]
    keep = [i for i in range(len(ids)) if ids[i] != query]
    return sorted(((-scores[i], ids[i]) for i in keep))[:k]


def frame(spark, ids, x):
    rows = [(int(i), None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in zip(ids, x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_recall_and_scores(spark, spread):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(3000, 24)) * np.exp(spread * draw.normal(size=(3000, 1)))
    x[100:130] = x[100]  # ties
    ids = draw.permutation(3000)
    got = nearest(frame(spark, ids, x), F.col("vec_id") % 20 == 0, block_rows=700).collect()
    rows = {}
    for r in got:
        rows.setdefault(r.query_id, []).append(r)
    assert sorted(rows) == sorted(i for i in ids if i % 20 == 0)
    recall = []
    for q, found in rows.items():
        found.sort(key=lambda r: r.rank)
        want = brute(ids, x, q, 20)
        assert [r.rank for r in found] == list(range(1, 21))
        place = {v: k for k, v in enumerate(ids)}
        for r in found:
            assert abs(r.score - x[place[r.vec_id]] @ x[place[q]]) < 1e-9 * max(1, abs(r.score))
        keys = [(-r.score, r.vec_id) for r in found]
        assert keys == sorted(keys)
        recall.append(len({r.vec_id for r in found} & {i for _, i in want}) / 20)
    assert np.mean(recall) >= 0.9


def test_few_rows_and_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    x = [[1, 0], [0, 1], [1, 1], [0, 0], None, [nan, 1], [inf, 1], [1, None], [], [1, 2, 3]]
    got = nearest(frame(spark, [20, 1, 2, 40, 60, 80, 100, 120, 140, 160], x), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got)] == [(20, 1, 2, 1.0), (20, 2, 1, 0.0)]
    empty = frame(spark, [1], [[1.0, 2.0]]).limit(0)
    assert nearest(empty, F.col("vec_id") % 20 == 0).collect() == []
    assert nearest(frame(spark, [1], [[1.0, 2.0]]), F.col("vec_id") % 20 == 0).collect() == []


def test_repeated_rows_are_queries_and_candidates(spark):
    got = nearest(frame(spark, [20, 20, 1], [[1, 0], [1, 0], [2, 0]]), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(20, 1, 1, 2.0)] * 2


def test_more_candidates_with_more_recall_asked(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(2000, 32))
    forest = build(frame(spark, range(2000), x), block_rows=1000)
    exact = {q: {i for _, i in brute(range(2000), x, q, 10)} for q in range(0, 2000, 20)}
    shares = []
    for recall in (0.3, 0.99):
        got = search(forest, forest.rows.where("vec_id % 20 = 0"), k=10, recall=recall).collect()
        shares.append(np.mean([r.vec_id in exact[r.query_id] for r in got]))
    assert shares[0] < shares[1] and shares[1] > 0.96
