from functools import reduce
from operator import add

import numpy as np
import pytest

from cinderlog.llm.ann import build, search


@pytest.mark.parametrize("recall", [0.0, 0.95])
def test_groups_of_equal_vectors_get_all_rows(spark, recall):
    draw = np.random.default_rng(7)
    x = draw.normal(size=(1200, 24))
    for n, start in zip(range(5, 20), range(0, 1200, 80)):
        x[start : start + n] = x[start]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(0, [float(c) for c in x[0]])] * 12
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    forest = build(df)
    got = search(forest, forest.rows.where("vec_id % 20 = 0"), recall=recall)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append(r.rank)
    assert sorted(found) == list(range(0, 1200, 20))
    assert all(sorted(ranks) == list(range(1, 21)) for q, ranks in found.items() if q)
    assert sorted(found[0]) == sorted([*range(1, 21)] * 13)


@pytest.mark.parametrize("copies", [5, 27, 60])
def test_equal_vectors_tie_bit_by_bit(spark, copies):
    draw = np.random.default_rng(copies)
    x = draw.normal(size=(copies + 60, 31))
    x[:copies] = x[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    order = draw.permutation(len(rows)).tolist()
    df = spark.createDataFrame([rows[i] for i in order], "vec_id long, embedding array<double>").repartition(3)
    forest = build(df)
    found = {}
    for r in search(forest, forest.rows.where("vec_id % 5 = 0"), recall=1.0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    for q, got in found.items():
        scores = {i: reduce(add, [a * b for a, b in zip(v, rows[q][1])]) for i, v in rows if i != q}
        expected = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:20]
        if q < copies:  # its copies are nearest, and all trees hold them
            n = min(20, copies - 1)
            assert [(s, i) for i, s in expected[:n]] == got[:n]
        assert all(score == scores[i] for score, i in got)
