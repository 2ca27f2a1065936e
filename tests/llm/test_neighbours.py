"""Learned partitions: balance, recall and exact scores."""

import numpy as np
import pytest

from landshift.llm import neighbours as n

SCHEMA = "vec_id bigint, embedding array<float>, rank string, score string, part string"


def vectors(count, seed=1, width=16):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, width))
    return (centres[draw.integers(0, 12, count)] + 0.4 * draw.normal(size=(count, width))).astype(np.float32)


def test_parts_are_balanced_and_cut_few_links():
    x = vectors(1200).astype(float)
    links = n.nearest(x, n.GRAPH)
    part = n.balanced_parts(x, links, 8)
    assert np.bincount(part, minlength=8).max() <= int(np.ceil(n.SLACK * 150))
    start = n.split_evenly(x, 8)
    cut = lambda p: (p[links] != p[:, None]).mean()
    assert cut(part) < cut(start)


@pytest.fixture(scope="module")
def found(spark):
    x = vectors(1500)
    x[7] = x[40]  # ties
    x[200:260] = x[60]  # copies
    odd = [(10_000, None), (10_020, [0.0] * 16), (10_040, [float("nan")] + [1.0] * 15), (10_060, [None] + [1.0] * 15),
           (10_080, [float("inf")] * 16), (10_100, [1.0] * 3), (None, [1.0] * 16)]
    rows = [(k, v.tolist(), "x", "y", "z") for k, v in enumerate(x)] + [(i, v, "x", "y", "z") for i, v in odd]
    frame = spark.createDataFrame(rows, SCHEMA)
    return x.astype(float), n.search(frame, frame.where("vec_id % 20 = 0")).collect()


def test_recall_and_order(found):
    x, rows = found
    by_query: dict = {}
    for r in rows:
        by_query.setdefault(r.query_id, []).append(r)
    assert set(by_query) == set(range(0, 1500, 20))
    hits = 0
    for q, own in by_query.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and q not in {r.vec_id for r in own}
        assert [(r.score, -r.vec_id) for r in own] == sorted(((r.score, -r.vec_id) for r in own), reverse=True)
        assert all(abs(r.score - x[q] @ x[r.vec_id]) < 1e-12 for r in own)
        score = x @ x[q]
        score[q] = -np.inf
        hits += sum(r.score >= np.sort(score)[-20] - 1e-12 for r in own)
    assert hits / (20 * len(by_query)) >= 0.9


def test_few_and_no_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0], "", "", ""), (20, [1.0, 0.0], "", "", ""), (3, [2.0, 0.0], "", "", "")], SCHEMA)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in n.search(frame, frame.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 3, 2.0), (0, 2, 20, 1.0), (20, 1, 3, 2.0), (20, 2, 0, 1.0)]
    assert n.search(frame.where("false"), frame.where("false")).count() == 0
    assert n.search(frame, frame.where("false")).count() == 0
