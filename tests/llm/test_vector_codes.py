import math
import random

import numpy as np

from landshift.llm import vector_codes
from tests.llm import cases

KIND = "vec_id bigint, embedding array<float>, label int"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Codes by the definition: every part against every entry."""
    kept = [(i, [math.floor(scale * x) for x in np.array(v, dtype=np.float32).astype(float)], l) for i, v, l in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    width = len(kept[0][1]) // parts
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = [[] for _ in books[p]]
            for _, v, _ in kept:
                held[near(cut(v)[p], books[p])[1]].append(cut(v)[p])
            books[p] = [tuple(sum(c) // len(h) for c in zip(*h)) if h else books[p][e] for e, h in enumerate(held)]
    out = []
    for i, v, l in kept:
        best = [near(part, books[p]) for p, part in enumerate(cut(v))]
        out.append((i, l, [e for _, e in best], sum(d for d, _ in best)))
    return out, books


def made(spark, rows, **options):
    return vector_codes.compress(spark.createDataFrame(rows, KIND), **options)


def key(row):
    return (row[0] is None, row[0] or 0, row[2], row[3])


def test_equals_plain_codes(spark):
    draw = random.Random(2)
    grid = lambda: [draw.choice([-0.5, -0.25, 0.0, 0.1, 0.3]) if draw.random() < 0.7 else draw.gauss(0, 1) for _ in range(16)]
    rows = [(i, grid(), draw.choice([0, 1, None])) for i in range(300)]
    rows += [(1, rows[1][1], 1), (1, rows[2][1], 1), (None, grid(), 2), (400, None, 1), (401, [0.0] * 15 + [None], 1), (402, [0.0] * 15 + [math.nan], 0),
             (403, [0.0] * 15 + [math.inf], 0), (404, [0.0] * 16, None)] + [(500 + i, [0.25] * 16, 3) for i in range(200)]
    codes, books = made(spark, rows)
    want, want_books = plain(rows)
    got = [(r.vec_id, r.label, list(r.code), r.error) for r in codes.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert [[tuple(e) for e in books[16, p].tolist()] for p in range(8)] == want_books
    errors = {}
    for _, label, _, error in want:
        errors[label] = errors.get(label, 0) + error
    assert {(r.label, r.label_error) for r in vector_codes.with_label_error(codes).collect()} == set(errors.items())


def test_walk_shares_prefixes_across_blocks():
    draw = np.random.default_rng(3)
    leaves = np.unique(draw.integers(-2, 3, (4_000, 6)), axis=0)
    entries = draw.integers(-3, 4, (16, 6))
    distance = ((leaves[:, None] - entries[None]) ** 2).sum(axis=2)
    for block in (1, 7, 10_000):
        walk = vector_codes.Walk(entries)
        found = [walk.visit(leaves[k : k + block]) for k in range(0, len(leaves), block)]
        assert np.array_equal(np.concatenate([f[0] for f in found]), distance.argmin(axis=1))
        assert np.array_equal(np.concatenate([f[1] for f in found]), distance.min(axis=1))
        # Nodes are the distinct prefixes, wherever blocks end.
        assert walk.nodes == sum(len(np.unique(leaves[:, :d], axis=0)) for d in range(1, 7)) < leaves.size


def test_few_and_odd_vectors(spark):
    codes, books = made(spark, [(3, [1.0] * 8, 0), (5, [2.0] * 8, 0), (6, [], 0), (7, [0.5] * 12, 1), (8, [3e38] * 8, 0)])
    got = {r.vec_id: (r.length, len(r.code), r.error) for r in codes.collect()}
    assert got == {3: (8, 8, 0), 5: (8, 8, 0), 6: (0, 8, 0), 7: (12, 8, 0), 8: (8, 8, 0)}
    assert {n for n, _ in books} == {0, 8, 12}
    assert all(np.abs(b).max(initial=0) <= vector_codes.largest(8, 8) for b in books.values())
    assert made(spark, [(1, None, 1)])[0].count() == 0
    assert cases.empty(made(spark, [(3, [1.0] * 8, 0)])[0]).count() == 0


def test_clashing_columns(spark):
    frame = spark.createDataFrame([(k, [k / 7.0] * 8, k % 2) for k in range(40)], KIND)
    crowded = frame.withColumns({c: frame["vec_id"] for c in ("code", "error", "place", "length", "position", "part", "copies", "vector")})
    plain_codes, crowded_codes = (sorted(map(str, vector_codes.compress(f)[0].collect())) for f in (frame, crowded))
    assert plain_codes == crowded_codes
