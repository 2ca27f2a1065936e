"""SuperMinHash signatures and grouping, against brute force."""

import random

import numpy as np
import pytest

from landshift.llm import near_dup, words
from tests.llm import cases


def shingle_set(text):
    w = cases.WORD.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent):
    """Smallest id reachable over links of all pairs."""
    sets = {}
    for doc, text in rows:
        if doc is not None:
            sets.setdefault(doc, shingle_set(text))
    group = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    return {d: (len(sets[d]), group[d], group[d] == d) for d in sets}


def test_signature_is_the_least_offer_of_a_permutation():
    draw = np.random.default_rng(3)
    values = draw.integers(1, 2**63, 40).astype(np.uint64)
    alone = [near_dup.super_min_hash(np.zeros(1, dtype=np.int64), values[k : k + 1], 1)[0] for k in range(40)]
    for ranks in alone:  # the ranks of one element are a permutation
        assert sorted(ranks >> 32) == list(range(near_dup.SLOTS))
    together = near_dup.super_min_hash(np.zeros(40, dtype=np.int64), values, 1)[0]
    assert np.array_equal(together, np.min(alone, axis=0))  # early stopping changes nothing


def test_signature_estimates_similarity():
    draw = np.random.default_rng(4)
    miss = []
    for _ in range(60):
        x = draw.integers(1, 2**63, 300).astype(np.uint64)
        rows = np.repeat([0, 1], 200)
        slots = near_dup.super_min_hash(rows, np.concatenate([x[:200], x[100:]]), 2)
        miss.append((slots[0] == slots[1]).mean() - 1 / 3)
    assert abs(np.mean(miss)) < 0.02 and np.std(miss) < 0.045


@pytest.fixture(scope="module")
def rows():
    draw, out = random.Random(5), cases.odd_rows()
    for family in range(6):
        base = cases.prose(50 + family, 90)
        for k in range(8):
            copy = list(base)
            for _ in range(k // 2):
                copy[draw.randrange(len(copy))] = f"other{draw.random()}"
            out.append((100 + 10 * family + k, " ".join(copy).upper() if k == 1 else "  ".join(copy)))
    return out


@pytest.mark.parametrize("percent", [85, 60])
def test_groups_are_those_of_all_pairs(spark, rows, percent):
    got = near_dup.grouped(cases.clashing(cases.docs(spark, rows)), percent).collect()
    want = brute(rows, percent)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == want[r.doc_id], r


def test_empty_table_and_filter(spark):
    frame = cases.docs(spark, [(2, "a b c d e f"), (1, "A b c d e f"), (3, None), (None, "a b c d e f")])
    assert near_dup.grouped(cases.empty(frame)).count() == 0
    kept = near_dup.deduplicate(cases.clashing(frame))
    assert kept.columns == cases.clashing(frame).columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 3]


def test_large_bucket_is_met_block_against_block(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    draw, base, rows = random.Random(6), cases.prose(9, 60), []
    for k in range(30):
        copy = list(base)
        for _ in range(3):
            copy[draw.randrange(60)] = f"w{draw.randrange(4)}"
        rows.append((k, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.grouped(cases.docs(spark, rows), 70).collect()}
    assert got == brute(rows, 70)


def test_sketches_allow_every_link():
    draw = np.random.default_rng(8)
    sets = [np.unique(draw.integers(1, 2**63, n).astype(np.uint64)) for n in (40, 400)]
    for s in sets:
        other = np.concatenate([s[: int(0.95 * len(s))], draw.integers(1, 2**63, len(s) // 20).astype(np.uint64)])
        least = [(np.sort(words.mix(v))[: near_dup.SKETCH] >> np.uint64(48)).astype("<u2") for v in (s, other)]
        bounds = np.cumsum([0, *map(len, least)])
        assert near_dup.may_link(np.array([0]), np.array([1]), np.concatenate(least), bounds, np.array([len(s), len(other)]), 85)[0]
