"""Repeated passages against brute force."""

import hashlib
import random

import pytest

from landshift.llm import substring
from tests.llm import cases


def brute(rows, window):
    parts = {d: cases.WORD.findall(t or "") for d, t in rows}
    first: dict = {}
    for d in sorted(k for k in parts if k is not None):
        for i in range(len(parts[d]) - window + 1):
            first.setdefault(tuple(parts[d][i : i + window]), d)
    out = {}
    for d, w in parts.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1 if d is not None else 0):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def test_cover_reaches_every_difference():
    for period in (2, 7, 13, 31):
        cover = substring.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert len(substring.difference_cover(31)) == 6


@pytest.fixture(scope="module")
def rows():
    draw, out = random.Random(11), cases.odd_rows()
    passages = [cases.prose(200 + k, n) for k, n in enumerate((49, 50, 51, 80, 130, 1500))]
    for k in range(40):
        text = cases.prose(300 + k, draw.randint(0, 90))
        for _ in range(draw.randint(1, 3)):
            p = draw.choice(passages)
            cut = draw.randint(0, len(p) // 3) if draw.random() < 0.5 else 0
            part = p[cut:]
            if draw.random() < 0.3:
                part = part[: len(part) // 2] + ["edit"] + part[len(part) // 2 :]
            at = draw.randint(0, len(text))
            text = text[:at] + part + text[at:]
        out.append((1000 - 7 * k, "\n".join(text)))
    out.append((10_000, " ".join(["again"] * 300)))
    out.append((10_001, " ".join(["again"] * 120)))
    return out


def test_removal_equals_brute_force(spark, rows):
    got = substring.without_repeats(cases.clashing(cases.docs(spark, rows))).collect()
    want = brute(rows, 50)
    ids = {d for d, _ in rows}
    assert {r.doc_id for r in got} == ids and len(got) >= len(ids)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) == want[r.doc_id], r.doc_id
        else:
            assert r.n_removed == 0
    narrow = {r.doc_id: r for r in substring.without_repeats(cases.docs(spark, rows), texts=False).collect()}
    assert all((r.n_removed, r.kept_sha256) == want[d][1:3] for d, r in narrow.items() if d is not None)


def test_segments_and_period_do_not_matter(spark, rows):
    got = substring.without_repeats(cases.docs(spark, rows), texts=False, period=13, segment=64).collect()
    want = brute(rows, 50)
    assert all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id][:3] for r in got if r.doc_id is not None)


def test_empty_table(spark):
    assert substring.without_repeats(cases.empty(cases.docs(spark, {1: "a"}))).count() == 0
