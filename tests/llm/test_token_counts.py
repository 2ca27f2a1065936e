"""Counts after edits equal those of the edited text encoded afresh."""

import random

import numpy as np
from pyspark.sql import functions as F

from landshift.llm import token_counts as t
from tests.llm import cases

EDITS = "doc_id bigint, edits array<struct<start:int,stop:int,insert:string>>"


def apply(text, changes):
    text = text or ""
    for c in changes or []:
        start = min(max(c[0] or 0, 0), len(text))
        stop = min(max(start if c[1] is None else c[1], start), len(text))
        text = text[:start] + (c[2] or "") + text[stop:]
    return text


def test_pieces_add_up():
    counter = t.pieces_of(t.VOCABULARY)
    for text in ("", " ", "a  b   c", "don't  stop's  x \n y", "été 12 34,5 😀😀 !", "\x1c a\x1cb  c", "<|endoftext|> x", " lead", "x" * 5_000):
        assert sum(counter.counts(t.cut(text))) == len(counter.encode(text)), text
        assert "".join(t.cut(text)) == text


def test_random_edits_keep_tree_exact():
    draw, counter = random.Random(7), t.pieces_of(t.VOCABULARY)
    alphabet = ["a", "ab ", " ", "  ", "é", "'s", "12", "\n", ".", "word ", "😀"]
    for _ in range(60):
        text = "".join(draw.choice(alphabet) for _ in range(draw.choice([0, 1, 5, 60, 900])))
        chars, tokens = t.build(text, counter)
        for _ in range(8):
            a = draw.randint(0, len(text))
            b = draw.choice([a, a + 1, a + draw.randint(0, 400)])
            new = "".join(draw.choice(alphabet) for _ in range(draw.choice([0, 1, 3, 50, 600])))
            want = text[:a] + new + text[b:]
            text, chars, tokens, _ = t.edit(text, chars, tokens, {"start": a, "stop": b, "insert": new}, counter)
            assert text == want and tokens[1] == len(counter.encode(want)) and chars[1] == len(want)
            leaves = len(chars) // 2
            for heap in (chars, tokens):
                assert all(heap[i] == heap[2 * i] + heap[2 * i + 1] for i in range(1, leaves))


def test_only_a_small_region_is_encoded():
    counter = t.pieces_of(t.VOCABULARY)
    text = " ".join(cases.prose(1, 5_000))
    *_, encoded = t.edit(text, *t.build(text, counter), {"start": 9_000, "stop": 9_010, "insert": "new words"}, counter)
    assert encoded < 600


def test_documents(spark):
    rows = cases.odd_rows()
    draw = random.Random(9)
    edits = [(d, [(draw.randint(-2, 900), draw.choice([None, draw.randint(0, 900)]), draw.choice([None, "", "new é text"])) for _ in range(3)]) for d in {r[0] for r in rows} if d not in (None, 6)]
    frame = cases.clashing(cases.docs(spark, rows)).drop("edits").join(spark.createDataFrame(edits, EDITS), "doc_id", "left")
    indexed = t.with_tree(frame).withColumn("before", t.n_tokens())
    got = t.with_edits(indexed).withColumn("after", t.n_tokens()).collect()
    counter, changes, texts = t.pieces_of(t.VOCABULARY), dict(edits), dict(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            want = apply(texts[r.doc_id], changes.get(r.doc_id))
            assert r.before == len(counter.encode(texts[r.doc_id] or "")) and r.after == len(counter.encode(want))
            assert (r.text or "") == want
    assert t.with_edits(t.with_tree(cases.empty(frame))).count() == 0
    assert isinstance(got[0].tree_tokens, list) and np.isfinite(got[0].tree_tokens).all()
