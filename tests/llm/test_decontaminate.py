"""Leaks of benchmark items, against edit distance at every place."""

import random

import numpy as np

from landshift.llm import decontaminate as d
from tests.llm import cases

ITEMS = "item_id bigint, text string"


def edit(text, edits, draw):
    out = text.split()
    for _ in range(edits):
        kind, at = draw.randrange(3), draw.randrange(len(out))
        if kind == 0:
            out[at] = "changed"
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, "more")
    return " ".join(out)


def distance(item, text):
    """Least edits of the item against any part of the text, word by word."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (w != t))
    return min(row)


def test_alignment_equals_plain_edit_distance():
    draw = random.Random(1)
    for _ in range(60):
        item = [draw.randrange(1, 5) for _ in range(draw.randint(1, 9))]
        text = [draw.randrange(0, 5) for _ in range(draw.randint(0, 14))]
        cost, low, high = d.best_alignment(np.array(item), np.array([text], dtype=np.int64).reshape(1, -1))
        assert cost[0] == distance(item, text)
        assert distance(item, text[low[0] : high[0]]) == cost[0]


def test_leaks_are_found_and_clean_documents_left(spark):
    draw = random.Random(2)
    items = [(k, " ".join(cases.prose(500 + k, draw.randint(9, 60)))) for k in range(30)]
    odd = [(100, None), (101, ""), (102, "too short"), (103, items[0][1]), (None, items[1][1])]
    rows, planted = cases.odd_rows(), {}
    for k in range(60):
        text = cases.prose(900 + k, 60)
        if k < 45:
            number, body = items[k % 30]
            allowed = int(d.EDITS * len(body.split()))
            planted[1000 + k] = number
            body = edit(body.upper().replace(" ", ", ", 3), draw.randint(0, allowed // 2), draw)
            at = draw.randint(0, 60)
            text = text[:at] + [body] + text[at:]
        rows.append((1000 + k, " ".join(text)))
    frame = cases.clashing(cases.docs(spark, rows))
    table = spark.createDataFrame(items + odd, ITEMS)
    found = d.leaks(frame, table).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    assert pairs >= set(planted.items())
    assert {r.doc_id for r in found} == set(planted)
    assert all((doc, 103) in pairs for doc, item in planted.items() if item == 0)  # repeated items both match
    assert not {i for _, i in pairs} & {100, 101, 102}
    split = {(r.doc_id, r.item_id) for r in d.leaks(frame, table, block=7).collect()}
    assert split >= set(planted.items()) and {p[0] for p in split} == set(planted)
    kept = d.decontaminate(frame, table)
    assert kept.columns == frame.columns and kept.count() == len(rows) - len(planted)


def test_recall_at_the_largest_edit_rate():
    draw = np.random.default_rng(5)
    texts = [" ".join(cases.prose(40 + k, 15 + k % 40)) for k in range(120)]
    index = d.build_index(list(range(120)), texts)
    hits = 0
    for number, item in enumerate(index.items):
        other = d.edited(item, int(d.EDITS * len(item)), draw)
        ids = np.concatenate([np.zeros(20, np.int32), other, np.zeros(20, np.int32)]).astype(np.int32)
        hits += any(r[1] == number for r in d.verified(ids, np.array([0, len(ids)]), index, d.EDITS))
    assert hits >= 0.88 * 120


def test_rows_that_open_inside_an_item():
    texts = [" ".join(cases.prose(700 + k, 15 + k)) for k in range(40)]
    index = d.build_index(list(range(40)), texts)
    found = 0
    for number, item in enumerate(index.items):
        rows = [np.zeros(30, np.int32), item[3:], np.zeros(0, np.int32), np.zeros(30, np.int32)]
        first = np.cumsum([0, *map(len, rows)])
        found += any(r[:3] == (1, number, 3) for r in d.verified(np.concatenate(rows), first, index, d.EDITS))
    assert found >= 38


def test_rows_are_removed_whatever_their_ids(spark):
    item = " ".join(cases.prose(77, 30))
    leak, plain = " ".join(cases.prose(3, 20)) + " " + item, " ".join(cases.prose(4, 20))
    other = " ".join(cases.prose(78, 30))
    frame = cases.docs(spark, [(None, leak), (None, plain), (1, leak), (1, plain), (2, None), (None, None), (3, other)])
    table = spark.createDataFrame([(1, item), (2, other)], ITEMS)
    want = sorted([(None, plain), (1, plain), (2, None), (None, None)], key=str)
    for block in (d.BLOCK, 1):
        kept = d.decontaminate(frame, table, **({} if block == d.BLOCK else {"block": block}))
        assert kept.schema == frame.schema
        assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == want


def test_empty_tables(spark):
    frame, table = cases.docs(spark, cases.odd_rows()), spark.createDataFrame([(1, "a b c d e f g h i")], ITEMS)
    assert d.leaks(frame, cases.empty(table)).count() == 0
    assert d.leaks(cases.empty(frame), table).count() == 0
