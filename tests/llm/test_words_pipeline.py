"""Word codes, and the pipeline on a small corpus."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from landshift.llm import words
from tests.llm import cases


def test_words_are_those_of_the_expression():
    texts = ["", None, "  a b\tc\x0b\x1fd ", "é ü 😀x\n", "end", "next one", "x" * 100]
    found = words.split_words(pa.array(["skip", *texts], pa.string()).slice(1))
    for row, text in enumerate(texts):
        own = range(found.first[row], found.first[row + 1])
        assert [found.data[found.starts[k] : found.ends[k]].tobytes().decode() for k in own] == cases.WORD.findall(text or "")
    flat = words.split_words(pa.array([], pa.string()))
    assert len(flat.starts) == 0 and list(flat.first) == [0]


def test_codes_and_runs():
    many = [w for k in range(50) for w in cases.prose(k, 20)] + ["a" * n for n in range(1, 40)]
    found = words.split_words(pa.array([" ".join(many)]))
    code = words.codes(found.data, found.starts, found.ends)
    assert len(set(code.tolist())) == len(set(many))
    assert {w: c for w, c in zip(many, code)} == dict(zip(many, code.tolist()))
    for width in (5, 50):
        run = words.runs(np.concatenate([code[:200], code[:200]]), width)
        assert np.array_equal(run[: 200 - width + 1], run[200 : 400 - width + 1])
        assert len(set(run[:200].tolist())) == 200
    assert len(words.runs(code[:3], 5)) == 0


def test_slices_hold_bounded_text():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10] * 7 + [None, "b" * 100, "c"])], ["text"])
    parts = list(words.slices([batch], limit=30))
    assert sum(p.num_rows for p in parts) == 10 and max(p.num_rows for p in parts[:2]) == 3


def test_pipeline(spark, tmp_path):
    draw = random.Random(1)
    item = " ".join(cases.prose(77, 30))
    rows, toxic = cases.odd_rows(), {}
    for k in range(300):
        bad = k % 6 == 0
        text = cases.prose(2000 + k, 60) + ["idiot", "scum", "idiot"] * bad
        draw.shuffle(text)
        toxic[1000 + k] = int(bad)
        rows.append((1000 + k, " ".join(text)))
    rows.append((5000, " ".join(cases.prose(3, 20)) + " " + item))
    path = str(tmp_path)
    cases.docs(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, 1, t) for d, t in toxic.items()], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard"]
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    kept = set(ids)
    assert 5000 not in kept and 2 not in kept and {1, 3, 4} <= kept
    assert not {d for d, t in toxic.items() if t} & kept
    assert len({d for d, t in toxic.items() if not t} - kept) <= 2
    assert max(ids.count(d) for d in kept if d is not None) <= 2
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity"
