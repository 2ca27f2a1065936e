import hashlib
import random

import numpy as np
import pytest

from landshift.llm import bpe
from landshift.llm.queries import QUERIES
from tests.llm import cases

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.public_vocabulary()


@pytest.fixture(scope="module")
def library(vocabulary):
    found = tokenizers.Tokenizer.from_file(vocabulary)
    found.no_truncation()
    found.no_padding()
    return found


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_odd_rows_equal_the_library(spark, vocabulary, library):
    rows = cases.odd_rows() + [
        (20, "<|endoftext|>Ab<|startoftext|> <|endoftext"), (21, "ΙΣΑΣ ﬁ Å can't l’eau"), (22, "\x1cfoo\x1c! \x85 x"), (23, "a" * 5_000 + "!" * 777),
    ]
    frame = cases.clashing(cases.docs(spark, rows))
    made = bpe.decode(bpe.encode(frame, vocabulary), vocabulary)
    assert made.columns == [*frame.columns, "ids", "decoded"]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", list(r.ids), r.decoded) for r in made.collect())
    assert got == sorted((i is None, i or 0, t or "", *expected(library, t)) for i, t in rows)
    assert bpe.encode(cases.empty(frame), vocabulary).count() == 0


def test_merges_over_random_words(vocabulary, library):
    codec, draw = bpe.codec_of(vocabulary), random.Random(5)
    known = [t.replace("</w>", "") for t in codec.encoder.merges.id_of if t.isascii()]
    for k in range(6_000):
        kind = k % 4
        if kind == 0:
            text = "".join(draw.choice("abcdehinorst") for _ in range(draw.randint(1, 40)))
        elif kind == 1:
            text = "".join(draw.choice(known) for _ in range(draw.randint(1, 6)))
        elif kind == 2:
            text = draw.choice("aehlo") * draw.randint(1, 60)
        else:
            text = "".join(chr(draw.choice([draw.randrange(32, 127), draw.randrange(0x80, 0x3000), draw.randrange(0x1F300, 0x1F700)])) for _ in range(9))
        assert np.frombuffer(codec.encode(text), dtype="<u4").tolist() == expected(library, text)[0], text


def test_tokens_that_merges_never_give():
    # "abc" is a merge of a and bc, but ab goes first: its text is encoded as ab, c.
    vocabulary = {t: i for i, t in enumerate(["a", "b", "c", "ab", "bc", "abc"])}
    merges = bpe.Merges(vocabulary, [("a", "b"), ("b", "c"), ("a", "bc")], "")
    assert merges.reachable() == {0, 1, 2, 3, 4}
    assert bpe.Encoder(merges).encode("abcbc") == [3, 2, 4]


def test_time_grows_in_proportion(vocabulary):
    encoder = bpe.codec_of(vocabulary).encoder
    visits = []
    fits = encoder.merges.compatible
    for size in (20_000, 40_000):
        calls = 0

        def counted(left, right):
            nonlocal calls
            calls += 1
            return fits(left, right)

        encoder.merges.compatible = counted
        try:
            encoder.encode("ab" * (size // 2))
        finally:
            del encoder.merges.compatible
        visits.append(calls)
    assert visits[1] < 2.2 * visits[0]


def test_decoding_passes_over_unknown_ids(spark, vocabulary, library):
    frame = spark.createDataFrame([(1, [320, None, -5, 10**6, 320]), (2, None), (3, [])], "k int, ids array<int>")
    got = {r.k: r.decoded for r in bpe.decode(frame, vocabulary).collect()}
    assert got == {1: library.decode([320, 320], skip_special_tokens=False), 2: "", 3: ""}


def test_query_over_a_whole_table(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op11_bpe"](spark, sf_dir).collect()}
    for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids, text = expected(library, row.text)
        packed = np.array(ids, dtype="<u4").tobytes()
        assert got[row.doc_id] == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
