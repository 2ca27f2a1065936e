"""Token counts that follow edits, with a segment tree of pre-token pieces per document.

A byte-level vocabulary never merges across pre-tokens. A text may therefore be cut before
any space that stands between two other characters: what follows always begins a new
pre-token, so counts of the pieces add up. A leaf holds ``PIECES`` such pieces; inner
nodes hold the sums of characters and tokens below them, as two heaps stored in the
document's row (node 1 is the whole text, node i has the children 2i and 2i+1).

An edit (start, stop, insert) replaces the characters start..stop-1. It descends by character
sums to the leaves it touches, re-encodes these, and the next leaf on a side where it comes so
near the leaf's edge that the cut there may move, and updates the sums of their ancestors. Edits of a
document apply in order, each to the text that the ones before left.

Everything is local to a document's row; nothing is shuffled. Within a task counts of pieces are
remembered (at most ``REMEMBERED``), as most pieces are frequent words.

Defined results: a null text counts as empty and becomes a text when edited; empty texts have no
tokens; null or empty edit lists change nothing; positions beyond the text are moved to
its end, and a null stop or insert means the start or nothing; strings of special tokens are
ordinary text; an empty table gives an empty result. Tree columns of the input are replaced.
"""

from __future__ import annotations

import re
from base64 import b64decode
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landshift.llm import words

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that the rank files above were made with.
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = 16
GROW = 8  # a leaf with more than so many times its pieces has the tree built anew
REMEMBERED = 200_000
CUT = re.compile(r"(?<=\S)(?= \S)")
TREE = ("tree_chars", "tree_tokens")


class Pieces(dict):
    """Token counts of pieces seen in this worker."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        self.encode = tiktoken.Encoding("pieces", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = count = len(self.encode(piece))
        return count

    def counts(self, pieces: list[str]) -> list[int]:
        return list(map(self.__getitem__, pieces))


@lru_cache(maxsize=4)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def cut(text: str) -> list[str]:
    return CUT.split(text) if text else []


def build(text: str, counter: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Heaps of characters and tokens; leaf k is node ``len(heap) // 2 + k``."""
    pieces = cut(text)
    bounds = np.arange(0, len(pieces), PIECES)
    leaves = 1 << max(len(bounds) - 1, 0).bit_length()
    out = []
    for values in (list(map(len, pieces)), counter.counts(pieces)):
        heap = np.zeros(2 * leaves, dtype=np.int64)
        if pieces:
            heap[leaves : leaves + len(bounds)] = np.add.reduceat(np.array(values, dtype=np.int64), bounds)
        for level in _levels(leaves):
            heap[level] = heap[2 * level] + heap[2 * level + 1]
        out.append(heap)
    return out[0], out[1]


def _levels(leaves: int) -> Iterator[np.ndarray]:
    """Inner nodes from the level above the leaves to the root."""
    while leaves > 1:
        leaves //= 2
        yield np.arange(leaves, 2 * leaves)


def leaf_at(chars: np.ndarray, position: int) -> tuple[int, int]:
    """The leaf that holds a character position, and the leaf's first position."""
    node, begin, leaves = 1, 0, len(chars) // 2
    while node < leaves:
        node *= 2
        if position >= begin + chars[node]:
            begin += int(chars[node])
            node += 1
    return node - leaves, begin


def edit(text: str, chars: np.ndarray, tokens: np.ndarray, change: dict, counter: Pieces):
    """Text and heaps after one edit, and the number of characters that were encoded again."""
    start = min(max(change["start"] or 0, 0), len(text))
    stop = min(max(change["stop"] if change["stop"] is not None else start, start), len(text))
    leaves = len(chars) // 2
    first, begin = leaf_at(chars, min(start, max(len(text) - 1, 0)))
    last, _ = leaf_at(chars, max(min(stop, len(text) - 1), 0))
    end = begin + int(chars[leaves + first : leaves + last + 1].sum())
    low, high = first, last
    # The cut in front of a leaf rests on the character before it and its first two.
    while low > 0 and start < begin + 2:
        low -= 1
        begin -= int(chars[leaves + low])
    while high < leaves - 1 and stop > end - 1:
        high += 1
        end += int(chars[leaves + high])
    region = text[begin:start] + (change["insert"] or "") + text[stop:end]
    text = text[:begin] + region + text[end:]
    pieces = cut(region)
    room = high - low + 1
    share = max(-(-len(pieces) // room), 1)
    if share > GROW * PIECES:
        return text, *build(text, counter), len(region)
    sizes, counts = list(map(len, pieces)), counter.counts(pieces)
    for k in range(room):
        chars[leaves + low + k] = sum(sizes[k * share : (k + 1) * share])
        tokens[leaves + low + k] = sum(counts[k * share : (k + 1) * share])
    a, b = leaves + low, leaves + high
    while a > 1:
        a, b = a // 2, b // 2
        for heap in (chars, tokens):
            span = np.arange(a, b + 1)
            heap[span] = heap[2 * span] + heap[2 * span + 1]
    return text, chars, tokens, len(region)


def _trees(rows: list[tuple[np.ndarray, np.ndarray]]) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (0, 1)]


def _columns(frame: DataFrame, drop: tuple[str, ...]) -> list[str]:
    return [c for c in frame.columns if c not in drop]


def with_tree(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents with their segment tree in two columns."""
    kept = _columns(docs, TREE)
    fields = [docs.schema[c] for c in kept] + [T.StructField(c, T.ArrayType(T.LongType())) for c in TREE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = pieces_of(vocabulary)
        for batch in words.slices(batches):
            rows = [build(text or "", counter) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *_trees(rows)], [*kept, *TREE])

    return docs.select(*kept).mapInArrow(run, T.StructType(fields))


def with_edits(indexed: DataFrame, edits: str = "edits", vocabulary: str = VOCABULARY) -> DataFrame:
    """Texts and trees after the edits of column ``edits``, array<struct<start,stop,insert>>.

    Column ``encoded_chars`` tells how many characters were encoded again.
    """
    kept = _columns(indexed, ("encoded_chars",))
    fields = [indexed.schema[c] for c in kept] + [T.StructField("encoded_chars", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = pieces_of(vocabulary)
        for batch in words.slices(batches):
            texts, trees, encoded = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("text", *TREE, edits)]
            for text, chars, tokens, changes in zip(*columns):
                chars, tokens, total = np.array(chars, dtype=np.int64), np.array(tokens, dtype=np.int64), 0
                for change in changes or []:
                    text, chars, tokens, again = edit(text or "", chars, tokens, change, counter)
                    total += again
                texts.append(text)
                trees.append((chars, tokens))
                encoded.append(total)
            new = dict(zip(TREE, _trees(trees))) | {"text": pa.array(texts, pa.string())}
            columns = [new.get(c, batch.column(c) if c not in new else None) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(encoded, pa.int64())], [*kept, "encoded_chars"])

    return indexed.select(*kept).mapInArrow(run, T.StructType(fields))


def n_tokens(tree: str = "tree_tokens"):
    """The count of a document: the root of its tree."""
    return F.element_at(tree, 2)
