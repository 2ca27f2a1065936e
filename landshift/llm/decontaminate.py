"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit distance.

Texts are sequences of words (lower-cased runs between white space and ASCII punctuation).
An item of m words leaks into a document if some run of its words is within
``floor(EDITS * m)`` word edits of the item.

The CGK random walk turns edit distance into Hamming distance: step j emits the current
word and moves on by one word or not at all, as a random bit of (j, word) says. Equal words
after an edit bring two walks together again with a fair chance. A repetition draws new
bits, samples positions of the walk, and looks up windows that agree with an item at all
of them. Walks over windows that start at every word of every document are run together,
and a window is given up at its first sampled word that no item has there, so most
windows take a few steps. Items fall into length classes; a window is as long as its class,
and repetitions begin at different offsets of the item, so that no edit can spoil all of them.

The number of repetitions is chosen on the driver: items are edited at random up to the limit
and the walk is repeated until ``TARGET`` of them have met. Candidates are verified by exact
edit distance against the whole item with free ends in the document.

Items are handled in blocks of about ``BLOCK`` rows, so what a task receives is bounded; a
larger benchmark takes more passes over the documents. Nothing is shuffled.

Defined results: a null or empty text leaks nothing; items with fewer than ``MIN_WORDS`` words
(null and empty ones too) are no evidence and match nothing; repeated items each match; documents
with a null doc_id are searched like others and reported with a null id, one row for each;
empty tables give an empty result. ``leaks`` reads only the named id and text columns; ``decontaminate``
passes whole rows on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landshift.llm import words

EDITS = 0.2
TARGET = 0.99
MIN_WORDS = 8
BLOCK = 20_000
MOST_REPETITIONS = 48
GROWTH = 1.5  # lengths of neighbouring classes
SPLIT = words.WHITE.copy()
SPLIT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


@dataclass
class Index:
    """Items as numbers of vocabulary words (0: a word that no item has), and the repetitions."""

    vocabulary: np.ndarray
    ids: list
    items: list[np.ndarray]
    repetitions: list[dict]


def word_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words of a column, and the bounds of its rows."""
    found = words.split_words(column, lower=True, breaks=SPLIT)
    return words.codes(found.data, found.starts, found.ends), found.first


def numbered(code: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """1 + the place of every code in the sorted vocabulary, 0 for others."""
    if not len(vocabulary):
        return np.zeros(len(code), dtype=np.int32)
    place = np.minimum(np.searchsorted(vocabulary, code), len(vocabulary) - 1)
    return np.where(vocabulary[place] == code, place + 1, 0).astype(np.int32)


def length_class(m: int) -> int:
    """Window length of the class of items with m words: the largest step of the ladder up to m."""
    step = MIN_WORDS
    while int(step * GROWTH) <= m:
        step = int(step * GROWTH)
    return step


def walk(ids: np.ndarray, at: np.ndarray, bits: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Word positions after steps ``begin``..``end``-1; words past the end count as 0."""
    for j in range(begin, end):
        at = at + bits[j][ids[at]]
    return at


def draw_repetition(number: int, size: int, classes: list[int], seed: int) -> dict:
    """Bits of one repetition, its two early positions, and offset and late position per class."""
    draw = np.random.default_rng([seed, number])
    offset = {c: int(draw.integers(0, c // 2 + 1)) for c in classes}
    late = {c: int(draw.integers(7, max(8, int(1.5 * (c - offset[c]))))) for c in classes}
    bits = draw.integers(0, 2, (max(late.values(), default=7), size + 1)).astype(np.int8)
    return {"bits": bits, "early": (int(draw.integers(0, 3)), int(draw.integers(3, 7))), "offset": offset, "late": late}


def sampled(ids: np.ndarray, repetition: dict, window: int) -> tuple[int, int, int]:
    """The three sampled words of a sequence that starts at the class's offset."""
    padded = np.concatenate([ids[repetition["offset"][window] :], np.zeros(len(repetition["bits"]) + 1, dtype=np.int32)])
    at = np.zeros(1, dtype=np.int64)
    out, done = [], 0
    for position in (*repetition["early"], repetition["late"][window]):
        at = walk(padded, at, repetition["bits"], done, position)
        out.append(int(padded[at[0]]))
        done = position
    return tuple(out)


def edited(item: np.ndarray, edits: int, draw: np.random.Generator) -> np.ndarray:
    """The item after random substitutions, deletions and insertions of foreign words."""
    out = list(item)
    for _ in range(edits):
        kind, place = draw.integers(3), int(draw.integers(max(len(out), 1)))
        if kind == 0 and out:
            out[place] = 0
        elif kind == 1 and len(out) > 1:
            del out[place]
        else:
            out.insert(place, 0)
    return np.array(out, dtype=np.int32)


def build_index(ids: list, texts: list, edits: float = EDITS, target: float = TARGET, seed: int = 7, trials: int = 400) -> Index:
    """Vocabulary and items of a block, and as many repetitions as the target takes."""
    code, first = word_codes(pa.array(texts, pa.string()))
    size = np.diff(first)
    usable = np.flatnonzero(size >= MIN_WORDS)
    vocabulary = np.unique(np.concatenate([code[:0], *[code[first[i] : first[i + 1]] for i in usable]]))
    items = [numbered(code[first[i] : first[i + 1]], vocabulary) for i in usable]
    classes = sorted({length_class(len(i)) for i in items})
    draw = np.random.default_rng(seed)
    chosen = [items[i] for i in draw.integers(0, len(items), trials)] if items else []
    pairs = [(item, edited(item, int(edits * len(item)), draw)) for item in chosen]
    repetitions: list[dict] = []
    missed = np.ones(len(pairs), dtype=bool)
    while items and missed.mean() > 1 - target and len(repetitions) < MOST_REPETITIONS:
        rep = draw_repetition(len(repetitions), len(vocabulary), classes, seed)
        # A window may start at the item's first word or, after shifts, near it.
        for k in np.flatnonzero(missed):
            item, other = pairs[k]
            c = length_class(len(item))
            key = sampled(item, rep, c)
            shifted = [sampled(np.concatenate([np.zeros(max(-s, 0), dtype=np.int32), other[max(s, 0) :]]), rep, c) for s in (-2, -1, 0, 1, 2)]
            missed[k] = 0 in key or key not in shifted
        repetitions.append(rep)
    for rep in repetitions:
        rep["keys"] = {c: {} for c in classes}
        for number, item in enumerate(items):
            key = sampled(item, rep, length_class(len(item)))
            if 0 not in key:
                rep["keys"][length_class(len(item))].setdefault(key, []).append(number)
        _pack(rep, len(vocabulary) + 1)
    return Index(vocabulary, [ids[i] for i in usable], items, repetitions)


def _pack(rep: dict, base: int) -> None:
    """Sorted tables of the first word, the first two, and all three with their items."""
    two = sorted({k[0] * base + k[1] for keys in rep["keys"].values() for k in keys})
    rep["two"] = np.array(two, dtype=np.int64)
    rep["one"] = np.zeros(base, dtype=bool)
    rep["one"][rep["two"] // base] = True
    tables = {}
    for c, keys in rep.pop("keys").items():
        rows = sorted((int(np.searchsorted(rep["two"], k[0] * base + k[1])) * base + k[2], n) for k, held in keys.items() for n in held)
        tables[c] = (np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64))
    rep["tables"] = tables


def candidates(ids: np.ndarray, first: np.ndarray, index: Index) -> np.ndarray:
    """Distinct (item, supposed start) that agree in some repetition, over the words of all rows.

    A supposed start lies in the row of its window: an item whose leading words are missing starts with the row.
    """
    base = len(index.vocabulary) + 1
    found = [np.zeros(0, dtype=np.int64)]
    reach = len(ids) + 1
    for rep in index.repetitions:
        padded = np.concatenate([ids, np.zeros(len(rep["bits"]) + 1, dtype=ids.dtype)])
        start = np.arange(len(ids))
        at = walk(padded, start, rep["bits"], 0, rep["early"][0])
        one = padded[at]
        live = rep["one"][one]
        start, at, one = start[live], at[live], one[live].astype(np.int64)
        at = walk(padded, at, rep["bits"], rep["early"][0], rep["early"][1])
        two = one * base + padded[at]
        place = np.minimum(np.searchsorted(rep["two"], two), max(len(rep["two"]) - 1, 0))
        live = rep["two"][place] == two if len(rep["two"]) else np.zeros(len(two), bool)
        start, at, place = start[live], at[live], place[live]
        done = rep["early"][1]
        for c, (keys, numbers) in sorted(rep["tables"].items(), key=lambda t: rep["late"][t[0]]):
            at = walk(padded, at, rep["bits"], done, rep["late"][c])
            done = rep["late"][c]
            key = place * base + padded[at]
            low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
            times = high - low
            which = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            window = np.repeat(start, times)
            begin = np.maximum(window - rep["offset"][c], first[np.searchsorted(first, window, side="right") - 1])
            found.append(np.unique(numbers[which] * reach + begin))
    pairs = np.unique(np.concatenate(found))
    return np.stack([pairs // reach, pairs % reach])


def best_alignment(item: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits of the item against any part of each text row, with begin and end of that part.

    Distance and begin are carried together in one number, so ties take the later begin.
    """
    n, width = text.shape
    shift = 1 << 20
    column = np.arange(width + 1, dtype=np.int64)
    state = np.broadcast_to(-column, (n, width + 1)).copy()  # cost * shift - begin
    for i, word in enumerate(item):
        step = np.empty_like(state)
        step[:, 0] = (i + 1) * shift
        step[:, 1:] = np.minimum(state[:, :-1] + shift * (text != word), state[:, 1:] + shift)
        state = np.minimum.accumulate(step - column * shift, axis=1) + column * shift
    end = state.argmin(axis=1)
    value = state[np.arange(n), end]
    cost = -(-value // shift)
    return cost, cost * shift - value, end


def verified(ids: np.ndarray, first: np.ndarray, index: Index, edits: float) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, begin, end) of the best leak of each item in each row."""
    numbers, starts = candidates(ids, first, index)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for number in np.unique(numbers):
        item = index.items[number]
        m, limit = len(item), int(edits * len(item))
        start = starts[numbers == number]
        row = np.searchsorted(first, start, side="right") - 1
        begin = np.maximum(start - 2 * limit - 2, first[row])
        span = np.arange(m + 4 * limit + 4)
        member = np.zeros(len(index.vocabulary) + 1, dtype=bool)
        member[item] = True
        for part in range(0, len(start), 4096):
            b, r = begin[part : part + 4096], row[part : part + 4096]
            place = b[:, None] + span
            text = np.where(place < first[r + 1][:, None], ids[np.minimum(place, len(ids) - 1)], 0)
            hopeful = member[text].sum(axis=1) >= m - limit
            if not hopeful.any():
                continue
            cost, low, high = best_alignment(item, text[hopeful])
            for k in np.flatnonzero(cost <= limit):
                owner, at = int(r[hopeful][k]), int(b[hopeful][k] - first[r[hopeful][k]])
                value = (int(cost[k]), at + int(low[k]), at + int(high[k]))
                best[owner, int(number)] = min(best.get((owner, int(number)), value), value)
    return [(row, number, *value) for (row, number), value in sorted(best.items())]


def search(index: Index, edits: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches):
            code, first = word_codes(part.column("text"))
            rows = verified(numbered(code, index.vocabulary), first, index, edits) if len(code) else []
            docs = part.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([docs[r[0]] for r in rows], pa.int64()), pa.array([index.ids[r[1]] for r in rows], pa.int64()),
                 *[pa.array([r[k] for r in rows], pa.int32()) for k in (2, 3, 4)]],
                ["doc_id", "item_id", "edits", "start_word", "stop_word"],
            )

    return run


def clean(index: Index, edits: float):
    """Whole rows into which no item of the index leaks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches):
            code, first = word_codes(part.column("text"))
            stay = np.ones(part.num_rows, dtype=bool)
            stay[[r[0] for r in verified(numbered(code, index.vocabulary), first, index, edits)] if len(code) else []] = False
            yield part.filter(pa.array(stay))

    return run


def indexes(items: DataFrame, edits: float, target: float, block: int) -> Iterator[Index]:
    """The indexes of all blocks of items."""
    items = items.select("item_id", "text").where("text is not null")
    blocks = max(-(-items.count() // block), 1)
    for number in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).collect()
        mine = sorted(mine, key=lambda r: (r.item_id is None, r.item_id or 0, r.text))
        yield build_index([r.item_id for r in mine], [r.text for r in mine], edits, target)


def leaks(docs: DataFrame, items: DataFrame, edits: float = EDITS, target: float = TARGET, block: int = BLOCK) -> DataFrame:
    """One row per document and item that leaks into it: doc_id, item_id, edits, start_word, stop_word.

    Places count words as this module cuts them; of several leaks the best, then the first is told.
    """
    docs = docs.select("doc_id", "text")
    parts = [
        docs.mapInArrow(search(index, edits), "doc_id bigint, item_id bigint, edits int, start_word int, stop_word int")
        for index in indexes(items, edits, target, block)
    ]
    return reduce(DataFrame.unionByName, parts)


def decontaminate(docs: DataFrame, items: DataFrame, edits: float = EDITS, target: float = TARGET, block: int = BLOCK) -> DataFrame:
    """All columns of the documents into which no item leaks; rows are judged by their texts, whatever their ids."""
    for index in indexes(items, edits, target, block):
        docs = docs.mapInArrow(clean(index, edits), docs.schema)
    return docs
