"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

The tokenizer file (JSON of the tokenizers library) gives the vocabulary, the merges and the
steps before them: special tokens are cut out of the raw text, the rest is normalised and cut
into pre-tokens by the file's own rules. Each pre-token is encoded as follows.

* A pre-token is a string over byte characters whose last one carries the end-of-word mark. An
  Aho-Corasick automaton over all tokens reads it once and tells the longest token that starts
  at each place.
* The encoder takes the longest token, then the longest at its end, and so on. Two neighbours
  must be compatible: encoding both together by merges must give these two. If a token does not fit,
  its longest prefix that is a token takes its place; if none fits, the place is marked as
  dead and the token before it is shortened. A place is marked once, so the time is linear.
  A sequence of pairwise compatible tokens is the one that the merges give.
* Compatibility of a pair is read off the merges along both sides of the seam and kept in a
  table of at most ``REMEMBERED`` pairs.

Decoding gathers byte ranges: all tokens lie in one buffer, an offset table tells where. Files
without a decoder join tokens by spaces, as the library does.

Everything is local to a row; nothing is shuffled. Plain Latin text is cut into pre-tokens by one pattern, other
pieces between spaces, which no pre-token crosses, by the library's steps; ids of short pre-tokens are
remembered per worker (at most ``REMEMBERED``).

Defined results: null and empty texts have no ids, and null or empty id lists decode to the empty
text; ids outside the vocabulary and null ids are passed over in decoding; repeated rows have equal
results; an empty table gives an empty result. Columns ``ids`` and ``decoded`` of the input are
replaced, others pass through, whatever their names. Every worker reads the tokenizer
file from its path, so that file must be there on all of them.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from landshift.llm import words

REMEMBERED = 400_000
SHORT = 64  # characters of a pre-token that is remembered
SEGMENT = 1 << 18  # ids that are decoded at a time
MARK = 0x10000  # added to the last character of a word

# The steps of the public word file, and what they do to pieces of plain Latin characters, which
# no step composes and whose lower case does not depend on their neighbours. Other pieces take the library's steps.
WORD_STEPS = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pattern": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
}
ODD = re.compile("[^\t-\r -~À-ÖØ-öø-ÿ]")
STRETCH = 1 << 16  # characters of plain text that are cut into words at a time
PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARACTERS = {b: b for b in _SHOWN} | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def public_vocabulary() -> str:
    """Where the word tokenizer of the public files lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Merges:
    """Tokens by id with their ranks and halves, and the table of compatible pairs."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.suffix = suffix
        self.id_of = vocabulary
        never = len(merges)
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(merges):
            whole = vocabulary[left + right]
            pair = (vocabulary[left], vocabulary[right])
            if whole in self.halves or max(self.rank.get(p, -1) for p in pair) >= rank:
                raise ValueError(f"merge {rank} makes a token again or before its parts")
            self.rank[whole], self.halves[whole], self.joined[pair] = rank, pair, rank
        self.never = never
        self.table: dict[tuple[int, int], bool] = {}
        self.along: tuple[dict, dict] = ({}, {})

    def sides(self, token: int, side: int) -> list[tuple[int, int]]:
        """(part, rank at which it is used up) along one side of a token, from the single character on."""
        known = self.along[side].get(token)
        if known is None:
            out, until, part = [], self.never, token
            while True:
                out.append((part, until))
                if part not in self.halves:
                    break
                until, part = self.rank[part], self.halves[part][side]
            known = self.along[side][token] = out[::-1]
        return known

    def crossing(self, left: int, right: int) -> tuple[int, int] | None:
        """The first pair of parts that merges across the seam of two tokens."""
        ones, twos = iter(self.sides(left, 1)), iter(self.sides(right, 0))
        (one, one_until), (two, two_until) = next(ones), next(twos)
        joined, never = self.joined, self.never
        while True:
            rank = joined.get((one, two))
            # Of equal merges the leftmost goes first: the left token's own, then the seam's.
            if rank is not None and rank < one_until and rank <= two_until:
                return one, two
            if one_until <= two_until:
                if one_until == never:  # both tokens are whole
                    return None
                one, one_until = next(ones)
            else:
                two, two_until = next(twos)

    def compatible(self, left: int, right: int) -> bool:
        known = self.table.get((left, right))
        if known is None:
            if len(self.table) >= REMEMBERED:
                self.table.clear()
            known = self.table[left, right] = self.crossing(left, right) is None
        return known

    def reachable(self) -> set[int]:
        """Tokens that the merges give for their own text."""
        good = {t for t in self.id_of.values() if t not in self.halves}
        for token, pair in self.halves.items():  # in the order of ranks: parts come first
            if good.issuperset(pair) and self.crossing(*pair) == pair:
                good.add(token)
        return good


class Encoder:
    """Encodes words over byte characters, the last one marked."""

    def __init__(self, merges: Merges):
        import ahocorasick

        self.merges = merges
        self.automaton = ahocorasick.Automaton()
        spelled: dict[str, int] = {}
        good = merges.reachable()
        for token, number in merges.id_of.items():
            ends = bool(merges.suffix) and token.endswith(merges.suffix) and len(token) > len(merges.suffix)
            word = self.marked(token[: -len(merges.suffix)]) if ends else token
            if number in good and word:
                spelled[word] = number
                self.automaton.add_word(word, number)
        self.automaton.make_automaton()
        self.size = {number: len(word) for word, number in spelled.items()}
        self.spelled = spelled
        self.prefix: dict[int, int | None] = {}
        for word, number in spelled.items():
            self.prefix[number] = next((spelled[word[:k]] for k in range(len(word) - 1, 0, -1) if word[:k] in spelled), None)

    def marked(self, word: str) -> str:
        return word[:-1] + chr(ord(word[-1]) + MARK) if self.merges.suffix else word

    def encode(self, word: str) -> list[int]:
        word = self.marked(word)
        whole = self.spelled.get(word)
        if whole is not None:
            return [whole]
        size, prefix, table, compatible = self.size, self.prefix, self.merges.table, self.merges.compatible
        # The longest token that starts at each place; later ends are longer.
        longest: list[int | None] = [None] * (len(word) + 1)
        for end, number in self.automaton.iter(word):
            longest[end - size[number] + 1] = number
        dead = None
        out: list[int] = []
        place, token, last = 0, longest[0], None
        while place < len(word):
            while token is not None:
                stop = place + size[token]
                if dead is None or not dead[stop]:
                    if last is None:
                        break
                    fits = table.get((last, token))
                    if fits is None:
                        fits = compatible(last, token)
                    if fits:
                        break
                token = prefix[token]
            if token is not None:
                out.append(token)
                place, last = stop, token
                token = longest[place]
                continue
            if dead is None:
                dead = bytearray(len(word) + 1)
            dead[place] = 1
            if not out:
                raise ValueError("the vocabulary lacks a byte of this word")
            token = out.pop()
            place -= size[token]
            last = out[-1] if out else None
        return out


class Remembered(dict):
    """Results for words, of which short ones are kept, at most ``REMEMBERED`` of them in two generations."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> bytes:
        made = self.old.get(word)
        if made is None:
            made = self.make(word)
        if len(word) <= SHORT:
            if 2 * len(self) >= REMEMBERED:  # words that are met again move on, the others are forgotten
                self.old = dict(self)
                self.clear()
            self[word] = made
        return made


class Codec:
    """A tokenizer file: text to ids and back."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        flags = ("single_word", "lstrip", "rstrip", "normalized")
        odd += [f for t in spec["added_tokens"] for f in flags if t[f]]
        if model["type"] != "BPE" or odd or spec.get("decoder"):
            raise ValueError(f"not a plain BPE file: {path} {odd}")
        steps = Tokenizer.from_file(path)
        self.normalize = steps.normalizer.normalize_str if steps.normalizer else str
        self.split = steps.pre_tokenizer.pre_tokenize_str
        first = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        told = {"normalizer": (spec["normalizer"] or {}).get("normalizers"), "pattern": first.get("pattern", {}).get("Regex")}
        self.odd = ODD if told == WORD_STEPS else re.compile("[^ ]")  # others: every piece takes the library's steps
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.encoder = Encoder(Merges(model["vocab"], pairs, model.get("end_of_word_suffix") or ""))
        self.special = {t["content"]: self._packed([t["id"]]) for t in spec["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.words = Remembered(lambda word: self._packed(self.encoder.encode(word)))
        names = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        spelled = [names[i].encode() + b" " if i in names else b"" for i in range(max(names) + 1)] + [b""]
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in spelled])])
        self.bytes = np.frombuffer(b"".join(spelled), dtype=np.uint8)

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def _plain(self, text: str) -> Iterator[bytes]:
        """Ids of plain text, a stretch of whole pieces at a time."""
        begin = 0
        while begin < len(text):
            stop = text.find(" ", begin + STRETCH)
            part = text[begin : stop if stop >= 0 else len(text)].lower()
            cut = PLAIN_WORDS.findall(part)
            if not part.isascii():
                cut = [word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_CHARACTERS) for word in cut]
            yield b"".join(map(self.words.__getitem__, cut))
            begin += max(len(part), 1)

    def _text(self, text: str) -> bytes:
        """Ids of a text without special tokens. Pieces with odd characters take the file's own steps."""
        out, done = [], 0
        for odd in self.odd.finditer(text):
            if odd.start() < done:
                continue
            begin = text.rfind(" ", 0, odd.start()) + 1
            stop = text.find(" ", odd.end())
            stop = len(text) if stop < 0 else stop
            out += self._plain(text[done:begin])
            out += [self.words[word] for word, _ in self.split(self.normalize(text[begin:stop]))]
            done = stop
        out += self._plain(text[done:])
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not self.cut.search(text):
            return self._text(text)
        return b"".join([self.special[part] if n % 2 else self._text(part) for n, part in enumerate(self.cut.split(text))])

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and row bounds of the texts whose ids are ids[bounds[i]:bounds[i+1]]."""
        blank = len(self.offsets) - 2
        ids = np.where((ids < 0) | (ids > blank), blank, ids)
        size = self.offsets[ids + 1] - self.offsets[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(int(ends[-1]), dtype=np.uint8)
        for begin in range(0, len(ids), SEGMENT):
            stop = min(begin + SEGMENT, len(ids))
            low, high = int(ends[begin]), int(ends[stop])
            shift = np.repeat(self.offsets[ids[begin:stop]] - ends[begin:stop], size[begin:stop])
            out[low:high] = self.bytes[np.arange(low, high) + shift]
        places = ends[bounds]
        filled = np.diff(places) > 0  # the space behind the last token of a row goes
        keep = np.ones(len(out), dtype=bool)
        keep[places[1:][filled] - 1] = False
        return out[keep], places - np.concatenate([[0], np.cumsum(filled)])


@lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    return Codec(path)


def _replaced(frame: DataFrame, name: str, kind: T.DataType) -> tuple[DataFrame, T.StructType, list[str]]:
    kept = [c for c in frame.columns if c != name]
    fields = [frame.schema[c] for c in kept] + [T.StructField(name, kind)]
    return frame, T.StructType(fields), kept


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The documents with column ``ids``, array<int>: the ids of column ``text``."""
    docs, schema, kept = _replaced(docs, "ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary)
        for batch in words.slices(batches):
            packed = [codec.encode(text) if text else b"" for text in batch.column("text").to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed], dtype=np.int64)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], ids], schema.fieldNames())

    return docs.mapInArrow(run, schema)


def id_lists(column: pa.Array, rows: int = SEGMENT) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, ids, bounds) of a list column, about ``rows`` ids at a time; null lists are empty, null ids -1."""
    sizes = np.array(column.value_lengths().fill_null(0), dtype=np.int64)
    total, start = np.cumsum(sizes), 0
    while start < len(column):
        done = total[start - 1] if start else 0
        stop = max(int(np.searchsorted(total, done + rows, side="right")), start + 1)
        flat = column.slice(start, stop - start).flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        yield stop - start, flat.astype(np.int64), np.concatenate([[0], np.cumsum(sizes[start:stop])])
        start = stop


def decode(rows: DataFrame, vocabulary: str) -> DataFrame:
    """The rows with column ``decoded``: the text of column ``ids``."""
    rows, schema, kept = _replaced(rows, "decoded", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary)
        for batch in batches:
            at = 0
            for n, ids, bounds in id_lists(batch.column("ids")):
                data, places = codec.decode(ids, bounds)
                texts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data))
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], texts.cast(pa.string())], schema.fieldNames())
                at += n

    return rows.mapInArrow(run, schema)


def with_id_digest(rows: DataFrame, name: str = "ids_sha256") -> DataFrame:
    """SHA-256 of the ids as little-endian unsigned 32-bit integers, in place of column ``ids``."""
    rows, schema, kept = _replaced(rows, name, T.StringType())
    kept = [c for c in kept if c != "ids"]
    schema = T.StructType([f for f in schema.fields if f.name != "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = []
            for n, ids, bounds in id_lists(batch.column("ids")):
                packed = memoryview(ids.astype("<u4").tobytes())
                hashes += [hashlib.sha256(packed[4 * bounds[k] : 4 * bounds[k + 1]]).hexdigest() for k in range(n)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(hashes, pa.string())], schema.fieldNames())

    return rows.mapInArrow(run, schema)
