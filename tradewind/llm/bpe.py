"""Byte-pair encoding and decoding of whole texts with a given public vocabulary.

Text is cut into pre-tokens (contractions, letters, digits, other signs, white space). The bytes of
a pre-token form a doubly linked list of symbols; every neighbouring pair that may merge waits in a
priority queue under its merge rank and place. The lowest entry merges, its neighbours are
queued anew, and entries whose symbols have changed meanwhile are stale and skipped. So a
pre-token of n bytes costs n log n, however long it is. Decoding concatenates vocabulary strings.

Each document is encoded where it lies; nothing is shuffled. Texts are cut into sections between a
sign and the white space after it, where no pre-token crosses, so whole texts of any length need
memory for their ids and one section. The vocabulary (one file, its size is fixed) is read on
the driver and broadcast; each worker keeps the ids of pre-tokens it met, up to `CACHE_WORDS`.

Defined results: a NULL or empty text has no ids, NULL ids decode to the empty text; ids that the
vocabulary does not have decode to nothing; bytes that are no UTF-8 after decoding become U+FFFD.
Repeated rows are encoded each; an empty table gives no rows. `encode` returns the id column
and `ids` only; `decode` keeps the columns of its input and replaces the text column.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator, Sequence
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SECTION_CHARS = 1 << 16
CACHE_WORDS = 1 << 18
CACHED_WORD_CHARS = 64
BATCH_IDS = 1 << 20

# Fixed value: the pre-token pattern of this family of vocabularies.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_SECTION_END = regex.compile(r"\S(?=\s)")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary strings: itself where it prints, else from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """Ids of single bytes, ranks of pairs of ids and what they merge to, the bytes of every id, added strings."""

    def __init__(self, content: bytes):
        told = json.loads(content)
        ids = told["model"]["vocab"]
        letters = byte_letters()
        byte_of = {letter: b for b, letter in enumerate(letters)}
        self.byte_ids = [ids[letter] for letter in letters]
        self.stride = max(ids.values()) + 1
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(told["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[ids[left] * self.stride + ids[right]] = rank
            self.merged.append(ids[left + right])
        self.strings = {i: bytes(byte_of[c] for c in s) for s, i in ids.items()}
        self.added = {a["content"]: a["id"] for a in told["added_tokens"]}
        self.strings.update((i, s.encode()) for s, i in self.added.items())
        by_length = sorted(self.added, key=len, reverse=True)
        self._added_pattern = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        self._known = set(map(chr, range(128)))
        self._words = _Words(self)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        rank_of, stride, n = self.ranks.get, self.stride, len(word)
        symbols = [self.byte_ids[b] for b in word]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        # The rank of the pair that starts at each place; an entry of the queue with another one is stale.
        waiting = [rank_of(left * stride + right, -1) for left, right in zip(symbols, symbols[1:])]
        waiting.append(-1)
        queue = [rank * n + i for i, rank in enumerate(waiting) if rank >= 0]
        heapify(queue)
        while queue:
            rank, i = divmod(heappop(queue), n)
            if waiting[i] != rank:
                continue
            merged, j = self.merged[rank], after[i]
            symbols[i], symbols[j], waiting[j] = merged, -1, -1
            k, h = after[j], before[i]
            after[i], found = k, -1
            if k < n:
                before[k] = i
                found = rank_of(merged * stride + symbols[k], -1)
                if found >= 0:
                    heappush(queue, found * n + i)
            waiting[i] = found
            if h >= 0:
                waiting[h] = found = rank_of(symbols[h] * stride + merged, -1)
                if found >= 0:
                    heappush(queue, found * n + h)
        return [s for s in symbols if s >= 0]

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of a text, section by section, as packed 32-bit numbers; added strings stand for their own ids."""
        pieces = self._added_pattern.split(text) if self._added_pattern else [text]
        for piece in pieces:
            if piece in self.added:
                yield array("i", [self.added[piece]]).tobytes()
                continue
            for section in _sections(piece):
                yield b"".join(map(self._words.__getitem__, self._pre_tokens(section)))

    def decode(self, ids: Sequence[int]) -> str:
        strings = self.strings
        try:
            found = b"".join(map(strings.__getitem__, ids))
        except KeyError:
            found = b"".join(strings.get(i, b"") for i in ids)
        return found.decode("utf-8", "replace")

    def _pre_tokens(self, section: str) -> list[str]:
        """Characters younger than this Python's own tables may be letters to one library and signs to
        another; sections that hold one are cut by the vocabulary's library itself."""
        if not section.isascii():
            met = set(section) - self._known
            if met:
                young = {c for c in met if unicodedata.category(c) == "Cn"}
                self._known |= met - young
                if young:
                    from tokenizers.pre_tokenizers import ByteLevel

                    cut = ByteLevel(add_prefix_space=False).pre_tokenize_str(section)
                    return [section[a:b] for _, (a, b) in cut]
        return PRE_TOKEN.findall(section)


class _Words(dict):
    """Packed ids of pre-tokens, computed when first met."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self._vocabulary = vocabulary

    def __missing__(self, word: str) -> bytes:
        ids = array("i", self._vocabulary.merge(word.encode())).tobytes()
        if len(word) <= CACHED_WORD_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


def _sections(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > SECTION_CHARS:
        end = _SECTION_END.search(text, start + SECTION_CHARS)
        if end is None:
            break
        yield text[start : end.end()]
        start = end.end()
    yield text[start:] if start else text


@cache
def _vocabulary(content: bytes) -> Vocabulary:
    return Vocabulary(content)


def _shipped(df: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids"
) -> DataFrame:
    """(id, ids) of every row; `vocabulary` is the path of a byte-level BPE file on the driver."""
    content = _shipped(docs, vocabulary)
    narrow = docs.select(docs[id_col], docs[text_col])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(content.value)
        for part in parts:
            first, packed, ends = 0, bytearray(), [0]
            for row, text in enumerate(part.column(1)):
                for ids in known.encode(text.as_py() or ""):
                    packed += ids
                ends.append(len(packed) // 4)
                if ends[-1] >= BATCH_IDS or row == part.num_rows - 1:
                    flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(bytes(packed))])
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).slice(first, row + 1 - first), lists], names=[id_col, ids_col]
                    )
                    first, packed, ends = row + 1, bytearray(), [0]

    schema = T.StructType([docs.schema[id_col], T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))])
    return narrow.mapInArrow(batches, schema)


def decode(coded: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """`coded` with the text its ids stand for."""
    content = _shipped(coded, vocabulary)
    kept = coded.select(*[coded[c] for c in coded.columns if c != text_col])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(content.value)
        for part in parts:
            lists = part.column(part.schema.get_field_index(ids_col))
            flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().fill_null(0).to_numpy()
            ends = np.cumsum(sizes)
            texts = [known.decode(flat[end - size : end].tolist()) for end, size in zip(ends, sizes)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, text_col]
            )

    return kept.mapInArrow(batches, T.StructType([*kept.schema.fields, T.StructField(text_col, T.StringType())]))
