"""Byte-level BPE by replaying the merges over all words at once.

The pattern of the vocabulary splits texts into words, and merges never cross
them. So a corpus is encoded by its different words: a task gathers those of the
documents it reads and replays the merges over all of them together. An inverted
index leads from each token that a pair of neighbours would make to the places
of such pairs in all words. The lowest rank in the index comes next, all its
places are merged, and only the neighbours of those places are looked at anew.
Texts are then spelled by their words' ids.

Nothing is shuffled. To share words between tasks would cost more than it saves:
a fifth of the words of some megabytes of text occur once in them.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Characters of text that are read before their words are encoded; a longer text comes alone.
CHUNK_CHARS = 1 << 22
#: Bytes of words and ids that a task remembers, with what a word takes besides.
REMEMBERED_BYTES, WORD_BYTES = 1 << 27, 200
#: Bytes of words that the merges are replayed over at once; a longer word is a block alone.
BLOCK_BYTES = 1 << 22
END = -1
#: Places of a rank from which on they are merged in bulk.
BULK = 24


@lru_cache(2)
def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes of each token by rank; the rank is the token's id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(2)
def tokens_by_id(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}


class Replay:
    """Words as linked tokens, and the index over their pairs."""

    def __init__(self, words: list[bytes], ranks: dict[bytes, int]):
        self.ranks, self.none = ranks, len(ranks)
        self.piece = {rank: text for text, rank in ranks.items()}
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(sizes)
        single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        letters = single[np.frombuffer(b"".join(words), dtype=np.uint8)]
        place = np.arange(len(letters), dtype=np.int32)
        last, first = self.ends[sizes > 0] - 1, (self.ends - sizes)[sizes > 0]
        after, before = place + 1, place - 1
        after[last] = before[first] = END
        # One memory, read and written singly by the arrays and in bulk by the views.
        self.token, self.after, self.before = (array("i", x.tobytes()) for x in (letters, after, before))
        self.tokens, self.afters, self.befores = (
            np.frombuffer(x, dtype=np.int32) for x in (self.token, self.after, self.before)
        )
        self.word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        self.known: dict[int, int] = {}  # pair -> rank of what it makes
        self.places: dict[int, array] = {}
        self.queue: list[int] = []
        left = np.flatnonzero(after != END)
        self.enter_all(left, letters[left].astype(np.int64) * self.none + letters[left + 1])

    def made(self, pair: int) -> int:
        """The rank of the token that a pair makes, or one above all."""
        rank = self.known.get(pair)
        if rank is None:
            left, right = divmod(pair, self.none)
            rank = self.known[pair] = self.ranks.get(self.piece[left] + self.piece[right], self.none)
        return rank

    def listed(self, rank: int) -> array:
        found = self.places.get(rank)
        if found is None:
            found = self.places[rank] = array("i")
            heapq.heappush(self.queue, rank)
        return found

    def enter(self, left: int, pair: int) -> int:
        rank = self.made(pair)
        if rank < self.none:
            self.listed(rank).append(left)
        return rank

    def enter_all(self, left: np.ndarray, pairs: np.ndarray) -> None:
        different, which = np.unique(pairs, return_inverse=True)
        rank = np.array([self.made(p) for p in different.tolist()], dtype=np.int64)[which]
        left, rank = left[rank < self.none], rank[rank < self.none]
        order = np.argsort(rank, kind="stable")
        left, rank = left[order].astype(np.int32), rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for some, r in zip(np.split(left, cuts), rank[np.concatenate([[0], cuts])].tolist() if len(rank) else []):
            self.listed(r).frombytes(some.tobytes())

    def merge_all(self, rank: int, left: np.ndarray) -> None:
        """Merges at places in different words."""
        right = self.afters[left]
        beyond, previous = self.afters[right], self.befores[left]
        self.tokens[left], self.tokens[right], self.afters[left] = rank, END, beyond
        at = beyond != END
        self.befores[beyond[at]] = left[at]
        self.enter_all(left[at], rank * self.none + self.tokens[beyond[at]].astype(np.int64))
        at = previous != END
        self.enter_all(previous[at], self.tokens[previous[at]].astype(np.int64) * self.none + rank)

    def merge_in_turn(self, rank: int, places: list[int]) -> list[int]:
        """Merges at places in order. The places that have to wait, as a merge in
        their word made a pair of lower rank."""
        token, after, before, none = self.token, self.after, self.before, self.none
        word_end, waiting = 0, []
        for left in places:
            if left < word_end:
                waiting.append(left)
                continue
            right = after[left]
            if token[left] == END or right == END or self.made(token[left] * none + token[right]) != rank:
                continue
            beyond, previous = after[right], before[left]
            token[left], token[right], after[left] = rank, END, beyond
            lowest = rank
            if beyond != END:
                before[beyond] = left
                lowest = min(lowest, self.enter(left, rank * none + token[beyond]))
            if previous != END:
                lowest = min(lowest, self.enter(previous, token[previous] * none + rank))
            if lowest < rank:
                word_end = int(self.ends[self.word[left]])
        return waiting

    def run(self) -> None:
        while self.queue:
            rank = heapq.heappop(self.queue)
            found = self.places.pop(rank)
            if len(found) < BULK:
                waiting = self.merge_in_turn(rank, sorted(found))
            else:
                left = np.unique(np.frombuffer(found, dtype=np.int32))
                left = left[(self.tokens[left] != END) & (self.afters[left] != END)]
                pairs = self.tokens[left].astype(np.int64) * self.none + self.tokens[self.afters[left]]
                different, which = np.unique(pairs, return_inverse=True)
                left = left[np.array([self.made(p) == rank for p in different.tolist()], dtype=bool)[which]]
                word = self.word[left]
                again = np.zeros(len(left), dtype=bool)  # words with several places
                again[1:] |= word[1:] == word[:-1]
                again[:-1] |= word[1:] == word[:-1]
                waiting = self.merge_in_turn(rank, left[again].tolist())
                self.merge_all(rank, left[~again])
            if waiting:
                self.listed(rank).extend(waiting)

    def ids(self) -> list[bytes]:
        kept = self.tokens != END
        ids, upto = self.tokens[kept].astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(kept)])
        ends = upto[self.ends].tolist()
        return [ids[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]


def replay(words: list[bytes], ranks: dict[bytes, int]) -> list[bytes]:
    """The ids of every word, packed as little-endian unsigned 32-bit integers.

    The lowest rank in the index comes next, with its places in all words. A merge
    can make a pair of lower rank only within its word; the other places of that
    word then wait until the lower rank has had its turn, as they would if the
    word stood alone.
    """
    state = Replay(words, ranks)
    state.run()
    return state.ids()


@lru_cache(1)
def unknown_characters() -> tuple[int, ...]:
    """Code points that ``regex`` takes for letters or digits and the library of
    the vocabulary does not, as it knows an older Unicode. Only such as Python's
    own, still older one leaves unassigned can be among them."""
    everything = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    newer = [c for c in regex.findall(r"[\p{L}\p{N}]", everything) if unicodedata.category(c) == "Cn"]
    signs = {b"!" + lead for lead in {c.encode()[:1] for c in newer}}
    ranks = {**{bytes([b]): b for b in range(256)}, **{s: 256 + i for i, s in enumerate(sorted(signs))}}
    # Beside a sign, only what is neither letter nor digit is in one word with it.
    probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return tuple(ord(c) for c in newer if len(probe.encode_ordinary("!" + c)) == len(c.encode()))


class Splitter:
    """Splits texts into words as the library does."""

    def __init__(self, pattern: str, unknown: tuple[int, ...]):
        self.pattern, self.unknown = regex.compile(pattern), unknown
        self.signs = dict.fromkeys(unknown, "\ue000")
        self.newer = frozenset(map(chr, unknown))

    def known(self, words: Iterable[str]) -> bool:
        return self.newer.isdisjoint(set("".join(words)))

    def words(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def words_around_unknown(self, text: str) -> list[str]:
        """With unknown characters read as signs."""
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.signs))]


def in_chunks(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """Rows of (doc_id, text) with up to ``most`` characters together."""
    chunk, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            text = text or ""
            if chunk and size + len(text) > most:
                yield chunk
                chunk, size = [], 0
            chunk.append((doc_id, text))
            size += len(text)
    if chunk:
        yield chunk


class Vocabulary:
    """The different words seen so far, numbered, and their ids."""

    def __init__(self, ranks: dict[bytes, int], split: Splitter, block_bytes: int):
        self.ranks, self.split, self.block_bytes = ranks, split, block_bytes
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.bytes = 0

    def spelled(self, texts: list[str]) -> list[np.ndarray]:
        """Each text as numbers of its words."""
        numbers, seen = self.numbers, len(self.numbers)

        def by(words_of: Callable[[str], list[str]]) -> list[np.ndarray]:
            return [np.array([numbers.setdefault(w, len(numbers)) for w in words_of(t)], dtype=np.int32) for t in texts]

        found = by(self.split.words)
        return found if self.split.known(islice(numbers, seen, None)) else by(self.split.words_around_unknown)

    def learn(self) -> None:
        """Replays the merges over the words that have no ids yet, in blocks."""
        block, size = [], 0
        for word in [w.encode() for w in islice(self.numbers, len(self.ids), None)]:
            if block and size + len(word) > self.block_bytes:
                self._add(block)
                block, size = [], 0
            block.append(word)
            size += len(word)
        if block:
            self._add(block)

    def _add(self, block: list[bytes]) -> None:
        found = replay(block, self.ranks)
        self.ids += found
        self.bytes += sum(map(len, block)) + sum(map(len, found)) + WORD_BYTES * len(block)

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.bytes > REMEMBERED_BYTES:
            self.forget()
        spelled = self.spelled(texts)
        self.learn()
        return [b"".join(map(self.ids.__getitem__, s.tolist())) for s in spelled]


def encode(
    docs: DataFrame,
    path: str = RANKS,
    pattern: str = public_tokenizers.PATTERN,
    chunk_chars: int = CHUNK_CHARS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id and ids of every row of ``docs`` (doc_id, text): the ids of the
    whole text as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. Repeated rows and rows without doc_id are
    rows like any other. A text is read whole, however long; it and its words are
    what a task holds at least. Empty tables give no rows; other columns are not
    read.
    """
    rows = docs.select("doc_id", "text")
    output = StructType([rows.schema["doc_id"], StructField("ids", BinaryType())])
    schema, unknown = to_arrow_schema(output), unknown_characters()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(read_ranks(path), Splitter(pattern, unknown), block_bytes)
        for chunk in in_chunks(batches, chunk_chars):
            doc_ids, texts = zip(*chunk)
            columns = zip((doc_ids, words.encode(texts)), schema.types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], schema=schema)

    return rows.mapInArrow(task, output)


def decoded(ids: Column, path: str = RANKS) -> Column:
    """The bytes that packed ids stand for."""

    @F.pandas_udf("binary")
    def decode(batch: pd.Series) -> pd.Series:
        token = tokens_by_id(path).__getitem__
        return batch.map(lambda packed: b"".join(map(token, np.frombuffer(packed, dtype="<u4").tolist())))

    return decode(ids)


def unpacked(ids: Column) -> Column:
    """Packed ids as an array of longs."""

    @F.pandas_udf("array<bigint>")
    def unpack(batch: pd.Series) -> pd.Series:
        return batch.map(lambda packed: np.frombuffer(packed, dtype="<u4").astype(np.int64))

    return unpack(ids)


def round_trip(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to."""
    return encode(docs, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(decoded(F.col("ids"), path), 256).alias("decoded_sha256"),
    )
