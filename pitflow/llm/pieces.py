"""Sampled SentencePiece segmentations, and lossless decoding.

All ways to write a text in pieces form a lattice. Forward filtering sums the
weight of all ways up to each place; backward sampling then draws one way with
its exact probability, from random numbers that depend on the row's key and the
place only. Where no piece holds two neighbouring characters, the lattice is
one node wide, so the text is cut there and each part is drawn for itself:
equal parts share one forward pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitflow.llm.letters import code_points

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED, SHARPNESS = 1, 0.5
SPACE = "▁"
#: Code points whose lattice a task holds at once; a longer text comes alone.
LATTICE_CHARS = 1 << 18

#: Steps that a probability is cut into.
GRAIN = 1 << 30
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@cache
def read_pieces(path: str) -> tuple[str | None, ...]:
    """The pieces of a model by id; byte pieces as one character in brackets,
    None for ids that stand for no text."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out: list[str | None] = []
    for i in range(model.get_piece_size()):
        silent = model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        out.append(None if silent else model.id_to_piece(i))
    return tuple(out)


class Lattice:
    """A piece vocabulary ready for encoding and decoding many texts."""

    def __init__(self, pieces: Sequence[str | None], sharpness: float = SHARPNESS):
        self.byte_id = np.full(256, -1, dtype=np.int32)
        self.written: list[bytes | None] = []
        plain: list[tuple[str, int]] = []
        for i, piece in enumerate(pieces):
            if piece is not None and len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
                byte = int(piece[3:5], 16)
                self.byte_id[byte] = i
                self.written.append(bytes([byte]))
            elif piece is not None:
                plain.append((piece, i))
                self.written.append(piece.replace(SPACE, " ").encode())
            else:
                self.written.append(None)
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary needs a piece for every byte")
        # A model of merges ranks its pieces; a piece weighs as Zipf's law has it.
        weight = 1 / np.arange(2, len(plain) + 2)
        logs = dict(zip((i for _, i in plain), sharpness * np.log(weight / weight.sum())))
        self.log_weight = np.zeros(len(pieces))
        self.log_weight[list(logs)] = list(logs.values())
        letters = sorted({c for p, _ in plain for c in p})
        self.code = np.zeros(0x110001, dtype=np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        self.joined = np.zeros((self.width, self.width), dtype=bool)
        children: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for piece, i in plain:
            node, path = 0, self.code[code_points(piece)].tolist()
            for c in path:
                node = children.setdefault((node, c), len(children) + 1)
            ends[node] = i
            self.joined[path[:-1], path[1:]] = True
        self.longest = max(len(p) for p, _ in plain)
        self.piece_at = np.full(len(children) + 1, -1, dtype=np.int32)
        self.piece_at[list(ends)] = list(ends.values())
        self._hash(children)

    def _hash(self, children: dict[tuple[int, int], int]) -> None:
        """The trie's steps in an open table: (node, letter) -> node."""
        self.bits = max(4, (8 * len(children)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.nodes = np.zeros(1 << self.bits, dtype=np.int32)
        for (node, c), child in children.items():
            key = node * self.width + c
            slot = int(self._slot(np.array([key]))[0])
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.nodes[slot] = key, child

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _GOLDEN) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The trie nodes one letter on; 0 where there is none."""
        key = node.astype(np.int64) * self.width + letter
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.nodes[slot], 0)
        open_ = np.flatnonzero((held != key) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.nodes[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def encode(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each text has)."""
        lengths = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
        points = code_points("".join(f" {t}" for t in texts if t)).copy()
        if not len(points):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        points[points == ord(SPACE)] = 0x110000  # a real one is spelled in bytes
        letter = self.code[np.where(points == ord(" "), ord(SPACE), points)]
        first = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(texts)), lengths)
        new = np.ones(len(letter), dtype=bool)
        new[1:] = ~self.joined[letter[:-1], letter[1:]]
        new[first[lengths > 0]] = True
        with np.errstate(over="ignore"):
            place = (np.arange(len(letter)) - first[owner]).astype(np.uint64)
            draw = keys.astype(np.uint64)[owner] + (place + np.uint64(1)) * _GOLDEN
            draw = (draw ^ (draw >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            draw = (draw ^ (draw >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            chance = ((draw ^ (draw >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        chosen = self._sample(letter, np.flatnonzero(new), chance)
        return self._with_bytes(points, letter, chosen, owner, len(texts))

    def encode_rows(self, texts: list[str | None], keys: np.ndarray) -> list[np.ndarray | None]:
        """The ids of each text, None for a null one."""
        rows: list[np.ndarray | None] = []
        for a, b in small_parts(texts):
            found, many = self.encode([t or "" for t in texts[a:b]], keys[a:b])
            parts = np.split(found, np.cumsum(many)[:-1])
            rows += [None if t is None else p for t, p in zip(texts[a:b], parts)]
        return rows

    def _with_bytes(self, points, letter, chosen, owner, n) -> tuple[np.ndarray, np.ndarray]:
        """Pieces in order, characters without a piece spelled in bytes."""
        odd = letter == 0
        spelled = np.where(points[odd] == 0x110000, ord(SPACE), points[odd])
        size = 1 + (spelled > 0x7F).astype(np.int64) + (spelled > 0x7FF) + (spelled > 0xFFFF)
        many = (chosen >= 0).astype(np.int64)
        many[odd] = size
        out = np.repeat(chosen, many)
        raw = spelled.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        out[np.repeat(odd, many)] = self.byte_id[np.frombuffer(raw, dtype=np.uint8)]
        return out, np.bincount(owner, weights=many, minlength=n).astype(np.int64)

    def _distinct(self, letter, start, size) -> tuple[np.ndarray, np.ndarray]:
        """(one segment of each kind, kind of each segment)."""
        at = np.arange(len(letter)) - np.repeat(start, size)
        powers = np.full(int(size.max()), np.uint64(0xD6E8FEB86659FD93))
        powers[0] = 1
        powers = np.cumprod(powers)
        with np.errstate(over="ignore"):
            spread = (letter.astype(np.uint64) + np.uint64(1)) * _GOLDEN
            spread ^= spread >> np.uint64(31)
            sums = np.add.reduceat(spread * powers[at], start) * _GOLDEN + size.astype(np.uint64)
        _, one, kind = np.unique(sums, return_index=True, return_inverse=True)
        same = (size == size[one[kind]]).all() and (
            letter == letter[np.repeat(start[one[kind]], size) + at]
        ).all()
        return (one, kind) if same else (np.arange(len(start)), np.arange(len(start)))

    def _sample(self, letter: np.ndarray, start: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """The drawn piece at the last character of each, -1 elsewhere."""
        size = np.diff(np.append(start, len(letter)))
        one, kind = self._distinct(letter, start, size)
        length = size[one]
        base = np.cumsum(length + 1) - (length + 1)  # nodes: one before each letter and one at the end
        inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        node = np.repeat(base, length) + inside
        own = letter[np.repeat(start[one], length) + inside]
        left = np.repeat(length, length) - inside
        source, target, piece, depth = [], [], [], []
        at, trie, reach = np.arange(len(own)), np.zeros(len(own), np.int32), 0
        while len(at):
            trie = self.step(trie, own[at + reach])
            reach += 1
            live = trie > 0
            at, trie = at[live], trie[live]
            ids = self.piece_at[trie]
            ended = ids >= 0
            source.append(node[at[ended]])
            target.append(node[at[ended]] + reach)
            piece.append(ids[ended])
            depth.append(inside[at[ended]] + reach)
            on = left[at] > reach
            at, trie = at[on], trie[on]
        # A character without a piece is a segment of its own: a step without weight.
        lost = own == 0
        source.append(node[lost])
        target.append(node[lost] + 1)
        piece.append(np.full(int(lost.sum()), -1, np.int32))
        depth.append(inside[lost] + 1)
        source, target, piece, depth = map(np.concatenate, (source, target, piece, depth))
        # By depth, node and length, a unique key: a draw must not depend on the batch.
        nodes = int((length + 1).sum())
        order = np.argsort((depth * nodes + target) * (self.longest + 1) + (target - source))
        source, target, piece, depth = source[order], target[order], piece[order], depth[order]
        weight = np.where(piece >= 0, self.log_weight[piece], 0.0)
        total = np.zeros(nodes)
        share = np.empty(len(source))
        edge_of = np.zeros(len(total) + 1, np.int64)  # the first edge into each node
        degree = np.zeros(len(total), np.int64)
        levels = np.flatnonzero(np.append(True, depth[1:] != depth[:-1]))
        for a, b in zip(levels, np.append(levels[1:], len(depth))):
            value = total[source[a:b]] + weight[a:b]
            heads = np.flatnonzero(np.append(True, target[a + 1 : b] != target[a : b - 1]))
            many = np.diff(np.append(heads, b - a))
            top = np.maximum.reduceat(value, heads)
            part = np.exp(value - np.repeat(top, many))
            whole = np.add.reduceat(part, heads)
            share[a:b] = part / np.repeat(whole, many)
            into = target[a:b][heads]
            total[into] = top + np.log(whole)
            edge_of[into], degree[into] = a + heads, many
        # Whole numbers add up exactly, whatever else is in the batch.
        share = np.rint(share * GRAIN).astype(np.int64)
        upto = np.cumsum(share)
        before = upto - share
        chosen = np.full(len(letter), -1, dtype=np.int32)
        low = base[kind]
        here, end = low + size, start + size - 1
        while len(here):
            first = edge_of[here]
            want = before[first] + (chance[end] * GRAIN).astype(np.int64)
            edge, last = first, first + degree[here] - 1
            for _ in range(int(degree[here].max() - 1).bit_length()):
                middle = (edge + last) >> 1
                right = upto[middle] <= want
                edge = np.where(right, np.minimum(middle + 1, last), edge)
                last = np.where(right, last, middle)
            chosen[end] = piece[edge]
            back = source[edge]
            end = end - (here - back)
            more = back > low
            here, low, end = back[more], low[more], end[more]
        return chosen

    def decode(self, ids: Sequence[int]) -> str:
        """The text whose pieces these are."""
        written = self.written
        text = b"".join([written[i] for i in ids]).decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text


@lru_cache(2)
def lattice(pieces: tuple[str | None, ...], sharpness: float) -> Lattice:
    return Lattice(pieces, sharpness)


def row_keys(ids: Sequence[str | None], seed: int) -> np.ndarray:
    """64 bits from each id (null: empty) and the seed."""
    return np.array([xxhash.xxh64_intdigest(i or "", seed) for i in ids], dtype=np.uint64)


def small_parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for b, text in enumerate(texts):
        if b > a and size + len(text or "") > LATTICE_CHARS:
            yield a, b
            a, size = b, 0
        size += len(text or "")
    yield a, len(texts)


def encoded(path: str = MODEL, seed: int = SEED, sharpness: float = SHARPNESS) -> Callable[..., Column]:
    """A function of two column names, (doc_id, text) -> array of piece ids. Null text gives
    null, empty text no pieces. Equal ids and texts give equal pieces, wherever
    and however often they are encoded."""
    pieces = read_pieces(path)

    @F.pandas_udf("array<int>")
    def encode(ids: pd.Series, texts: pd.Series) -> pd.Series:
        own, texts = lattice(pieces, sharpness), texts.tolist()
        return pd.Series(own.encode_rows(texts, row_keys(ids.tolist(), seed)), dtype=object)

    return lambda doc_id, text: encode(F.col(doc_id).cast("string"), text)


def decoded(path: str = MODEL) -> Callable[[Column], Column]:
    """A column function: array of piece ids -> text; null gives null."""
    pieces = read_pieces(path)

    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        own = lattice(pieces, SHARPNESS)
        return pd.Series([None if r is None else own.decode(r.tolist()) for r in rows], dtype=object)

    return decode


def round_tripped(path: str = MODEL, seed: int = SEED, sharpness: float = SHARPNESS) -> Callable[..., Column]:
    """A function of two column names, (doc_id, text) -> struct of the sampled
    pieces, the SHA-256 of the text they decode to, and whether it is ``text``.
    One pass of Python, where two functions would encode twice."""
    pieces = read_pieces(path)

    @F.pandas_udf("pieces array<int>, decoded_sha256 string, lossless boolean")
    def both(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        own, texts, rows = lattice(pieces, sharpness), texts.tolist(), []
        for text, found in zip(texts, own.encode_rows(texts, row_keys(ids.tolist(), seed))):
            if found is None:
                rows.append((None, None, True))
            else:
                back = own.decode(found.tolist())
                digest = hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((found, digest, back == text))
        return pd.DataFrame(rows, columns=["pieces", "decoded_sha256", "lossless"])

    return lambda doc_id, text: both(F.col(doc_id).cast("string"), text)


def round_trip(docs: DataFrame, path: str = MODEL, seed: int = SEED) -> DataFrame:
    """doc_id, pieces, n_pieces, decoded_sha256, lossless of every row of
    ``docs`` (doc_id, text): the sampled pieces, and whether decoding them gives
    the text back. Null texts have null pieces and count as lossless. Empty texts
    have no pieces. Repeated rows draw the same pieces, as the key of a row is its
    id; rows without id share one key. Texts of any length are read whole. Empty
    tables give no rows; other columns are not read."""
    rows = docs.select("doc_id", round_tripped(path, seed)("doc_id", "text").alias("r"))
    many = F.when(F.col("r.pieces").isNull(), 0).otherwise(F.size("r.pieces")).alias("n_pieces")
    return rows.select("doc_id", "r.pieces", many, "r.decoded_sha256", "r.lossless")
