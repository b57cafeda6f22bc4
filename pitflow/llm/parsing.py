"""Document fingerprints by locally consistent parsing.

A text is a sequence of names, at first its code points. Runs of one name are
folded; deterministic coin tossing then gives every name a small label that
depends on a few neighbours only, and a phrase starts wherever the label is a
local maximum. A phrase's name is a hash of the names in it, and the phrases
are parsed again, level by level. Equal substrings get equal phrases inside,
wherever they stand, so the share of common phrase names measures likeness.

The fingerprint samples the phrase names of two levels, and the sample grows with
the text: all names below a bound, one in SCALE, and at least the KEPT smallest.
With m names of both texts looked at, the standard error of a likeness is at most
0.5 / sqrt(m) a level: 0.07 for short texts, 0.02 for one of 20,000 words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitflow.llm.letters import chunks, code_points

#: Levels of parsing, and those whose phrases the fingerprint samples. A level
#: shortens the sequence about threefold.
LEVELS, SAMPLED = 3, (2, 3)
#: Phrase names kept of each sampled level at least, and the share kept of many.
KEPT, SCALE = 48, 16
BOUND = 2**32 // SCALE
#: Names of one level with eight hexadecimal digits each, levels apart by a dash.
DIGITS = 8
#: Texts of one block of documents, which a task reads in order, in bytes.
BLOCK_BYTES = 8 << 20
#: Blocks at most; beyond that they grow, which costs parallelism, not memory.
MOST_BLOCKS = 40_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(64, dtype=np.uint64)
for _i in range(1, 64):
    _POWERS[_i] = np.uint64((int(_POWERS[_i - 1]) * 0xD6E8FEB86659FD93) & (2**64 - 1))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def tossed(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6 by three rounds of coin tossing: twice the place of the
    lowest bit that differs from the left neighbour's, plus that bit. A text's
    first name, with no left neighbour, is compared with its own complement."""
    left = np.empty_like(names)
    left[1:] = names[:-1]
    left[first] = ~names[first]
    apart = names ^ left
    lowest = apart & (~apart + apart.dtype.type(1))
    place = np.bitwise_count(lowest - apart.dtype.type(1))
    label = (place << 1) | ((names & lowest) != 0).astype(np.uint8)
    for _ in range(2):
        left = np.empty_like(label)
        left[1:] = label[:-1]
        left[first] = ~label[first]
        apart = label ^ left
        lowest = apart & (~apart + np.uint8(1))
        label = (np.bitwise_count(lowest - np.uint8(1)) << 1) | ((label & lowest) != 0).astype(np.uint8)
    return label


def folded(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one name become one name of the pair (name, length)."""
    new = np.ones(len(names), dtype=bool)
    new[1:] = names[1:] != names[:-1]
    new[first] = True
    if new.all():
        return names, first
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(names)))
    run = names[start]
    long = length > 1
    run[long] = mixed(run[long] + length[long].astype(np.uint64) * _POWERS[7])
    return run, np.searchsorted(start, first)


def parsed(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: (phrase names, place of each text's first phrase)."""
    names, first = folded(names, first)
    # Folding can leave equal neighbours only by a hash collision; tossing then
    # has no differing bit, label 16 or more, and still cuts the same way everywhere.
    label = tossed(names, first)
    cut = np.zeros(len(names), dtype=bool)
    if len(names) > 2:
        cut[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    cut[np.append(first[1:], len(names)) - 1] = False  # the last one has no right neighbour
    cut[first] = True
    start = np.flatnonzero(cut)
    at = np.arange(len(names)) - np.repeat(start, np.diff(np.append(start, len(names))))
    parts = (mixed(names) | np.uint64(1)) * _POWERS[np.minimum(at, 63)]
    return mixed(np.add.reduceat(parts, start)), np.searchsorted(start, first)


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text: sorted names per sampled level, the KEPT
    smallest or all below BOUND, whichever are more."""
    found = [[] for _ in texts]
    filled = [i for i, t in enumerate(texts) if t]
    if filled:
        points = code_points("".join(texts))
        first = np.cumsum([0] + [len(texts[i]) for i in filled[:-1]])
        # Code points are small and close to each other; mixing sets their low bits apart.
        names = mixed(points.astype(np.uint64) + np.uint64(1))
        for level in range(1, LEVELS + 1):
            names, first = parsed(names, first)
            if level in SAMPLED:
                short = (mixed(names) >> np.uint64(32)).astype(np.uint32)
                ends = np.append(first[1:], len(names))
                for i, a, b in zip(filled, first, ends):
                    part = short[a:b]
                    few = np.unique(part[part < BOUND])
                    found[i].append(few if len(few) >= KEPT else np.unique(part)[:KEPT])
    return ["-".join(x.astype(">u4").tobytes().hex() for x in levels) for levels in found]


def sampled(level: str) -> tuple[set[int], int]:
    """The names of one level of a fingerprint, and below which value they are all
    that the text has."""
    names = np.frombuffer(bytes.fromhex(level), dtype=">u4").tolist()
    return set(names), 2**32 if len(names) < KEPT else max(BOUND, names[-1] + 1)


def likeness(a: str, b: str) -> float:
    """Estimated share of common phrases, 0 to 1, the mean over the levels.

    Of the names that both samples would hold, those below the lesser of their
    limits, the share that both texts have. Two empty texts are alike, an empty
    one and another are not.
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    shares = []
    for x, y in zip(a.split("-"), b.split("-")):
        (x, upto_x), (y, upto_y) = sampled(x), sampled(y)
        upto = min(upto_x, upto_y)
        either = {name for name in x | y if name < upto}
        shares.append(len(x & y & either) / len(either) if either else 0.0)
    return sum(shares) / len(shares)


def edited(text: str, following: str) -> str:
    """The last quarter of ``text``, rounded down, replaced by the first as many
    code points of ``following``, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (block, guest, doc_id, text) and the number of blocks, with the rows of ``docs`` in blocks of
    neighbouring ids, each block with the first row after it as a guest.

    Ids are cut at quantiles into blocks of about BLOCK_BYTES, of which the
    driver knows the first ids, eight bytes each. The texts move once. The last block's guest is the very first row. Rows without id come
    last, ordered by text, as do rows that repeat an id.
    """
    facts = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("doc_id").alias("low")).first()
    blocks = min(MOST_BLOCKS, max(1, -(-(facts["bytes"] or 0) // BLOCK_BYTES)))
    inner, low = [], facts["low"]
    if blocks > 1 and low is not None:
        shares = [i / blocks for i in range(1, blocks)]
        inner = docs.agg(F.percentile_approx("doc_id", shares, 20 * blocks)).first()[0]
    bounds = np.unique(np.array(inner + [low] if low is not None else [], dtype=np.int64))
    last = max(0, len(bounds) - 1)

    @F.pandas_udf("own long, starts boolean")
    def placed(ids: pd.Series) -> pd.DataFrame:
        there = ids.notna().to_numpy()
        own = np.full(len(ids), last, dtype=np.int64)
        starts = np.full(len(ids), low is None)
        known = ids[there].to_numpy(np.int64)
        own[there] = np.searchsorted(bounds, known, side="right") - 1
        starts[there] = bounds[own[there]] == known
        return pd.DataFrame({"own": own, "starts": starts})

    rows = docs.select("doc_id", "text", placed("doc_id").alias("at"))
    own = F.col("at.own")
    home = F.struct(own.alias("block"), F.lit(0).alias("guest"))
    before = F.when(own == 0, F.lit(last)).otherwise(own - 1)
    away = F.struct(before.alias("block"), F.lit(1).alias("guest"))
    places = F.when(F.col("at.starts"), F.array(home, away)).otherwise(F.array(home))
    spread = rows.select("doc_id", "text", F.explode(places).alias("p"))
    return spread.select("p.block", "p.guest", "doc_id", "text"), last + 1


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """SCHEMA for every row of ``docs`` (doc_id long, text).

    Null texts count as empty. The next document is the one with the next id;
    rows that repeat an id follow in order of their text, rows without id come
    last, and the very first row follows the last. A single row is its own
    next. Empty tables give no rows; other columns are not read.
    """
    rows, blocks = with_next(docs)

    def compare(held: list[tuple[int | None, str]], following: str) -> pa.RecordBatch:
        texts = [t for _, t in held] + [following]
        altered = [edited(a, b) for a, b in zip(texts, texts[1:])]
        prints, altered_prints = [], []
        for _, part in chunks(texts):
            prints += fingerprints(part)
        for _, part in chunks(altered):
            altered_prints += fingerprints(part)
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([i for i, _ in held], pa.int64()),
                "n_chars": [len(t) for _, t in held],
                "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in altered],
                "fingerprint": prints[:-1],
                "edited_fingerprint": altered_prints,
                "near_edited": [likeness(a, b) for a, b in zip(prints, altered_prints)],
                "near_next": [likeness(a, b) for a, b in zip(prints, prints[1:])],
            }
        )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block and id; a block's guests are behind its own rows."""
        at, held, size, ended = None, [], 0, False
        for batch in batches:
            for block, guest, doc_id, text in zip(*(batch[c].to_pylist() for c in ("block", "guest", "doc_id", "text"))):
                text = text or ""
                if block != at:
                    at, ended = block, False
                if ended:
                    continue  # a further row with the guest's id
                if guest:
                    ended = True
                    if held:
                        yield compare(held, text)
                    held, size = [], 0
                    continue
                if size > CHARS:
                    yield compare(held, text)
                    held, size = [], 0
                held.append((doc_id, text))
                size += len(text)

    # One block, one task: hashing would put several into some and none into others.
    ordered = rows.repartitionById(blocks, F.col("block").cast("int")).sortWithinPartitions(
        "block", "guest", F.col("doc_id").asc_nulls_last(), "text"
    )
    return ordered.mapInArrow(walk, SCHEMA)


#: Code points of the rows that a task compares at once.
CHARS = 1 << 20
