"""Texts as arrays of code points, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np

#: Code points handled at once in a task; a longer text comes alone.
CHUNK_CHARS = 1 << 20


@cache
def letter_table() -> np.ndarray:
    """True at each code point that is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def chunks(texts: Sequence[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(position of the first, texts) of about CHUNK_CHARS code points; null is empty."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if held and size + len(text) > CHUNK_CHARS:
            yield start, held
            start, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield start, held


def lower_letters(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document of each code point, code points): lower-cased letters, every
    run of other characters one 0, with a 0 before and after each text."""
    lowered = [f" {t.lower()} " for t in texts]
    owner = np.repeat(np.arange(len(lowered), dtype=np.int32), [len(t) for t in lowered])
    points = code_points("".join(lowered))
    letter = letter_table()[points]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    return owner[keep], np.where(letter, points, 0)[keep]
