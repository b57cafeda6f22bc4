"""Toxicity scores over text restored by a noisy-channel model.

Writers hide words by digits and signs for letters (1d10t, idio7), by spacing
(i d i o t, id-iot) and by repetition (stuupid). Each such place becomes a
lattice: a sign may stand for one of several letters, a separator for nothing
or for a word end, a repeated letter for nothing. Viterbi finds the likeliest
restored text under a letter trigram model of the whole corpus. Documents are
then scored by the words of their restored text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitflow.llm.common import cut, remainder, sampled_texts
from pitflow.llm.letters import chunks, lower_letters

FOLDS = 5
#: Labelled rows that the word weights are learned from at most.
TRAIN_ROWS = 8000
#: Documents that a feature has to be in before it can weigh anything.
SUPPORT = 3
#: Log odds below which a feature is ordinary speech.
TELLING = 3.5
PREFIXES = (4, 5, 6)
#: Characters of restored places that a task remembers, and what an entry takes besides.
REMEMBERED, ENTRY = 1 << 24, 200

# Letters that signs stand for in disguised words.
SIGNS = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "(": "c",
    "€": "e",
    "£": "l",
    "¡": "i",
}
SEPARATORS = " .-_*~'/"
#: Letters of the model; all others share one symbol, and 0 is a word end.
ALPHABET = "abcdefghijklmnopqrstuvwxyzßàáâäãåæçèéêëìíîïñòóôöõøœùúûüý"
SIZE = len(ALPHABET) + 2

#: Log costs of the channel.
SIGN, KEPT_SIGN, JOIN, SPLIT, REPEAT = (math.log(p) for p in (0.3, 0.02, 0.9, 0.1, 0.3))

_SIGN = "".join(map(re.escape, SIGNS))
_SEP = "".join(map(re.escape, SEPARATORS))
_ONE = rf"(?:[^\W\d_]|[{_SIGN}])"
SPACED = re.compile(rf"(?<!\w){_ONE}(?:[{_SEP}\s]+{_ONE}){{2,}}(?!\w)")  # i d i o t
JOINED = re.compile(rf"[\w{_SIGN}]+(?:[{_SEP}]+[\w{_SIGN}]+)*")  # 1d10t, idio7, id-iot
SPACE = re.compile(r"\s+")
TOKEN = re.compile(r"[^\W\d_]+")
REPEATED = re.compile(r"(.)\1")
SURE = re.compile(rf"[{_SIGN}][^\W\d_]|([^\W\d_])\1\1")
EDGES = ".,;:?\"[]{}"
#: Signs that beside a word are mostly punctuation; places are read with and without them.
MARKS = "(!¡|"
OUTSIDE = EDGES + MARKS + ")'“”„‘’«»…¿"


class LetterModel:
    """Log probabilities of a letter after two others, interpolated."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + SIZE)
        p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
        p3 = (three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5)
        self.log = np.log(p3).astype(np.float32)

    @cached_property
    def rows(self) -> list[list[list[float]]]:
        """``log`` as lists, whose single values are read faster; made in each task."""
        return self.log.tolist()

    def restore(self, hidden: str) -> str:
        """The likeliest text behind one disguised place. States are the last
        two letters, so the work grows with the length of the place only."""
        rows, index = self.rows, _INDEX
        # state -> (score, back pointer)
        states: dict[tuple[str, str], tuple[float, tuple]] = {("", ""): (0.0, ())}
        for char in hidden:
            after: dict[tuple[str, str], tuple[float, tuple]] = {}

            def offer(state: tuple[str, str], score: float, trail: tuple) -> None:
                if state not in after or after[state][0] < score:
                    after[state] = (score, trail)

            if char in SEPARATORS:
                for (first, last), (score, trail) in states.items():
                    offer((first, last), score + JOIN, trail)
                    if last:
                        here = rows[index.get(first, 1)][index.get(last, 1)]
                        offer((last, ""), score + SPLIT + here[0], (trail, " "))
            elif char.isalpha():
                at = index.get(char, 1)
                for (first, last), (score, trail) in states.items():
                    if char == last:
                        offer((first, last), score + REPEAT, trail)
                    offer((last, char), score + rows[index.get(first, 1)][index.get(last, 1)][at], (trail, char))
            else:
                letters = SIGNS.get(char, "")
                cost = SIGN - math.log(len(letters) or 1)
                for (first, last), (score, trail) in states.items():
                    here = rows[index.get(first, 1)][index.get(last, 1)]
                    for letter in letters:
                        if letter == last:
                            offer((first, last), score + cost + REPEAT, trail)
                        offer((last, letter), score + cost + here[index[letter]], (trail, letter))
                    offer((last, ""), score + KEPT_SIGN + here[0], (trail, " "))
            states = after
        best, trail = max(
            (score + rows[index.get(a, 1)][index.get(b, 1)][0], trail) for (a, b), (score, trail) in states.items()
        )
        out = []
        while trail:
            trail, letter = trail
            out.append(letter)
        return "".join(reversed(out))


_INDEX = {"": 0, **{c: i + 2 for i, c in enumerate(ALPHABET)}}


def letter_model(docs: DataFrame) -> LetterModel:
    """Letter trigram counts over all texts of ``docs``; SIZE cubed rows at most
    reach the driver."""
    code = np.ones(0x110000, dtype=np.int32)
    code[0] = 0
    for letter, i in _INDEX.items():
        if letter:
            code[ord(letter)] = i

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, dtype=np.int64)
        for batch in batches:
            for _, texts in chunks(batch["text"].to_pylist()):
                _, points = lower_letters(texts)
                x = code[points]
                total += np.bincount((x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": at, "n": total[at]})

    rows = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(SIZE**3)
    found = rows.toPandas()
    counts[found["gram"]] = found["n"]
    return LetterModel(counts)


def word_set(text: str, restore: Callable[[str], str], plain: Callable[[str], bool] = lambda word: False) -> set[str]:
    """The different words of the restored text, disguised and plain. Spaced
    words are sought in the whole text, whatever stands around them, and signs
    before letters and letters three times in every token. A double letter, an
    inner separator or signs at the end only can be ordinary spelling as well:
    such places are restored unless one of their words is ``plain``."""
    text = text.lower()
    distinct = {t.strip(EDGES) for t in set(text.split())}
    words = set(filter(str.isalpha, distinct))
    places = {p for p in words if REPEATED.search(p)}
    for token in distinct - words:
        words.update(TOKEN.findall(token))
        for place in JOINED.findall(token):
            places.update(p for p in (place, place.strip(MARKS)) if not p.isalpha() or REPEATED.search(p))
    sure = {SPACE.sub(" ", p) for p in SPACED.findall(text)}
    for place in places | sure:
        parts = TOKEN.findall(place)
        if parts and (place in sure or SURE.search(place) or not any(map(plain, parts))):
            words.update(restore(place).split())
    return words


def remembered(model: LetterModel) -> Callable[[str], str]:
    """``restore`` with a memory bounded by its size, not its entries, as a place
    may be very long."""
    known: dict[str, str] = {}
    size = 0

    def restore(place: str) -> str:
        nonlocal size
        if (found := known.get(place)) is None:
            found = model.restore(place)
            size += len(place) + len(found) + ENTRY
            if size > REMEMBERED:
                known.clear()
                size = len(place) + len(found) + ENTRY
            if size <= REMEMBERED:
                known[place] = found
        return found

    return restore


class WordWeights:
    """Log odds of telling features, words or, with a star, beginnings of words;
    and the logistic curve over their sum."""

    def __init__(self, weights: dict[str, float], slope: float, offset: float):
        self.weights, self.slope, self.offset = weights, slope, offset
        self.starts = {f.rstrip("*")[: PREFIXES[0]] for f in weights}
        self.heads = {f[:n] for f in weights if not f.endswith("*") for n in range(1, len(f))}

    def weight(self, word: str) -> float:
        get = self.weights.get
        return max(get(word, 0.0), *(get(f"{word[:n]}*", 0.0) for n in PREFIXES if len(word) >= n), 0.0)

    def telling(self, word: str) -> bool:
        return word[: PREFIXES[0]] in self.starts and self.weight(word) > 0

    def parted(self, text: str) -> set[str]:
        """Telling words that spaces part into pieces of any length (mor on). Of
        plain words any two neighbours could be one, so only whole telling words
        are sought, and none are learned from."""
        tokens, found, heads = text.lower().split(), set(), self.heads
        firsts = {t: h for t in set(tokens) if (h := t.lstrip(OUTSIDE)) in heads}
        if not firsts:
            return found
        for at in [i for i, t in enumerate(tokens) if t in firsts]:
            word, at = firsts[tokens[at]], at + 1
            while word in heads and at < len(tokens):
                piece, at = tokens[at], at + 1
                if (whole := word + piece.rstrip(OUTSIDE)) in self.weights:
                    found.add(whole)
                word += piece
        return found

    def evidence(self, words: set[str]) -> float:
        starts, n = self.starts, PREFIXES[0]
        return sum(self.weight(w) for w in sorted(w for w in words if w[:n] in starts))

    def score(self, words: set[str]) -> float:
        x = self.offset + self.slope * math.log1p(self.evidence(words))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, lightly held back."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(x * (p - y)).sum() + 0.01 * a, (p - y).sum() + 0.01 * b])
        v = p * (1 - p)
        h = np.array([[(v * x * x).sum() + 0.01, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def learn(docs: DataFrame, labels: DataFrame, letters: LetterModel) -> WordWeights:
    """Weights from TRAIN_ROWS labelled documents at most, those with the lowest
    hash of their id; rows of the held-out fold, without id or label are not used."""
    usable = labels.where(
        F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), FOLDS) != 0)
    )
    sample = (
        usable.groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(TRAIN_ROWS)
    )
    texts = sampled_texts(docs, sample)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = remembered(letters)
        for batch in batches:
            # any ordinary spelling is taken as it stands: what it could hide is not learned from
            words = [sorted(word_set(t or "", restore, lambda word: True)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {"toxic": batch["toxic"], "words": pa.array(words, pa.list_(pa.string()))}
            )

    train = cut(texts.select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(words_of, "toxic long, words array<string>"))
    docs_by_label = dict(train.groupBy("toxic").count().collect())
    bad, good = docs_by_label.get(1, 0), docs_by_label.get(0, 0)
    if not bad or not good:
        return WordWeights({}, 0.0, math.log((bad + 0.5) / (good + 0.5)))

    def named(word: Column) -> Column:
        """The word and its beginnings; nulls where it is too short."""
        starts = (F.when(F.length(word) >= n, F.concat(F.substring(word, 1, n), F.lit("*"))) for n in PREFIXES)
        return F.array(word, *starts)

    # Of each document every feature once, however many of its words begin alike.
    features = F.array_distinct(F.flatten(F.transform("words", named)))
    per_doc = train.select("toxic", F.explode(features).alias("feature")).where("feature IS NOT NULL")
    by_label = [F.count_if(F.col("toxic") == label).alias(name) for label, name in ((1, "bad"), (0, "good"))]
    held = per_doc.groupBy("feature").agg(*by_label)
    # Every feature that is there as often could have told by chance, so all count below.
    looked_at = held.where(F.col("bad") + F.col("good") >= SUPPORT).count()
    table = held.where(F.col("bad") >= SUPPORT).toPandas()
    a, c = table["bad"].to_numpy(float), table["good"].to_numpy(float)
    weight = np.log((a + 0.1) / (bad + 0.2)) - np.log((c + 0.1) / (good + 0.2))
    everywhere = (a + c) / (bad + good)
    gain = 2 * (
        a * np.log(np.maximum(a, 1e-9) / (bad * everywhere))
        + c * np.log(np.maximum(c, 1e-9) / (good * everywhere))
    )
    telling = (gain > 2 * math.log(looked_at + 1) + 4) & (weight > TELLING)
    weights = dict(zip(table["feature"][telling], weight[telling]))
    model = WordWeights(weights, 1.0, 0.0)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([model.evidence(set(w)) for w in batch["words"].to_pylist()], pa.float64())
            yield pa.RecordBatch.from_pydict({"toxic": batch["toxic"], "x": x})

    seen = train.mapInArrow(evidence, "toxic long, x double").toPandas()
    return WordWeights(weights, *_logistic(np.log1p(seen["x"].to_numpy()), seen["toxic"].to_numpy(float)))


def scored(letters: LetterModel, weights: WordWeights) -> Callable[[Column], Column]:
    """A column function: text -> score from 0 to 1."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restore = remembered(letters)
        for texts in batches:
            words = (word_set(t, restore, weights.telling) | weights.parted(t) for t in texts.fillna(""))
            yield pd.Series([weights.score(w) for w in words], dtype="float64")

    return score


THRESHOLD = 0.5


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, toxic) teaches the word weights. Null and empty texts
    have no words and get the score of a document without evidence; so does
    every text if the labels show one class only. Null ids count as empty text
    in the checksum. Texts of any length are read whole, and repeated rows are
    scored alike. Of rows that share an id, one is learned from; of several labels,
    any 1 counts. Empty tables give no rows; other columns are not read.
    """
    letters = letter_model(docs)
    weights = learn(docs, labels, letters)
    held_out = remainder(F.col("doc_id"), FOLDS) == 0
    return docs.select(
        "doc_id", held_out.alias("held_out"), scored(letters, weights)("text").alias("score")
    ).select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, as often as they are
    there, all columns as they were. Null and empty texts score as documents
    without evidence, rows without id like others; an empty table stays empty."""
    letters = letter_model(docs)
    weights = learn(docs, labels, letters)
    rows = docs.select(F.struct("*").alias("doc"), scored(letters, weights)("text").alias("score"))
    return rows.where(F.col("score") < THRESHOLD).select("doc.*")
