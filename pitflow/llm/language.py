"""Language ID by mixture inference.

Each language is a distribution over hashed letter trigrams. A document is a
mixture of languages whose proportions expectation-maximisation estimates from
its trigrams; languages enter the document's set in order of proportion for as
long as the penalised likelihood gains.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitflow.llm.common import remainder
from pitflow.llm.letters import chunks, lower_letters

BUCKETS = 1 << 16
FOLDS, HELD_OUT = 3, 1
SMOOTHING, ROUNDS = 0.2, 10
#: A trigram shares two letters with each neighbour, so three count as one observation.
OVERLAP = 3
#: Languages whose counts a task holds before it hands them on.
HELD_LANGUAGES = 64
#: Languages that are learned at most.
MOST_LANGUAGES = 256
UNKNOWN = "und"


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document, hashed trigram) of all places that hold a letter."""
    owner, points = lower_letters(texts)
    if len(points) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b, c = (points[i : len(points) - 2 + i].astype(np.uint64) for i in range(3))
    with np.errstate(over="ignore"):
        mixed = (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xC2B2AE3D27D4EB4F) + c
        mixed = (mixed * np.uint64(0x165667B19E3779F9)) >> np.uint64(48)
    inside = (owner[2:] == owner[:-2]) & (b > 0)
    return owner[2:][inside].astype(np.int64), mixed[inside].astype(np.int64)


class Model:
    """Trigram distributions of the learned languages."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        share = counts + SMOOTHING
        self.p = (share / share.sum(axis=1, keepdims=True)).T.astype(np.float32)

    def infer(self, texts: list[str]) -> list[tuple[str, float, str]]:
        """(language, its proportion, the set with proportions) of each text."""
        found = [(UNKNOWN, 0.0, "")] * len(texts)
        if not self.languages:
            return found
        owner, gram = trigrams(texts)
        if not len(owner):
            return found
        key, count = np.unique(owner * BUCKETS + gram, return_counts=True)
        docs, first = np.unique(key // BUCKETS, return_index=True)
        fit = _Fit(self.p[key % BUCKETS], count.astype(np.float32), first)
        for doc, weights in zip(docs, fit.chosen()):
            order = np.argsort(-weights, kind="stable")
            held = [i for i in order if weights[i] > 0]
            best = held[0]
            shares = ",".join(f"{self.languages[i]}:{weights[i]:.3f}" for i in held)
            found[doc] = (self.languages[best], float(min(1.0, weights[best])), shares)
        return found


class _Fit:
    """EM over many documents at once; rows are (document, trigram)."""

    def __init__(self, p: np.ndarray, count: np.ndarray, first: np.ndarray):
        self.p, self.count, self.first = p, count, first
        self.rows = np.diff(np.append(first, len(p)))
        self.total = np.add.reduceat(count, first)

    def of(self, docs: np.ndarray) -> _Fit:
        """The fit of some of the documents."""
        at = np.repeat(np.isin(np.arange(len(self.rows)), docs), self.rows)
        first = np.concatenate([[0], np.cumsum(self.rows[docs])[:-1]]).astype(np.int64)
        return _Fit(self.p[at], self.count[at], first)

    def run(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(proportions, log likelihood) from a start; zeros stay zero."""
        for _ in range(ROUNDS):
            part = self.p * np.repeat(weights, self.rows, axis=0)
            part *= (self.count / part.sum(axis=1))[:, None]
            weights = np.add.reduceat(part, self.first, axis=0) / self.total[:, None]
        mixed = (self.p * np.repeat(weights, self.rows, axis=0)).sum(axis=1)
        return weights, np.add.reduceat(self.count * np.log(mixed, dtype=np.float64), self.first)

    def chosen(self) -> np.ndarray:
        """The proportions of each document over the set of languages it keeps."""
        n, languages = len(self.rows), self.p.shape[1]
        full, _ = self.run(np.full((n, languages), 1 / languages, np.float32))
        order = np.argsort(-full, axis=1, kind="stable")
        penalty = np.log(np.maximum(self.total / OVERLAP, 2)) / 2
        best = np.zeros_like(full)
        best[np.arange(n), order[:, 0]] = 1
        single = np.log(np.take_along_axis(self.p, np.repeat(order[:, :1], self.rows, axis=0), 1)[:, 0])
        reached = np.add.reduceat(self.count * single, self.first) / OVERLAP
        open_docs, fit = np.arange(n), self
        for size in range(2, languages + 1):
            if not len(open_docs):
                break
            fit = self.of(open_docs)
            start = np.zeros((len(open_docs), languages), np.float32)
            np.put_along_axis(start, order[open_docs, :size], 1.0, axis=1)
            start *= np.maximum(full[open_docs], 1e-3)
            start /= start.sum(axis=1, keepdims=True)
            weights, likelihood = fit.run(start)
            gain = likelihood / OVERLAP - reached[open_docs] - penalty[open_docs]
            better = gain > 0
            best[open_docs[better]] = weights[better]
            reached[open_docs[better]] += gain[better]
            open_docs = open_docs[better]
        return best


def learn(docs: DataFrame, train: Column) -> Model:
    """The model of the non-null languages of all rows of ``docs`` (text, lang)
    that ``train`` names; of more than MOST_LANGUAGES, those with the most rows, as
    a column full of other values must not become a model of each. What is gathered
    has a row per language and trigram bucket, whatever the size of the corpus."""
    known = docs.where(train & F.col("lang").isNotNull())
    common = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES)
    names = [r["lang"] for r in common.collect()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                at = np.flatnonzero(counts)
                if not len(at):
                    continue
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": at, "n": counts[at]})
            held.clear()

        for batch in batches:
            langs = batch["lang"].to_pylist()
            for start, texts in chunks(batch["text"].to_pylist()):
                owner, gram = trigrams(texts)
                names = np.array(langs[start : start + len(texts)], dtype=object)
                for lang in dict.fromkeys(names):
                    mine = (names == lang)[owner]
                    counts = np.bincount(gram[mine], minlength=BUCKETS)
                    held[lang] = held[lang] + counts if lang in held else counts
                if len(held) > HELD_LANGUAGES:
                    yield from flush()
        yield from flush()

    rows = (
        known.where(F.col("lang").isin(names) & F.col("text").isNotNull())
        .select("lang", "text")
        .mapInArrow(count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    counts[np.searchsorted(languages, rows["lang"]), rows["bucket"]] = rows["n"]
    return Model(languages, counts)


def inferred(model: Model) -> Callable[[Column], Column]:
    """A column function: text -> struct(lang_pred, score, languages)."""

    @F.pandas_udf("lang_pred string, score double, languages string")
    def infer(texts: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = []
        for _, part in chunks(texts.tolist()):
            rows += model.infer(part)
        return pd.DataFrame(rows, columns=["lang_pred", "score", "languages"])

    return infer


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages of every row of ``docs``
    (doc_id, text, lang).

    Learned from rows with a language whose crc32(doc_id) mod 3 is not 1. A text
    that is null or without a letter is ``und`` with score 0, and so is every
    text where no language could be learned. A null doc_id counts as empty text
    in the checksum. score is the share of the predicted language. Texts of any
    length are read whole, repeated rows are learned from as often as they are
    there and predicted alike, empty tables give no rows, and other columns are
    not read.
    """
    fold = remainder(F.col("doc_id"), FOLDS)
    model = learn(docs, fold != HELD_OUT)
    return docs.select(
        "doc_id", (fold == HELD_OUT).alias("held_out"), inferred(model)("text").alias("r")
    ).select("doc_id", "held_out", "r.lang_pred", "r.score", "r.languages")


def identified(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` that have a language with a share of ``least`` or more,
    as often as they are there and with all columns as they were. Rows without id
    are rows like any other, null texts and those without a letter go, and so do
    all rows where no language could be learned; an empty table stays empty."""
    model = learn(docs, remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    found = docs.select(F.struct("*").alias("doc"), inferred(model)("text").alias("r"))
    return found.where((F.col("r.lang_pred") != UNKNOWN) & (F.col("r.score") >= least)).select("doc.*")
