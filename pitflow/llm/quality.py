"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is a linear function of features of its whole text. In a
pair of a good and a bad document the good one wins with the logistic of the
difference of strengths; the weights maximise the likelihood of the wins in all
such pairs of learned documents. The threshold is a quantile of their strengths:
the share of bad ones among them.

No pair is ever formed. What a pair adds depends smoothly on two strengths, so
documents are summed up at the points of a grid of strengths, from which
polynomials reach between the points, and pairs of points stand for all pairs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from pitflow.llm.common import cut, remainder

FOLDS = 5
#: Distance of grid points, and the points that a strength is spread over. The sums
#: over all pairs are then right to 1e-9 a pair: tests/llm.
STEP, POINTS = 1 / 8, 8
#: Grid points of good documents that are paired at a time.
PAIRED = 256
#: Learned rows that a task gets at least, and tasks that add up by key what tasks
#: summed: learning takes some thirty short jobs over small rows.
TASK_ROWS, ADDERS = 1 << 14, 8
#: Newton steps end below this.
SETTLED = 1e-7
RIDGE = 1e-3
#: predicted is 1 from this score on; the quantile threshold is mapped to it.
CUT = 0.3

SIGN = re.compile(r"[^\w\s]")
FEATURES = (
    "words",
    "word_length",
    "different_words",
    "most_frequent_word",
    "repeated_neighbours",
    "different_lines",
    "upper_case",
    "digits",
    "signs",
    "uncommon_signs",
    "exclamations",
    "bars",
    "words_ending_in_signs",
    "words_without_letters",
    "words_a_sentence",
    "spaces",
)


def measured(text: str | None) -> list[float]:
    """FEATURES of one text; all 0 for null, empty and blank ones. Shares are
    under a square root, which spreads the small ones."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), len(text)
    counts = Counter(words)
    root = math.sqrt
    letters = sum(map(len, words))
    upper = sum(map(str.isupper, words))
    signs = Counter(SIGN.findall(text))
    many_signs = signs.total()
    usual = signs["."] + signs[","] + signs["-"] + signs["'"]
    repeated = sum(a == b for a, b in zip(words, words[1:]))
    ends = sum(not w[-1].isalnum() and w[-1] not in ".,;:?" for w in words)
    bare = sum(not any(map(str.isalpha, w)) for w in words)
    lines = [x for x in text.split("\n") if x]
    return [
        math.log1p(n),
        math.log1p(letters / n),
        len(counts) / n,
        root(max(counts.values()) / n),
        root(repeated / n),
        len(set(lines)) / len(lines),
        root(upper / n),
        root(sum(map(text.count, "0123456789")) / chars),
        root(many_signs / chars),
        root((many_signs - usual) / chars),
        root(signs["!"] / chars),
        root(signs["|"] / chars),
        root(ends / n),
        root(bare / n),
        math.log1p(n / (1 + signs["."] + signs["?"])),
        (chars - letters) / chars,
    ]


class Ranking:
    """Strengths, and the curve that puts the threshold at CUT."""

    def __init__(self, mean, spread, weights, threshold: float, slope: float):
        self.mean, self.spread, self.weights = mean, spread, weights
        self.threshold, self.slope = threshold, slope

    def strength(self, x: np.ndarray) -> np.ndarray:
        return _strength((x - self.mean) / self.spread, self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0)
        at = self.slope * (self.strength(x) - self.threshold) + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(at, -40, 40)))


def _strength(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Feature by feature, so that a row's last bit does not depend on its batch."""
    s = np.zeros(len(z))
    for column, weight in zip(z.T, w):
        s += column * weight
    return s


#: From feature rows and whether each is good: keys, and rows of values to add up by key.
Part = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: From the width of the values and a part: ascending keys and sums over all learned rows.
Total = Callable[[int, Part], tuple[np.ndarray, np.ndarray]]


def _added(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in pieces])
    values = np.concatenate([v for _, v in pieces])
    order = np.argsort(keys, kind="stable")
    found, starts = np.unique(keys[order], return_index=True)
    return found, np.add.reduceat(values[order], starts, axis=0) if len(found) else values


def _newton(likelihood: Callable, d: int) -> np.ndarray:
    """Weights that maximise a mean log likelihood less the ridge, from its value,
    gradient and (called when needed) curvature. A step that loses is halved."""
    w = np.zeros(d)
    value, gradient, curvature = likelihood(w)
    for _ in range(60):
        step = np.linalg.solve(curvature() + RIDGE * np.eye(d), gradient - RIDGE * w)
        if abs(step).max() < SETTLED:
            return w + step
        before = value - RIDGE / 2 * (w @ w)
        for _ in range(30):
            value, gradient, curvature = likelihood(w + step)
            if value - RIDGE / 2 * ((w + step) @ (w + step)) >= before - 1e-9:
                break
            step = step / 2
        w = w + step
    return w


def _maximised(differences: np.ndarray) -> np.ndarray:
    """Weights for wins that are listed one by one, which few documents allow."""
    n, d = differences.shape

    def likelihood(w: np.ndarray):
        gaps = differences @ w
        lost = 1 / (1 + np.exp(np.clip(gaps, -500, 500)))
        bent = differences * (lost * (1 - lost))[:, None]
        return -np.logaddexp(0, -gaps).mean(), differences.T @ lost / n, lambda: bent.T @ differences / n

    return _newton(likelihood, d)


def _shares(at: np.ndarray) -> np.ndarray:
    """What points 0, 1, ... weigh in the polynomial through them, at places ``at``."""
    points = range(POINTS)
    return np.stack(
        [np.prod([(at - q) / (p - q) for q in points if q != p], axis=0) for p in points], axis=1
    )


def _on_grid(z: np.ndarray, good: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and features of every row, spread over the grid points around its
    strength. A key is twice the point, and one more for good rows."""
    s = _strength(z, w) / STEP
    first = np.floor(s).astype(np.int64) - (POINTS // 2 - 1)
    keys = 2 * (first[:, None] + np.arange(POINTS)) + good[:, None]
    values = _shares(s - first)[:, :, None] * np.column_stack([np.ones(len(z)), z])[:, None, :]
    return keys.reshape(-1), values.reshape(-1, 1 + z.shape[1])


def _of_all_pairs(total: Total, z_of: Callable[[np.ndarray], np.ndarray], d: int) -> Callable:
    """The mean log likelihood over all pairs of a good and a bad row, for ``_newton``.
    The curvature is read off straight lines between points: it only sets the steps."""

    def likelihood(w: np.ndarray):
        keys, sums = total(1 + d, lambda x, good: _on_grid(z_of(x), good, w))
        side, place = keys % 2 == 1, keys // 2 * STEP
        (wins, g), (losses, b) = ((place[m], sums[m]) for m in (side, ~side))
        n_good, n_bad, good_sums, bad_sums = g[:, 0], b[:, 0], g[:, 1:], b[:, 1:]
        pairs = n_good.sum() * n_bad.sum()
        value, crossed = 0.0, np.zeros((d, d))
        bent_wins, bent_losses = np.zeros(len(wins)), np.zeros(len(losses))
        gradient = np.zeros(d)
        for i in range(0, len(wins), PAIRED):
            here = slice(i, i + PAIRED)
            gaps = wins[here, None] - losses
            lost = 1 / (1 + np.exp(np.clip(gaps, -500, 500)))
            bent = lost * (1 - lost)
            value -= n_good[here] @ np.logaddexp(0, -gaps) @ n_bad
            gradient += good_sums[here].T @ (lost @ n_bad) - bad_sums.T @ (n_good[here] @ lost)
            crossed += good_sums[here].T @ bent @ bad_sums
            bent_wins[here] = bent @ n_bad
            bent_losses += n_good[here] @ bent

        def squares(x: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            z = z_of(x)
            s = _strength(z, w)
            bent = np.where(good, np.interp(s, wins, bent_wins), np.interp(s, losses, bent_losses))
            return np.arange(d), (z * bent[:, None]).T @ z

        return value / pairs, gradient / pairs, lambda: (total(d, squares)[1] - crossed - crossed.T) / pairs

    return likelihood


def _in_order(s: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of ``s``."""
    bits = (s + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def _at_ranks(total: Total, strength: Callable[[np.ndarray], np.ndarray], ranks: list[float]) -> np.ndarray:
    """The strengths at some ranks, counted from 0: rows are counted by their
    leading bits, then those that share them with a rank by the next 16."""
    inside = [(0, rank) for rank in ranks]
    for shift in (48, 32, 16, 0):
        wanted = np.unique([head for head, _ in inside])

        def part(x: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            bits = _in_order(strength(x))
            if shift < 48:
                bits = bits[np.isin(bits >> (shift + 16), wanted)]
            return bits >> shift, np.ones((len(bits), 1))

        keys, sums = total(1, part)
        after = []
        for head, rank in inside:
            mine = keys >> 16 == head if shift < 48 else np.full(len(keys), True)
            upto = np.cumsum(sums[mine, 0])
            i = np.searchsorted(upto, rank, side="right")
            after.append((keys[mine][i], rank - (upto[i] - sums[mine, 0][i])))
        inside = after
    bits = np.array([head for head, _ in inside], dtype=np.int64)
    return (bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.float64)


def fitted(total: Total) -> Ranking:
    """The ranking that all learned rows teach. With one class only, every document
    gets the same strength, on that class's side."""
    d = len(FEATURES)
    classes, sums = total(1 + d, lambda x, good: (good.astype(np.int64), np.column_stack([np.ones(len(x)), x])))
    if len(classes) < 2:
        threshold = (-1.0 if classes[0] else 1.0) if len(classes) else 0.0
        return Ranking(np.zeros(d), np.ones(d), np.zeros(d), threshold, 1.0)
    n_bad, n_good = sums[:, 0]
    mean = sums[:, 1:].sum(axis=0) / (n_bad + n_good)
    _, squares = total(d, lambda x, good: (np.zeros(len(x), dtype=np.int64), (x - mean) ** 2))
    spread = np.sqrt(squares[0] / (n_bad + n_good))
    spread[spread < 1e-9] = 1.0
    weights = _newton(_of_all_pairs(total, lambda x: (x - mean) / spread, d), d)
    strength = Ranking(mean, spread, weights, 0.0, 1.0).strength
    threshold = float(_at_ranks(total, strength, [n_bad - 1, n_bad]).mean())
    # Bad labels as often as strengths are apart: the slope of a logistic curve
    # through CUT at the threshold, within bounds for classes that do not overlap.
    slopes = np.geomspace(0.05, 20, 60)
    off = math.log(CUT / (1 - CUT))

    def misfits(x: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.clip(slopes[:, None] * (strength(x) - threshold) + off, -40, 40)
        return np.arange(len(slopes)), np.logaddexp(0, np.where(good, -1, 1) * at).sum(axis=1)[:, None]

    _, fits = total(1, misfits)
    return Ranking(mean, spread, weights, threshold, float(slopes[int(np.argmin(fits[:, 0]))]))


def ranked(x: np.ndarray, good: np.ndarray, parts: int = 1) -> Ranking:
    """``fitted`` on feature rows in memory, added up in so many parts."""
    pieces = list(zip(np.array_split(x, parts), np.array_split(good, parts)))
    return fitted(lambda width, part: _added([part(*piece) for piece in pieces]))


@F.pandas_udf(ArrayType(DoubleType()))
def _measured(texts: pd.Series) -> pd.Series:
    return pd.Series([measured(t) for t in texts], dtype=object)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text) and x (FEATURES) of every row; each text is
    read once, for learning and scoring."""
    return cut(docs.select("doc_id", F.xxhash64("text").alias("h"), _measured("text").alias("x")))


def _total(rows: DataFrame) -> Total:
    """Sums over the rows (x, good): parts are added up in tasks, then by key. Only
    the sums reach the driver."""
    rows = rows.coalesce(max(1, rows.count() // TASK_ROWS))

    def total(width: int, part: Part) -> tuple[np.ndarray, np.ndarray]:
        names = [f"v{i}" for i in range(width)]

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = []
            for batch in batches:
                x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
                held.append(_added([part(x, batch["good"].to_numpy(zero_copy_only=False))]))
                if len(held) == 32:
                    held = [_added(held)]
            if held:
                keys, sums = _added(held)
                columns = [pa.array(np.ascontiguousarray(v)) for v in sums.T]
                yield pa.RecordBatch.from_arrays([pa.array(keys), *columns], names=["key", *names])

        found = rows.mapInArrow(task, ", ".join(["key long", *(f"{n} double" for n in names)]))
        sums = found.groupBy("key").agg(*(F.sum(n).alias(n) for n in names)).coalesce(ADDERS)
        sums = sums.toPandas().sort_values("key")
        return sums["key"].to_numpy(np.int64), sums[names].to_numpy(np.float64)

    return total


def learned(rows: DataFrame, labels: DataFrame) -> Ranking:
    """From the ``features`` of all labelled documents. Rows of the held-out fold and
    rows without id or label teach nothing."""
    usable = F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), FOLDS) != 0)
    marks = labels.where(F.col("quality").isNotNull() & usable).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    texts = rows.where(usable).groupBy("doc_id").agg(F.min_by(F.struct("x"), "h")["x"].alias("x"))
    return fitted(_total(cut(texts.join(marks, "doc_id").select("x", (F.col("quality") == 1).alias("good")))))


def learn(docs: DataFrame, labels: DataFrame) -> Ranking:
    return learned(features(docs), labels)


def scored(ranking: Ranking) -> Callable[[Column], Column]:
    """A column function: features of a text -> score from 0 to 1."""

    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        x = np.array(rows.tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
        return pd.Series(ranking.score(x), dtype="float64")

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, quality) teaches the ranking. Null, empty and blank
    texts have all features 0 and are scored like any other, texts of any length
    are read whole, and repeated rows are scored alike; null ids count as empty
    text in the checksum. Of rows that share an id, one is learned from; of several
    labels, any 1 counts. Empty tables give no rows, and without labels every
    document gets one score. Other columns are not read.
    """
    rows = features(docs)
    ranking = learned(rows, labels)
    held_out = remainder(F.col("doc_id"), FOLDS) == 0
    return rows.select("doc_id", held_out.alias("held_out"), scored(ranking)("x").alias("score")).select(
        "*", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
