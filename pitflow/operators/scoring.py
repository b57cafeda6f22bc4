"""Three-class text scoring: native columns, or any model once per partition.

Texts are scored whole. A model with a limited input cuts or averages on its own.
"""

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitflow.schemas import SCORE_FIELDS, SCORING_BATCH

CLASSES = ("positive", "neutral", "negative")
# A scorer maps texts to rows of (positive, neutral, negative). The factory
# that makes one is shipped to the executors and called once per partition.
Scorer = Callable[[list[str]], Iterable[Sequence[float]]]
ScorerFactory = Callable[[], Scorer]


def net_sentiment(positive: Column, negative: Column) -> Column:
    return positive - negative


def softmax(logits: Sequence[Column]) -> list[Column]:
    """Shifted by the largest logit, so no exponent overflows."""
    top = F.greatest(*logits)
    exps = [F.exp(logit - top) for logit in logits]
    total = exps[0]
    for e in exps[1:]:
        total = total + e
    return [e / total for e in exps]


def lexicon(words: Sequence[str]) -> list[str]:
    """The different words in lower case. Tokens are runs of a-z, so any other
    word could never match and is refused."""
    lowered = sorted({w.lower() for w in words})
    odd = [w for w in lowered if not re.fullmatch("[a-z]+", w)]
    if odd:
        raise ValueError(f"not words of letters a-z: {odd}")
    return lowered


def token_hits(tokens: Column, words: Sequence[str]) -> Column:
    """How many of the tokens are one of ``words``; none of an empty list is.
    Membership is a hash lookup per token, whatever the number of words."""
    known = lexicon(words)
    return F.size(F.filter(tokens, lambda t: t.isin(known))) if known else F.lit(0)


def score_texts(
    df: DataFrame,
    positive_words: Sequence[str],
    negative_words: Sequence[str],
    neutral_logit: float = 0.0,
) -> DataFrame:
    """Adds the three probabilities and the net score, all in the JVM. The
    logits are counts of lexicon words in the whole text."""
    tokens = F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")
    df = df.withColumn("_tokens", tokens)
    logits = [
        token_hits(F.col("_tokens"), positive_words).cast("double"),
        F.lit(neutral_logit),
        token_hits(F.col("_tokens"), negative_words).cast("double"),
    ]
    df = df.withColumns({f"_logit_{c}": logit for c, logit in zip(CLASSES, logits)})
    logit_columns = [F.col(f"_logit_{c}") for c in CLASSES]
    df = df.withColumns(dict(zip(CLASSES, softmax(logit_columns))))
    return df.withColumn("sentiment_score", net_sentiment(F.col("positive"), F.col("negative"))).drop(
        "_tokens", *[f"_logit_{c}" for c in CLASSES]
    )


def score_with(
    df: DataFrame,
    factory: ScorerFactory,
    batch_size: int = SCORING_BATCH,
    partitions: int | None = None,
) -> DataFrame:
    """Scores ``text`` with a plugged-in model.

    The model is made once per partition and given at most ``batch_size`` texts
    at a time. Rows keep their columns, so results need no matching by
    position. Partitions are the input's splits, which follow its size;
    ``partitions`` is for an input that has too few of them.
    """
    schema = T.StructType(df.schema.fields + SCORE_FIELDS.fields)
    if partitions is not None:
        df = df.repartition(partitions)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for frame in frames:
            texts = frame["text"].fillna("").tolist()
            rows = []
            for start in range(0, len(texts), batch_size):
                rows.extend(scorer(texts[start : start + batch_size]))
            scores = pd.DataFrame(rows, columns=list(CLASSES), index=frame.index, dtype="float64")
            scores["sentiment_score"] = scores["positive"] - scores["negative"]
            yield pd.concat([frame, scores], axis=1)

    return df.mapInPandas(score, schema)


def lexicon_scorer(
    positive_words: Sequence[str],
    negative_words: Sequence[str],
    neutral_logit: float = 0.0,
) -> ScorerFactory:
    """The scorer of ``score_texts`` as a plug-in, the smallest example of one."""
    sides = (frozenset(lexicon(positive_words)), frozenset(lexicon(negative_words)))

    def factory() -> Scorer:
        import numpy as np

        token = re.compile("[a-z]+")

        def scorer(texts: list[str]):
            logits = np.full((len(texts), 3), neutral_logit)
            for row, text in enumerate(texts):
                words = token.findall(text.lower())
                logits[row, 0] = sum(w in sides[0] for w in words)
                logits[row, 2] = sum(w in sides[1] for w in words)
            exps = np.exp(logits - logits.max(axis=1, keepdims=True))
            return (exps / exps.sum(axis=1, keepdims=True)).tolist()

        return scorer

    return factory
