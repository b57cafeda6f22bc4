"""Small tables for the operators of the llm subpackage."""

import pytest

from tests.session import local_session

#: Columns that operators use for themselves must not matter in the input.
CLASHING = (
    "size h fp rep component group item shard cell order slot score r doc at p block guest own x d i j tile side "
    "links root node label_ words toxic quality src whole threshold pieces decoded languages starts"
).split()


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, clashing=True):
        """Documents from (doc_id, text, lang, source) rows."""
        schema = "doc_id long, text string, lang string, source string"
        frame = spark.createDataFrame([(*r, *[None] * (4 - len(r))) for r in rows], schema)
        if clashing:
            frame = frame.selectExpr("*", *(f"'{c}' AS {c}" for c in CLASHING))
        return frame

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} of{i % 31}" for i in range(60_000))
    return [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a"),
        (1, "the quick brown fox jumps over the lazy dog", "en", "a"),
        (2, "the quick brown fox jumps over the lazy dog", "en", "b"),
        (3, None, "en", None),
        (4, "", None, "a"),
        (5, " \t\n ", "en", "a"),
        (6, long, "en", "a"),
        (None, "a text without an id", "en", "b"),
        (None, None, None, None),
        (8, "¡™£¢∞ 日本語 🙂 1d10t i d i o t", "es", "c"),
    ]
