import zlib

import numpy as np
import pytest

from pitflow.llm import language, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = queries.op6_language(spark, SF).toPandas().merge(
        spark.read.parquet(f"{SF}/documents.parquet").toPandas(), on="doc_id"
    )
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert (got.lang == got.lang_pred)[got.held_out].mean() > 0.99
    assert got.score.between(0, 1).all()


@pytest.fixture(scope="module")
def model():
    counts = np.zeros((2, language.BUCKETS))
    texts = ["the cat and the dog are here with them", "der hund und die katze sind hier bei uns"]
    for i, t in enumerate(texts):
        _, gram = language.trigrams([t * 20])
        counts[i] = np.bincount(gram, minlength=language.BUCKETS)
    return language.Model(["de", "en"], counts[::-1])


def test_mixture_of_two_languages(model):
    mixed = "the cat and the dog are here with them " * 6 + "der hund und die katze sind hier bei uns " * 3
    [(lang, score, shares)] = model.infer([mixed])
    assert lang == "en" and 0.55 < score < 0.75 and shares.startswith("en:") and ",de:" in shares
    [(lang, score, shares)] = model.infer(["the cat and the dog"])
    assert (lang, score, shares) == ("en", 1.0, "en:1.000")


def test_proportions_match_plain_em(model):
    text = "the cat and der hund with them bei uns"
    _, gram = language.trigrams([text])
    weights = np.array([0.5, 0.5])
    for _ in range(language.ROUNDS):
        part = model.p[gram].astype(float) * weights
        weights = (part / part.sum(axis=1, keepdims=True)).mean(axis=0)
    unique, counts = np.unique(gram, return_counts=True)
    fit = language._Fit(model.p[unique], counts.astype(np.float32), np.array([0]))
    assert fit.run(np.full((1, 2), 0.5, np.float32))[0][0] == pytest.approx(weights, abs=1e-4)


def test_texts_do_not_depend_on_their_neighbours(model):
    texts = ["der hund", "", "the dog and the cat", "123 !!", "die katze und"]
    assert model.infer(texts) == [model.infer([t])[0] for t in texts]


def test_odd_rows(spark, make_docs, odd_rows):
    got = {(r.doc_id, r.lang_pred) for r in language.identify(make_docs(odd_rows)).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (None, "und")} <= got
    assert language.identify(make_docs(odd_rows)).count() == len(odd_rows)


def test_nothing_to_learn_from(spark, make_docs):
    got = language.identify(make_docs([(1, "some text"), (2, "more")])).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert language.identify(make_docs([])).count() == 0


def test_rejection_keeps_columns_and_clean_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    kept = language.identified(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 6, 8, None}


def test_a_column_of_other_values_is_not_learned_whole(spark, make_docs, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    rows = [(i, "the cat and the dog are here", "en") for i in range(40)]
    rows += [(100 + i, "der hund und die katze sind hier", "de") for i in range(30)]
    rows += [(200 + i, f"words of {i}", f"junk {i}") for i in range(50)]
    assert {r.lang_pred for r in language.identify(make_docs(rows)).collect()} == {"en", "de"}
