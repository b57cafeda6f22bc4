import math
import zlib
from itertools import product

import numpy as np
import pytest

from pitflow.llm.common import sampled_texts
from pitflow.llm import queries, toxicity as tox
from pitflow.llm.letters import lower_letters

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = queries.op3_toxicity(spark, SF).toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert ((got.score >= 0.5) == got.predicted).all() and got.score.between(0, 1).all()
    labelled = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert (labelled.predicted == labelled.toxic)[labelled.held_out].mean() > 0.96
    clean = labelled[labelled.toxic == 0]
    assert clean.predicted.mean() < 0.02


@pytest.fixture(scope="module")
def letters():
    index = np.ones(0x110000, dtype=int)
    index[0] = 0
    for letter, i in tox._INDEX.items():
        if letter:
            index[ord(letter)] = i
    text = "an idiot and a loser saw the stupid clown with some trash this is a moron he said to them all " * 40
    _, points = lower_letters([text])
    x = index[points]
    counts = np.bincount((x[:-2] * tox.SIZE + x[1:-1]) * tox.SIZE + x[2:], minlength=tox.SIZE**3)
    return tox.LetterModel(counts)


@pytest.mark.parametrize(
    "text, word",
    [
        ("You 1D10T!", "idiot"),
        ("you i d i o t you", "idiot"),
        ("s.t.u.p.i.d", "stupid"),
        ("stuuuupid", "stupid"),
        ("that m0r0n.", "moron"),
        ("tr@sh", "trash"),
        ("C-L-O-W-N", "clown"),
        ("l0000ser", "loser"),
        ("plain idiot, here", "idiot"),
    ],
)
def test_restores(letters, text, word):
    assert word in tox.word_set(text, letters.restore)


@pytest.mark.parametrize("around", ["{}!", "{},", "{}.", '"{}"', "({})", "[{}]", "you '{}'?", "so: {}; and", "“{}”…"])
@pytest.mark.parametrize("spaced, word", [("i d i o t", "idiot"), ("m o r o n", "moron"), ("c\nl o\tw  n", "clown")])
def test_restores_spaced_words_beside_punctuation(letters, around, spaced, word):
    assert word in tox.word_set(around.format(spaced), letters.restore)


@pytest.mark.parametrize(
    "text, word",
    [
        ("stuupid", "stupid"),
        ("iddiot", "idiot"),
        ("mooron", "moron"),
        ("so iiddiioott.", "idiot"),
        ("an id-iot, you", "idiot"),
        ("stu.pid", "stupid"),
        ("(id-iot)", "idiot"),
        ("(1d10t)!", "idiot"),
        ("1 d 1 0 t", "idiot"),
        ("you: 1 d 1 0 t!", "idiot"),
        ("idio7", "idiot"),
    ],
)
def test_restores_all_kinds_of_disguise(letters, text, word):
    assert word in tox.word_set(text, letters.restore)


def test_ordinary_spellings_are_restored_unless_plain(letters):
    text = "mooron id-iot wa5 stuuupid th1s"
    assert {"moron", "idiot", "was", "stupid", "this"} <= tox.word_set(text, letters.restore)
    assert {"moron", "idiot", "was"}.isdisjoint(tox.word_set(text, letters.restore, lambda word: True))
    assert {"stupid", "this"} <= tox.word_set(text, letters.restore, lambda word: True)


def test_words_parted_into_longer_pieces():
    weights = tox.WordWeights({"moron": 5.0, "idiot": 5.0, "idio*": 4.0}, 1.0, 0.0)
    assert weights.parted('You "mor on", id\niot! (i di ot) m or on') == {"moron", "idiot"}
    assert weights.parted("a mor, on id. iot moro nic on mor") == set()


def test_viterbi_finds_the_best_of_all_ways(letters):
    """Against all letter choices of a lattice without separators."""

    def score(ways):
        total, last, before = 0.0, "", ""
        for cost, letter in ways:
            total += cost + float(letters.log[tox._INDEX.get(before, 1), tox._INDEX.get(last, 1)][tox._INDEX[letter]])
            before, last = last, letter
        return total + float(letters.log[tox._INDEX[before], tox._INDEX[last]][0])

    for hidden in ("1d10t", "cl0wn", "m0r0n", "1o5er"):
        options = []
        for c in hidden:
            if c.isalpha():
                options.append([(0.0, c)])
            else:
                options.append([(tox.SIGN - math.log(len(tox.SIGNS[c])), x) for x in tox.SIGNS[c]])
        best = max(product(*options), key=score)
        assert letters.restore(hidden) == "".join(x for _, x in best)


def test_plain_words_and_numbers_stay(letters):
    got = tox.word_set("In 2024 the cat, a dog; über-fluß (x) 12.5% v2", letters.restore)
    assert {"in", "the", "cat", "a", "dog", "über", "fluß", "x", "v"} <= got


def test_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    labels = spark.createDataFrame([(1, 0, 1), (6, 1, 0), (None, 1, 1), (8, None, None), (1, 0, 1)], "doc_id long, toxic int, quality int")
    got = tox.score_documents(docs, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1
    kept = tox.clean(docs, labels.where("false"))
    assert kept.columns == docs.columns and kept.count() in (0, len(odd_rows))
    assert tox.clean(make_docs([]), labels).count() == 0
    assert tox.score_documents(make_docs([]), labels).count() == 0


def test_clean_documents_stay(spark, make_docs):
    rows = [(i, f"some ordinary words number {i % 13} and more") for i in range(60)]
    rows += [(100 + i, f"you are an idiot and a moron {i}") for i in range(30)]
    rows += [(200, "you 1d10t and m0r0n"), (201, "fine words")]
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows[:90]], "doc_id long, toxic int")
    kept = {r.doc_id for r in tox.clean(make_docs(rows), labels).collect()}
    assert kept == {*range(60), 201}


def test_a_feature_counts_once_a_document(spark, make_docs, letters):
    """Five words of one beginning in a good document are one document with it."""
    rows = [(i, "idiot idiotic") for i in range(20)] + [(100 + i, "idiots idioms idiomatic idiocy idiots") for i in range(2)]
    rows += [(200 + i, f"fine words {i}") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id long, toxic int")
    used = [i for i, _ in rows if zlib.crc32(str(i).encode()) % tox.FOLDS]
    bad, good = sum(i < 100 for i in used), sum(i >= 100 for i in used)
    with_it = sum(100 <= i < 200 for i in used)
    weights = tox.learn(make_docs(rows), labels, letters).weights
    want = math.log((bad + 0.1) / (bad + 0.2)) - math.log((with_it + 0.1) / (good + 0.2))
    assert with_it and ("idio*" in weights) == (want > tox.TELLING)
    monkey = tox.TELLING
    tox.TELLING = 0.1
    try:
        weights = tox.learn(make_docs(rows), labels, letters).weights
    finally:
        tox.TELLING = monkey
    assert weights["idio*"] == pytest.approx(want)


def test_memory_of_places_is_bounded_by_their_size(letters, monkeypatch):
    monkeypatch.setattr(tox, "REMEMBERED", 1000)
    restore = tox.remembered(letters)
    held = restore.__closure__[[c for c in restore.__code__.co_freevars].index("known")].cell_contents
    for i in range(60):
        assert restore(f"1d10t{'x' * i}") == letters.restore(f"1d10t{'x' * i}")
        assert sum(len(k) + len(v) + tox.ENTRY for k, v in held.items()) <= 1000
    restore("1d" * 2000)
    assert "1d" * 2000 not in held


def plain_score(text, letters, weights):
    """The score word by word: all words of the restored text, each with the
    weight of the whole word or of its telling beginnings, whichever is largest."""
    words = tox.word_set(text or "", letters.restore, weights.telling) | weights.parted(text or "")
    evidence = 0.0
    for word in words:
        options = [weights.weights.get(word, 0.0)] + [weights.weights.get(word[:n] + "*", 0.0) for n in tox.PREFIXES if len(word) >= n]
        evidence += max(*options, 0.0)
    return 1 / (1 + math.exp(-(weights.offset + weights.slope * math.log1p(evidence))))


def test_scores_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    letters = tox.letter_model(docs)
    weights = tox.learn(docs, labels, letters)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in tox.score_documents(docs, labels).collect():
        assert row.score == pytest.approx(plain_score(texts[row.doc_id], letters, weights), abs=1e-9)
        assert row.predicted == (row.score >= 0.5) and row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)


def test_one_row_of_an_id_is_learned_from(spark, make_docs):
    docs = make_docs([(1, "b"), (1, "a"), (1, None), (2, "c"), (None, "d"), (3, "e")])
    sample = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    got = sorted((r.doc_id, r.toxic) for r in sampled_texts(docs, sample).collect())
    assert got == [(1, 1), (2, 0)]
