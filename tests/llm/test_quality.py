import zlib

import numpy as np

from pitflow.llm import quality, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = queries.op2_quality(spark, SF).toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert ((got.score >= 0.3) == got.predicted).all() and got.score.between(0, 1).all()
    labelled = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert (labelled.predicted == labelled.quality)[labelled.held_out].mean() > 0.97


def test_weights_maximise_the_likelihood_of_the_wins():
    r = np.random.default_rng(0)
    differences = r.standard_normal((500, 3)) + np.array([0.5, 0.0, -0.2])
    w = quality._maximised(differences)

    def loss(v):
        return np.logaddexp(0, -differences @ v).sum() + quality.RIDGE * 500 * (v @ v) / 2

    for step in np.vstack([np.eye(3), -np.eye(3)]) * 1e-3:
        assert loss(w) <= loss(w + step)


def test_threshold_is_the_quantile_of_the_bad_share():
    r = np.random.default_rng(1)
    good = r.random(1000) < 0.8
    x = r.standard_normal((1000, len(quality.FEATURES)))
    x[:, 0] += good * 3
    ranking = quality.ranked(x, good)
    below = (ranking.strength(x) < ranking.threshold).mean()
    assert abs(below - (1 - good.mean())) <= 0.001
    assert ((ranking.score(x) >= quality.CUT) == (ranking.strength(x) >= ranking.threshold)).all()


def test_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (8, None), (1, 1), (2, 1)], "doc_id long, quality int")
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1
    assert {r.predicted for r in quality.score_documents(docs, labels.where("quality = 1")).collect()} == {1}
    assert quality.score_documents(docs, labels.where("false")).count() == len(odd_rows)
    assert quality.score_documents(make_docs([]), labels).count() == 0


def test_draws_of_pairs_have_settled():
    """Another draw of as many pairs scores few documents otherwise by more than 0.05."""
    r = np.random.default_rng(3)
    good = r.random(4000) < 0.7
    x = r.standard_normal((4000, len(quality.FEATURES))) + good[:, None] * r.random(len(quality.FEATURES))
    one, other = quality.ranked(x, good, 1).score(x), quality.ranked(x, good, 2).score(x)
    assert np.abs(one - other).mean() < 0.01 and np.quantile(np.abs(one - other), 0.99) < 0.05


def test_scores_against_brute_force(spark):
    """Every feature from its definition, one text at a time, and the weights by
    plain gradient steps on the same pairs."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    ranking = quality.learn(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in quality.score_documents(docs, labels).collect():
        z = (np.array(quality.measured(texts[row.doc_id])) - ranking.mean) / ranking.spread
        strength = sum(a * b for a, b in zip(z, ranking.weights))
        at = ranking.slope * (strength - ranking.threshold) + np.log(0.3 / 0.7)
        assert abs(row.score - 1 / (1 + np.exp(-np.clip(at, -40, 40)))) < 1e-9


def test_features_of_a_text():
    text = "Hello hello WORLD world world! 42 | ab\nab ab"
    found = dict(zip(quality.FEATURES, quality.measured(text)))
    assert found["words"] == np.log1p(10) and found["different_words"] == 8 / 10
    assert found["most_frequent_word"] == np.sqrt(3 / 10) and found["repeated_neighbours"] == np.sqrt(2 / 10)
    assert found["different_lines"] == 1.0 and found["upper_case"] == np.sqrt(1 / 10)
    assert found["digits"] == np.sqrt(2 / len(text)) and found["bars"] == np.sqrt(1 / len(text))
    assert found["words_without_letters"] == np.sqrt(2 / 10)


def labelled(n, seed=5):
    r = np.random.default_rng(seed)
    good = r.random(n) < 0.7
    x = r.standard_normal((n, len(quality.FEATURES))) + good[:, None] * r.random(len(quality.FEATURES))
    return x, good


def test_all_pairs_teach():
    """Every pair of a good and a bad row listed, against what ``ranked`` makes of them."""
    x, good = labelled(300)
    one, other = quality.ranked(x, good), quality.ranked(x, good, 7)
    z = (x - one.mean) / one.spread
    pairs = (z[good][:, None] - z[~good][None]).reshape(-1, len(quality.FEATURES))
    assert np.abs(one.weights - quality._maximised(pairs)).max() < 1e-6
    assert np.abs(one.score(x) - other.score(x)).max() < 1e-9


def test_sums_over_pairs_of_grid_points():
    x, good = labelled(200)
    w = np.random.default_rng(6).standard_normal(x.shape[1]) * 2
    value, gradient, curvature = quality._of_all_pairs(
        lambda width, part: quality._added([part(x, good)]), lambda x: x, x.shape[1]
    )(w)
    pairs = (x[good][:, None] - x[~good][None]).reshape(-1, x.shape[1])
    lost = 1 / (1 + np.exp(pairs @ w))
    assert abs(value + np.logaddexp(0, -pairs @ w).mean()) < 1e-9
    assert np.abs(gradient - (pairs * lost[:, None]).mean(axis=0)).max() < 1e-9
    exact = (pairs * (lost * (1 - lost))[:, None]).T @ pairs / len(pairs)
    assert np.abs(curvature() - exact).max() < 0.01 * np.abs(exact).max()


def test_strengths_at_ranks():
    r = np.random.default_rng(8)
    s = np.concatenate([r.standard_normal(500), np.repeat([-1.5, -0.0, 0.0, 2.5, 1e-300, -1e9], 20), -r.random(50) * 1e-9])
    ranks = [0, 1, 50, 51, 300, 400, len(s) - 2, len(s) - 1]
    x = s[:, None]
    found = quality._at_ranks(lambda width, part: quality._added([part(x, None)]), lambda x: x[:, 0], ranks)
    assert (found == np.sort(s)[ranks]).all()


def test_every_labelled_row_teaches(spark):
    """More rows than were once learned from at most, in tasks of their own."""
    n = 27_000
    docs = spark.range(n, numPartitions=3).selectExpr(
        "id AS doc_id", "concat_ws(' ', repeat('word ', int(id % 23)), id, if(id % 7 < 3, '!', 'end.')) AS text"
    )
    labels = docs.selectExpr("doc_id", "int(doc_id % 7 > 1 OR doc_id % 23 = 5) AS quality")
    ranking = quality.learn(docs, labels)
    rows = [r for r in docs.join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    assert len(rows) > 20_000
    x, good = np.array([quality.measured(r.text) for r in rows]), np.array([r.quality == 1 for r in rows])
    assert np.abs(ranking.mean - x.mean(axis=0)).max() < 1e-9
    assert np.abs(ranking.spread[x.std(axis=0) > 1e-9] - x.std(axis=0)[x.std(axis=0) > 1e-9]).max() < 1e-9
    assert ranking.threshold == np.sort(ranking.strength(x))[[(~good).sum() - 1, (~good).sum()]].mean()
    assert np.abs(ranking.score(x) - quality.ranked(x, good).score(x)).max() < 1e-6
