import numpy as np
import pytest

from pitflow.llm import queries, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, size string, d string, component string, n string, at string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, *["x"] * 5) for i, v in rows], SCHEMA)


def plainly(vectors, components=8):
    """x, its covariance's leading eigenpairs in double precision, whitened rows."""
    x = np.floor(1024 * np.array(vectors, dtype=np.float64)) + 100_000
    centred = x - x.mean(axis=0)
    values, directions = np.linalg.eigh(centred.T @ centred / len(x))
    values, directions = values[::-1], directions[:, ::-1]
    return x.astype(int), values, centred @ directions[:, :components] / np.sqrt(values[:components])


def compared(found, ids, vectors):
    x, values, whitened = plainly(vectors)
    n, total = len(x), x.sum(axis=0)
    deviation = dict(zip(ids, ((n * x - total) ** 2).sum(axis=1).tolist()))
    assert len(found) == n * min(8, x.shape[1])
    by_component = {}
    for r in found:
        assert r.n == n and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-10)
        by_component.setdefault(r.component, {})[r.vec_id] = r.whitened
    for c, per in by_component.items():
        mine, own = np.array([per[i] for i in ids]), whitened[:, c - 1]
        assert min(abs(mine - own).max(), abs(mine + own).max()) < 1e-8


def test_query_equals_eigenvectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    good = [r for r in rows if r.embedding is not None and all(v is not None and np.isfinite(v) for v in r.embedding)]
    compared(queries.op13_whitening(spark, SF).collect(), [r.vec_id for r in good], [r.embedding for r in good])


def test_bad_vectors_go_and_repeated_rows_count(spark):
    rng = np.random.default_rng(3)
    vectors = np.round(rng.standard_normal((40, 5)), 3).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)]
    bad = [(90, None), (91, [1.0, None, 1.0, 1.0, 1.0]), (92, [float("nan")] * 5), (93, [float("inf")] * 5), (94, [])]
    found = whitening.whiten(frame(spark, rows + bad).repartition(7)).collect()
    compared(found, range(40), vectors)
    twice = whitening.whiten(frame(spark, rows + rows + [(None, vectors[0])])).collect()
    assert len(twice) == 81 * 5 and {r.n for r in twice} == {81}
    assert sum(r.vec_id is None for r in twice) == 5


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whiten(frame(spark, rows)).count() == 0


def test_components_without_variance(spark):
    alone = whitening.whiten(frame(spark, [(1, [0.5, 0.25])])).orderBy("component").collect()
    assert [(r.component, r.whitened, r.explained, r.identity_error, r.deviation) for r in alone] == [
        (1, None, 0.0, None, 0),
        (2, None, 0.0, None, 0),
    ]
    line = whitening.whiten(frame(spark, [(i, [i / 4, 0.5, -i / 4]) for i in range(9)])).collect()
    assert {r.component for r in line if r.whitened is not None} == {1}
    assert all(r.identity_error < 1e-12 for r in line)


def test_lengths_are_tables_of_their_own(spark):
    rng = np.random.default_rng(5)
    short, long = rng.standard_normal((30, 3)).tolist(), rng.standard_normal((50, 4)).tolist()
    rows = [*enumerate(short), *enumerate(long, 100)]
    found = whitening.whiten(frame(spark, rows)).collect()
    cast = lambda vectors: np.array(vectors, dtype=np.float32)
    compared([r for r in found if r.vec_id < 100], range(30), cast(short))
    compared([r for r in found if r.vec_id >= 100], range(100, 150), cast(long))


def test_deviation_beyond_a_long_is_null(spark):
    found = whitening.whiten(frame(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])])).collect()
    assert {r.deviation for r in found if r.vec_id < 3} == {None}
    assert all(r.whitened is not None for r in found if r.component == 1)


def kinds(d, rng):
    plain = rng.standard_normal((3 * d + 2, d))
    yield plain
    yield plain * np.logspace(0, -8, d)
    yield plain @ rng.standard_normal((d, d))
    yield np.linalg.qr(plain)[0] * 1e5  # all values equal
    yield np.repeat(plain[:, :1], d, axis=1)  # rank 1
    yield np.zeros((2, d))


@pytest.mark.parametrize("d", [1, 2, 3, 8, 40])
def test_solver(d):
    for rows in kinds(d, np.random.default_rng(d)):
        values, vectors = whitening.principal_directions(np.linalg.qr(rows, mode="r"), 8)
        singular = np.linalg.svd(rows, compute_uv=False)
        own = np.sqrt(np.pad(values, (0, len(singular)))[: len(singular)])
        assert np.abs(own - singular).max() <= 1e-12 * max(1e-300, singular[0])
        k = vectors.shape[1]
        assert k == min(8, np.linalg.matrix_rank(rows))
        assert np.abs(vectors.T @ vectors - np.eye(k)).max(initial=0) < 1e-10
        residual = rows.T @ (rows @ vectors) - vectors * values[:k]
        assert np.abs(residual).max(initial=0) <= 1e-11 * max(1e-300, values[0])


def test_small_singular_values_keep_their_digits():
    """A graded bidiagonal matrix, whose small values a covariance would lose."""
    diagonal = 10.0 ** -np.arange(8)
    values = whitening.squared_singular_values(diagonal, np.zeros(7))
    assert np.abs(values / diagonal**2 - 1).max() < 1e-14
    above = diagonal[:-1] / 2
    product = np.sqrt(np.prod(whitening.squared_singular_values(diagonal, above)))
    assert product == pytest.approx(np.prod(diagonal), rel=1e-13)
