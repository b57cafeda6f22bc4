from itertools import permutations

import numpy as np
import pytest

from check_oracle import connection, difference
from pitflow.llm import audit, queries

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    found = queries.op11_audit(spark, SF).toPandas()
    assert difference(found, connection(SF).execute(queries.ORACLE_SQL["op11_audit"]).df()) is None
    assert len(found) == 600 * found["part"].nunique()


def plainly(masks, good, toxic):
    """Each order applied filter by filter to a list of documents."""
    for order in permutations(audit.FILTERS):
        left = list(range(len(masks)))
        for step, name in enumerate(order, 1):
            gone = [i for i in left if masks[i] & audit.bit(name)]
            failing = [i for i in range(len(masks)) if masks[i] & audit.bit(name)]
            left = [i for i in left if i not in gone]
            alone = [i for i in failing if masks[i] == audit.bit(name)]
            counts = len(left), len(gone), len(failing) - len(gone), len(alone)
            yield "".join(order), step, *counts, sum(good[i] for i in gone), sum(toxic[i] for i in gone)


@pytest.mark.parametrize("seed", range(3))
def test_walk_equals_filters_in_turn(seed):
    rng = np.random.default_rng(seed)
    masks, good, toxic = rng.integers(0, 32, 60).tolist(), rng.integers(0, 2, 60), rng.integers(0, 2, 60)
    cells = {}
    for m, g, t in zip(masks, good, toxic):
        cells[m] = cells.get(m, np.zeros(3, dtype=np.int64)) + np.array([1, g, t])
    figures = list(audit.step_figures(audit.walk(cells)))
    assert [f[:8] for f in figures] == list(plainly(masks, good, toxic))
    for name in audit.FILTERS:
        own = [f for f in figures if f[0][f[1] - 1] == name]
        assert {f[8] for f in own} == {sum(f[3] for f in own)}


def test_walk_over_no_cells():
    assert not audit.walk({}).any()


def test_odd_rows(spark, make_docs, odd_rows):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int"
    )
    # empty texts: ids 3 (null), 4 and none; the smallest id passes, and the row without one
    found = {
        (r.part, r.filter_order, r.step): r for r in audit.audit(make_docs(odd_rows), labels).collect()
    }
    first = {part: found[part, "EABCD", 1] for part in ("", "a", "b", "c")}
    assert first["a"].removed == 1 and first["a"].kept == 4  # id 4 repeats id 3; the two rows of id 1 stay
    assert first["b"].removed == 1 and first["b"].toxic_lost == 1 and first["b"].good_lost == 0
    assert first[""].removed == 0 and first[""].kept == 2
    assert found["a", "ABCDE", 1].good_lost == 2 and found["a", "ABCDE", 1].toxic_lost == 2


def test_empty_table(spark, make_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = audit.audit(make_docs([]), labels)
    assert found.count() == 0 and found.columns[0] == "part"
