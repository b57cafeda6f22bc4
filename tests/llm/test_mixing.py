import os

import duckdb
import pytest
from pyspark.sql import functions as F

from pitflow.llm import mixing, queries

SF = "/root/testdata/sf0.001"


def test_against_sql_on_the_documents(spark):
    got = queries.op7_mixing(spark, SF).toPandas().sort_values("doc_id", ignore_index=True)
    want = duckdb.sql(mixing.ORACLE.replace("{docs}", f"'{SF}/documents.parquet'")).df()
    want = want.sort_values("doc_id", ignore_index=True)[list(got.columns)]
    assert got.equals(want.astype(got.dtypes.to_dict()))


@pytest.mark.parametrize("many", [1, 5])
def test_odd_rows_against_sql(spark, make_docs, odd_rows, many, tmp_path):
    rows = odd_rows * many
    make_docs(rows, clashing=False).coalesce(1).write.parquet(str(tmp_path / "d"))
    path = next(str(tmp_path / "d" / f) for f in os.listdir(tmp_path / "d") if f.endswith(".parquet"))
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    got = [tuple(r) for r in mixing.mix(make_docs(rows)).select(*columns).collect()]
    want = duckdb.sql(mixing.ORACLE.replace("{docs}", f"'{path}'")).select(*columns).fetchall()
    order = lambda row: [(v is None, v or 0) for v in row]
    assert sorted(got, key=order) == sorted(want, key=order)


def test_sources_come_near_their_targets(spark, make_docs):
    rows = [(i, "w " * (1 + i % 7), "en", f"s{i % 5}") for i in range(4000)]
    for row in mixing.mix(make_docs(rows)).groupBy("source", "target").sum("taken").collect():
        assert abs(row["sum(taken)"] - row["target"]) <= 7


def test_targets_reshare_the_excess(spark, make_docs):
    # weights 3, 1, 2: a's share 150 % * 300 / 2 = 225 exceeds 2 * 100
    rows = [(i, "w", "en", "abc"[i % 3]) for i in range(300)]
    got = {r["source"]: r["target"] for r in mixing.mix(make_docs(rows)).select("source", "target").distinct().collect()}
    assert got["a"] == 200 and got["b"] == pytest.approx(250 / 3) and got["c"] == pytest.approx(500 / 3)


def test_mixed_repeats_the_rows_themselves(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    want = sum(r["repeats"] for r in mixing.mix(docs).collect())
    got = mixing.mixed(docs)
    assert got.columns == docs.columns and got.count() == want


def test_empty_table(spark, make_docs):
    assert mixing.mix(make_docs([])).count() == 0
    assert mixing.mixed(make_docs([])).count() == 0


def test_repeated_ids_are_taken_one_by_one(spark, make_docs):
    rows = [(7, "eight words of one text that is repeated", "en", "a")] * 100 + [(i, "w " * 8, "en", "b") for i in range(100)]
    for table in (mixing.mix(make_docs(rows)), mixing.mix(make_docs([(None, *r[1:]) for r in rows]))):
        for row in table.groupBy("source", "target").sum("taken").collect():
            assert abs(row["sum(taken)"] - row["target"]) <= 8
    docs = make_docs(rows)
    assert mixing.mixed(docs).groupBy("source").count().collect() == mixing.mix(docs).groupBy("source").agg(
        F.sum("repeats").alias("count")
    ).collect()


def test_many_sources_without_broadcast(spark, make_docs, odd_rows, monkeypatch):
    rows = odd_rows + [(100 + i, "w " * (i % 9), "en", f"s{i % 7}") for i in range(300)]
    want = sorted(map(repr, mixing.mix(make_docs(rows)).collect()))
    texts = sorted(map(repr, mixing.mixed(make_docs(rows)).collect()))
    monkeypatch.setattr(mixing, "FEW", 3)
    assert sorted(map(repr, mixing.mix(make_docs(rows)).collect())) == want
    assert sorted(map(repr, mixing.mixed(make_docs(rows)).collect())) == texts


def test_texts_are_not_shuffled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mixing.mixed(docs)
    mixed.write.format("noop").mode("overwrite").save()
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan and "Exchange hash" not in plan and "Exchange rangepart" not in plan


def test_clashing_names(spark):
    names = "_mix _copy doc copy src h salt salt_of cell number first again_id again_source count repeats".split()
    docs = spark.createDataFrame(
        [(1, "a b", "s", *names), (1, "a b", "s", *names), (2, "c", None, *names)],
        ["doc_id", "text", "source", *names],
    )
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and {r.salt for r in mixed.collect()} <= {"salt"}
    assert mixing.mix(docs).count() == 3


def test_no_python_in_the_plan(spark, make_docs, odd_rows):
    plan = mixing.mix(make_docs(odd_rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
