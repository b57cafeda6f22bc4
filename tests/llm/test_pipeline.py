import corpus_pipeline
import __spark_entry__ as driver
from pitflow.llm import language, mixing, queries, simhash, stages, toxicity
from pitflow.llm.pieces import MODEL, lattice, read_pieces, SHARPNESS

SF = "/root/testdata/sf0.001"


def test_every_query_is_registered():
    names = driver.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(queries.QUERIES) <= set(names) and set(queries.ORACLE_SQL) <= set(driver.oracle_sql())


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, state = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in state.collect()}
        result = stage(spark, state, SF)
        assert result.columns == columns, name
        rows = result.collect()
        assert all(before[r.doc_id] == r for r in rows), name
        ids = [r.doc_id for r in rows]
        if stage is stages.language_id:
            want = [r.doc_id for r in language.identify(state).where("lang_pred != 'und'").collect()]
        elif stage is stages.toxic_removed:
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            want = [r.doc_id for r in toxicity.score_documents(state, labels).where("predicted = 0").collect()]
        elif stage is stages.simhash_near_dedup:
            want = [r.doc_id for r in simhash.simhash_groups(state).where("doc_id = component_id").collect()]
        else:
            want = [r.doc_id for r in mixing.mix(state).collect() for _ in range(r.repeats)]
        assert sorted(ids) == sorted(want) and ids, name
        state = spark.createDataFrame(rows, docs.schema)
    texts = {r.doc_id: r.text for r in state.collect()}
    own = lattice(read_pieces(MODEL), SHARPNESS)
    for r in corpus_pipeline.STAGES[-1][1](spark, state, SF).collect():
        assert r.lossless and own.decode(r.pieces) == texts[r.doc_id]


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.where("NOT lossless").count() == 0 and rows.count() > 100


def test_stages_over_odd_rows_and_none(spark, make_docs, odd_rows):
    rows = odd_rows + [(50 + i, f"ordinary words of a text, number {i}", "en", "a") for i in range(30)]
    docs, labels = make_docs(rows), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, make_docs([])):
            result = stage(spark, table, SF)
            if name != "sentencepiece":
                assert result.columns == docs.columns, name
            held = {repr(r) for r in table.collect()}
            found = result.collect()
            assert table is docs or not found, name
            if name in ("language_id", "toxicity", "simhash_near_dedup", "mixing"):
                assert {repr(r) for r in found} <= held, name
            else:
                assert len(found) == table.count() and all(r.lossless for r in found)
    kept = stages.language_id(spark, docs, SF).collect()
    # all but the two null texts, the empty one and that of white space
    assert len(kept) == len(rows) - 4
    assert len(stages.toxic_removed(spark, docs, SF).collect()) >= len(rows) - 2
