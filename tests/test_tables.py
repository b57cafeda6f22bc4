"""Batch-keyed tables: replays, moved keys, empty batches, compaction."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from pitflow.functions.shared import shared_folder
from pitflow.schemas import BAR, RAW_POST
from pitflow.sources.tables import (
    BAR_KEY,
    POST_KEY,
    batch_path,
    compact,
    current,
    over_base,
    read_batches,
    upsert,
    write_batch,
)
from tests.helpers import at, bars


def posts(spark, *rows):
    return spark.createDataFrame([(i, t, at(when), "news", text) for i, t, when, text in rows], RAW_POST)


FIRST = [("1", "A", "2024-01-02 10:00", "one"), ("2", "B", "2024-01-02 10:00", "two"), ("3", "007", "2024-01-03 10:00", "three")]
MOVED = [("1", "A", "2024-01-05 10:00", "moved"), ("4", "A", "2024-01-05 10:00", "new")]


def texts(df):
    return sorted((r.id, r.text) for r in df.collect())


@pytest.fixture
def root(spark):
    return shared_folder(spark, "table")


def read(spark, root):
    return current(read_batches(spark, root, RAW_POST), POST_KEY)


def test_upsert_moves_a_row_to_its_new_date(spark, root):
    write_batch(posts(spark, *FIRST), root, 0)
    write_batch(posts(spark, *MOVED), root, 1)
    found = read(spark, root)
    assert texts(found) == [("1", "moved"), ("2", "two"), ("3", "three"), ("4", "new")]
    assert found.filter("id = '1' and date = date'2024-01-02'").count() == 0
    assert found.filter("ticker = '007'").count() == 1
    plain = upsert(posts(spark, *FIRST), posts(spark, *MOVED), POST_KEY)
    assert texts(plain) == texts(found)


def test_ties_do_not_depend_on_row_order(spark, root):
    twice = [("1", "A", "2024-01-02 10:00", "a"), ("1", "A", "2024-01-02 10:00", "b"), ("1", "A", "2024-01-02 09:00", "z")]
    for rows in (twice, twice[::-1]):
        assert texts(upsert(posts(spark), posts(spark, *rows), POST_KEY)) == [("1", "b")]
        write_batch(posts(spark, *rows), root, 0, key=POST_KEY)
        assert texts(read_batches(spark, root, RAW_POST)) == [("1", "b")]


def test_unnamed_feeds_and_missing_tables_are_errors(spark, root):
    with pytest.raises(AnalysisException):
        read_batches(spark, root, RAW_POST)
    assert read_batches(spark, root, RAW_POST, missing_ok=True).count() == 0
    write_batch(posts(spark, *FIRST), root, 0)
    write_batch(posts(spark, *MOVED), root, 0, "v2")
    with pytest.raises(Exception, match="feed not in feeds: v2"):
        read(spark, root).collect()


@pytest.mark.parametrize("replay", [MOVED, MOVED[:1], MOVED[1:], []])
def test_a_replayed_batch_leaves_exactly_its_last_attempt(spark, root, replay):
    write_batch(posts(spark, *FIRST), root, 0)
    write_batch(posts(spark, *MOVED), root, 1)
    write_batch(posts(spark, *replay), root, 1)
    assert texts(read(spark, root)) == texts(upsert(posts(spark, *FIRST), posts(spark, *replay), POST_KEY))


def test_later_feed_wins_although_its_batches_restart(spark, root):
    write_batch(posts(spark, *FIRST), root, 7, "old")
    write_batch(posts(spark, *MOVED), root, 0, "new")
    found = current(read_batches(spark, root, RAW_POST), POST_KEY, ("old", "new"))
    assert texts(found)[0] == ("1", "moved")
    assert read_batches(spark, root, RAW_POST, upto_batch=0).count() == 2


def test_a_table_nobody_wrote_is_empty_if_that_is_expected(spark, root):
    assert current(read_batches(spark, root, RAW_POST, missing_ok=True), POST_KEY).count() == 0


def test_rows_are_counted_by_the_write_itself(spark, root):
    seen = Observation("written")
    write_batch(posts(spark, *FIRST), root, 0, observation=seen)
    assert seen.get == {"rows": 3}


def test_a_column_added_later_reads_as_null_in_old_files(spark, root):
    write_batch(posts(spark, *FIRST), root, 0)
    write_batch(posts(spark, *MOVED).withColumn("likes", F.lit(5)), root, 1)
    wider = type(RAW_POST)(list(RAW_POST.fields)).add("likes", IntegerType())
    found = current(read_batches(spark, root, wider), POST_KEY)
    assert {r.id: r.likes for r in found.collect()} == {"1": 5, "2": None, "3": None, "4": 5}


def test_compaction_keeps_current_rows_in_fewer_files(spark, root):
    for batch in range(4):
        write_batch(posts(spark, *FIRST), root, batch)
    write_batch(posts(spark, *MOVED), root, 4)
    target = shared_folder(spark, "compacted")
    compact(read(spark, root), target, cluster_by=["id"])
    assert texts(read(spark, target)) == texts(read(spark, root))
    files = lambda path: len(spark.read.schema(RAW_POST).parquet(path).inputFiles())
    assert files(target) < files(root)


def test_later_batches_over_a_compacted_base(spark, root):
    write_batch(posts(spark, *FIRST), root, 0)
    base = shared_folder(spark, "base")
    compact(read(spark, root), base)
    write_batch(posts(spark, *MOVED), root, 1)
    later = current(read_batches(spark, root, RAW_POST).filter("batch_id > 0"), POST_KEY)
    found = over_base(read_batches(spark, base, RAW_POST), later, POST_KEY)
    assert texts(found) == texts(read(spark, root))


def test_date_and_ticker_filters_on_bars_prune_partitions(spark, root):
    write_batch(bars(spark, [("A", at("10:00"), 1.0), ("B", at("2024-01-03 10:00"), 2.0)]), root, 0)
    write_batch(bars(spark, [("A", at("10:00"), 3.0)]), root, 1)
    found = current(read_batches(spark, root, BAR), BAR_KEY).filter("ticker = 'A' and date = date'2024-01-02'")
    assert [r.close for r in found.collect()] == [3.0]
    plan = found._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "ticker" in pruned and "date" in pruned


def test_batch_folders(spark):
    assert batch_path("r", 3, "f") == "r/feed=f/batch_id=3"
