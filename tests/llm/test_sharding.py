import random
import zlib

import pytest

from pitflow.llm import sharding


def plain_best_fit(sizes, capacity):
    free, where = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(room, b) for b, room in enumerate(free) if room >= sizes[i]]
        if fits:
            b = min(fits)[1]
        else:
            free.append(capacity)
            b = len(free) - 1
        free[b] -= sizes[i]
        where[i] = b
    return where, len(free)


@pytest.mark.parametrize("seed", range(6))
def test_tree_packs_like_a_linear_search(seed):
    r = random.Random(seed)
    sizes = [r.choice([1, 2, 5, 9, r.randint(1, 60)]) for _ in range(300)]
    for capacity in (60, 75, 200):
        assert sharding.best_fit_decreasing(sizes, capacity) == plain_best_fit(sizes, capacity)


def test_tree_stays_balanced():
    tree = sharding.Capacities()
    for i in range(2000):
        tree.add(i, i)
    assert tree.root.height <= 15
    for i in range(0, 2000, 2):
        assert tree.take_tightest(i) == (i, i)
    assert tree.root.height <= 14 and tree.take_tightest(2000) is None


def check(rows, got, shards=16):
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 1
    want = sorted((repr(i), size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in got) == want
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.law for r in got} <= {"bytes"} and {r.grown_shard for r in got} <= {None}


@pytest.mark.parametrize("cell_rows", [1 << 17, 20])
def test_near_equal_bytes_and_whole_groups(spark, make_docs, monkeypatch, cell_rows):
    monkeypatch.setattr(sharding, "CELL_ROWS", cell_rows)
    r = random.Random(1)
    rows = [(i, "x" * r.randint(0, 400) + str(r.randint(0, 2000))) for i in range(3000)]
    got = sharding.shard(make_docs(rows)).collect()
    check(rows, got)
    loads = [sum(x.size for x in got if x.shard == s) for s in range(16)]
    assert max(loads) - min(loads) <= 0.02 * max(loads)
    texts = dict(rows)
    place = {}
    for row in got:
        assert place.setdefault(texts[row.doc_id], row.shard) == row.shard


def test_group_above_a_shard_is_divided(spark, make_docs):
    rows = [(i, "a copy of this text") for i in range(1000)] + [(2000 + i, f"text number {i}") for i in range(1500)]
    got = sharding.shard(make_docs(rows)).collect()
    check(rows, got)
    loads = [sum(x.size for x in got if x.shard == s) for s in range(16)]
    assert max(loads) - min(loads) <= 0.05 * max(loads)


def test_equal_rows_without_id_are_divided_too(spark, make_docs):
    rows = [(None, "same text")] * 1600 + [(i, f"t{i}") for i in range(200)]
    got = sharding.shard(make_docs(rows)).collect()
    check(rows, got)
    loads = [sum(x.size for x in got if x.shard == s) for s in range(16)]
    assert max(loads) - min(loads) <= 0.05 * max(loads)


def test_every_group_is_packed_by_best_fit_decreasing(spark, make_docs):
    """3,000 groups of one to six copies, against best fit decreasing on the groups."""
    r = random.Random(9)
    texts = ["x" * r.choice([3, 17, 40, r.randint(0, 300)]) + str(i) for i in range(3000)]
    rows = [(i, t) for i, t in enumerate(t for t in texts for _ in range(r.choice([1, 1, 1, 2, 6])))]
    got = sharding.shard(make_docs(rows)).collect()
    check(rows, got)
    place, size = {}, {}
    for (_, text), row in zip(rows, sorted(got, key=lambda x: x.doc_id)):
        assert place.setdefault(text, row.shard) == row.shard
        size[text] = size.get(text, 0) + row.size
    sizes = list(size.values())
    capacity = -(-sum(sizes) // 16)
    while plain_best_fit(sizes, capacity)[1] > 16:
        capacity += 1
    bins, _ = plain_best_fit(sizes, capacity)
    by_bin = lambda where: sorted(sorted(s for s, b in zip(sizes, where) if b == n) for n in range(16))
    assert by_bin(bins) == by_bin([place[t] for t in size])


def test_hot_sizes_and_groups_are_numbered_in_cells(spark, make_docs, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 30)
    rows = [(None, "a copy")] * 700 + [(1, "more")] * 90 + [(i, f"{i:05d}") for i in range(900)]
    check(rows, sharding.shard(make_docs(rows)).collect())


def test_odd_rows(spark, make_docs, odd_rows):
    check(odd_rows, sharding.shard(make_docs(odd_rows)).collect())
    assert sharding.shard(make_docs([])).count() == 0
