import random

import numpy as np
import pytest
import xxhash

from pitflow.llm import simhash
from pitflow.llm.components import connected_components, local_roots


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize(
    "text", [None, "", " \t\x0b", "One", "ONE two\x0cthree", "É a b c d e f É Ñ 日本 x y", "a b c d " * 5000]
)
def test_fingerprint(text):
    assert simhash.fingerprint_of(text) % 2**64 == plain_fingerprint(text)


@pytest.mark.parametrize("spelled", [1 << 21, 500])
def test_meeting_finds_exactly_the_pairs_within_four_bits(monkeypatch, spelled):
    monkeypatch.setattr(simhash, "SPELLED", spelled)
    r = random.Random(3)
    fps = [r.getrandbits(64) for _ in range(12)]
    for _ in range(60):  # chains of near ones
        fps.append(r.choice(fps) ^ sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 3, 4, 5, 6]))))
    fps = sorted(set(fps))
    want = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    bits = 6
    links = []
    for key in range(1 << bits):
        near = [f for f in fps if ((f >> (64 - bits)) ^ key).bit_count() <= 2]
        if near:
            at = np.array(near, dtype=np.uint64).view(np.int64)
            a, b = simhash.bucket_links(key, at, np.array([fps.index(f) for f in near]), bits)
            links += zip(a.tolist(), b.tolist())
    assert all((fps[a] ^ fps[b]).bit_count() >= 1 for a, b in links)
    roots = local_roots(len(fps), *(np.array(x, dtype=int) for x in zip(*links)))
    assert {f: fps[roots[i]] for i, f in enumerate(fps)} == want


def test_links_of_a_crowded_bucket_are_folded_as_they_come(monkeypatch):
    r = random.Random(7)
    base = r.getrandbits(64) >> 6  # all in bucket 0
    fps = sorted({base ^ sum(1 << b for b in r.sample(range(50), 2)) for _ in range(300)})
    at, ids = np.array(fps, dtype=np.uint64).view(np.int64), np.arange(len(fps))
    whole = simhash.bucket_links(0, at, ids, 6)
    most = []

    def counted(n, a, b):
        most.append(len(a))
        return local_roots(n, a, b)

    monkeypatch.setattr(simhash, "local_roots", counted)
    monkeypatch.setattr(simhash, "SPELLED", 2000)
    monkeypatch.setattr(simhash, "HELD_LINKS", 500, raising=False)
    folded = simhash.bucket_links(0, at, ids, 6)
    assert [x.tolist() for x in folded] == [x.tolist() for x in whole] and len(folded[0]) == len(fps) - 1
    assert max(most) < 500 + 2000 + len(fps)


def test_groups_against_brute_force(spark, make_docs, odd_rows):
    r = random.Random(5)
    base = [[r.choice("abcdefghij") * r.randint(1, 6) for _ in range(300)] for _ in range(12)]
    texts = []
    for words in base:
        for _ in range(4):
            copy = list(words)
            for _ in range(r.choice([0, 0, 1, 2])):
                copy[r.randrange(300)] = "changed"
            texts.append(" ".join(copy))
    rows = [(100 + i, t) for i, t in enumerate(texts)] + odd_rows
    got = simhash.simhash_groups(make_docs(rows)).collect()
    assert len(got) == len(rows)
    want = {}
    for row in rows:
        if row[0] is not None:
            want[row[0]] = plain_fingerprint(row[1])
    groups = plain_components(sorted(want), lambda a, b: (want[a] ^ want[b]).bit_count() <= 4)
    assert len(set(groups.values())) < len(groups) - 12
    for row in got:
        if row.doc_id is None:
            assert row.component_id is None
        else:
            assert row.fingerprint == f"{want[row.doc_id]:016x}"
            assert row.component_id == groups[row.doc_id]


def test_dedupe_keeps_one_row_of_each_group(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    kept = simhash.dedupe(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    # 1 and 2 are copies; 3, 4, 5 and a row without id have no words
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 8] and ids.count(None) == 1


def plainly_kept(rows):
    """(doc_id, text) of the row that each group keeps, by brute force; rows whose
    ids and texts are equal count once, and no two texts of a group share an id."""
    prints = {t: plain_fingerprint(t) for _, t, *_ in rows}
    groups = plain_components(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 4)
    best = {}
    for doc_id, text, *_ in rows:
        key = groups[prints[text]]
        rank = (doc_id is None, doc_id or 0)
        if key not in best or rank < best[key][0]:
            best[key] = (rank, doc_id, text)
    return sorted(((d, t) for _, d, t in best.values()), key=repr)


def test_dedupe_loses_no_text_where_ids_repeat(make_docs):
    x, y = "one text of its own kind " * 9, "quite another matter altogether " * 9
    rows = [(3, y), (7, y), (7, x), (9, x)]
    got = sorted(((r.doc_id, r.text) for r in simhash.dedupe(make_docs(rows)).collect()), key=repr)
    assert got == [(3, y), (7, x)] == plainly_kept(rows)


def test_dedupe_against_brute_force(make_docs):
    r = random.Random(2)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 5) for _ in range(200)) for _ in range(10)]
    texts += [t.replace(" a ", " zz ", 1) for t in texts]
    ids = [None, *range(8)]
    rows = [(r.choice(ids), r.choice(texts)) for _ in range(150)]
    rows = [row for row in rows if row[0] is not None or row[1] in texts[:3]]
    groups = {}
    rows = [row for row in rows if groups.setdefault((row[0], row[1][:40]), row[1]) == row[1]]
    got = simhash.dedupe(make_docs(rows + rows))
    assert sorted(((x.doc_id, x.text) for x in got.collect()), key=repr) == plainly_kept(rows)


@pytest.mark.parametrize("crowded", [3, 20])
def test_crowded_buckets_are_parted_and_lose_no_link(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(3)]
    fps = [b ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 8))) for b in base for _ in range(60)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {x.fp: x.root for x in simhash.near_groups(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = plain_components(sorted(set(signed)), lambda a, b: ((a ^ b) % 2**64).bit_count() <= 4)
    assert got == want
    nodes = spark.createDataFrame([(f,) for f in set(signed)], "fp long")
    parts = simhash.buckets(nodes, 6)
    assert len(parts) > 2 and parts[-1][0] > 14


def test_empty_table(spark, make_docs):
    assert simhash.simhash_groups(make_docs([])).count() == 0
    assert simhash.dedupe(make_docs([])).count() == 0


def test_components_of_long_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    links = spark.createDataFrame(chain + hub + [(5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}
    assert connected_components(links.where("false")).count() == 0
