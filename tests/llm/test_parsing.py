import hashlib
import random

import numpy as np
import pytest

from pitflow.llm import parsing


def plain_rows(rows):
    """(doc_id, n_chars, sha of the edited text, text, edited text) by brute force."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    texts = [r[1] or "" for r in order]
    out = []
    for (doc_id, *_), text, following in zip(order, texts, texts[1:] + texts[:1]):
        n = len(text) // 4
        altered = text[: len(text) - n] + following[:n]
        out.append((doc_id, len(text), hashlib.sha256(altered.encode()).hexdigest(), text, altered, following))
    return out


@pytest.mark.parametrize("block_bytes", [8 << 20, 400])
def test_rows_against_brute_force(spark, make_docs, odd_rows, monkeypatch, block_bytes):
    monkeypatch.setattr(parsing, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(parsing, "MOST_BLOCKS", 50)
    r = random.Random(2)
    rows = odd_rows + [(1000 + 3 * i, "".join(r.choices("abcde fé日", k=r.randint(0, 90)))) for i in range(150)]
    got = parsing.fingerprint_documents(make_docs(rows)).collect()
    want = plain_rows(rows)
    assert len(got) == len(want)
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    for row, (doc_id, n_chars, sha, text, altered, following) in zip(
        sorted(got, key=lambda x: key((x.doc_id, x.n_chars, x.edited_sha256))), sorted(want, key=key)
    ):
        assert (row.doc_id, row.n_chars, row.edited_sha256) == (doc_id, n_chars, sha)
        prints = parsing.fingerprints([text, altered, following])
        assert [row.fingerprint, row.edited_fingerprint] == prints[:2]
        assert row.near_edited == parsing.likeness(*prints[:2])
        assert row.near_next == parsing.likeness(prints[0], prints[2])


def test_empty_table_and_rows_without_ids(spark, make_docs):
    assert parsing.fingerprint_documents(make_docs([])).count() == 0
    rows = [(None, "b b b b"), (None, "a a a a"), (None, None)]
    got = parsing.fingerprint_documents(make_docs(rows)).collect()
    assert sorted(r.edited_sha256 for r in got) == sorted(w[2] for w in plain_rows(rows))


def phrases(text, levels):
    names = parsing.mixed(parsing.code_points(text).astype(np.uint64) + np.uint64(1))
    first = np.array([0])
    for _ in range(levels):
        names, first = parsing.parsed(names, first)
    return names


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_equal_substrings_share_their_inside(levels):
    r = random.Random(levels)
    middle = "".join(r.choices("abcdefgh ", k=3000))
    a = phrases("".join(r.choices("abcdefgh ", k=777)) + middle, levels)
    b = phrases(middle + "".join(r.choices("abcdefgh ", k=500)), levels)
    alone = phrases(middle, levels)
    edge = 8 * levels
    inside = alone[edge:-edge]
    as_bytes = inside.tobytes()
    assert len(inside) > 20 and as_bytes in a.tobytes() and as_bytes in b.tobytes()


def test_phrases_are_short_and_neighbours_differ():
    text = "".join(random.Random(1).choices("ab", k=4000)) + "c" * 500 + "xyz" * 200
    names = parsing.mixed(parsing.code_points(text).astype(np.uint64) + np.uint64(1))
    level, _ = parsing.parsed(names, np.array([0]))
    assert len(level) < len(text) / 2


def test_fingerprints_do_not_depend_on_the_batch():
    r = random.Random(4)
    texts = ["".join(r.choices("abc de", k=k)) for k in (0, 1, 2, 3, 10, 500, 5000)] * 2
    assert parsing.fingerprints(texts) == [parsing.fingerprints([t])[0] for t in texts]


def test_likeness_follows_shared_text():
    r = random.Random(6)
    a, b = ("".join(r.choices("abcdefghij ", k=4000)) for _ in range(2))
    half = a[:2000] + b[2000:]
    x, y, z = parsing.fingerprints([a, b, half])
    assert parsing.likeness(x, x) == 1 and parsing.likeness(x, y) < 0.05
    assert 0.2 < parsing.likeness(x, z) < 0.5  # a third of the phrases of both
    assert parsing.likeness("", "") == 1 and parsing.likeness("", x) == 0


def true_share(a, b):
    """Share of common phrases over all of them, the mean over the levels."""
    shares = []
    for level in parsing.SAMPLED:
        x, y = (set(phrases(t, level).tolist()) for t in (a, b))
        shares.append(len(x & y) / len(x | y))
    return sum(shares) / len(shares)


@pytest.mark.parametrize("words, most", [(300, 0.2), (3000, 0.08), (20_000, 0.03)])
def test_error_of_the_estimate_falls_with_the_length(words, most):
    r = random.Random(words)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(5000)]
    errors = []
    for share in (0.2, 0.5, 0.75, 0.9):
        a = " ".join(r.choices(vocabulary, k=words))
        b = a[: int(len(a) * share)] + " ".join(r.choices(vocabulary, k=int(words * (1 - share))))
        errors.append(parsing.likeness(*parsing.fingerprints([a, b])) - true_share(a, b))
    assert max(map(abs, errors)) < most


def test_a_passage_shared_by_long_texts_shows():
    """A passage of 1,000 words among 20,000 others each."""
    r = random.Random(8)
    text = lambda n: " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(n))
    passage = text(1000)
    a, b = (f"{text(10_000)} {passage} {text(10_000)}" for _ in range(2))
    shared = parsing.likeness(*parsing.fingerprints([a, b]))
    apart = parsing.likeness(*parsing.fingerprints([text(20_000), text(20_000)]))
    assert shared > apart + 0.005
