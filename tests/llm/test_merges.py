import hashlib
import sys

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from pitflow.llm import merges, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return merges.read_ranks(merges.RANKS)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def unpack(ids: bytes) -> list[int]:
    return np.frombuffer(ids, dtype="<u4").tolist()


def one_by_one(word: bytes, ranks) -> list[int]:
    """The lowest rank first, the leftmost of equal ones, in one word."""
    parts = [bytes([b]) for b in word]
    while True:
        made = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not made:
            return [ranks[p] for p in parts]
        _, i = min(made)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def small_ranks(tokens):
    return {**{bytes([b]): b for b in range(256)}, **{t: 256 + i for i, t in enumerate(tokens)}}


@pytest.mark.parametrize("bulk", [1, 24, 10**9])
@pytest.mark.parametrize("seed", range(20))
def test_replay_equals_single_words_under_any_ranks(monkeypatch, seed, bulk):
    """Ranks in no order of their parts, so that merges make pairs of lower rank."""
    monkeypatch.setattr(merges, "BULK", bulk)
    rng = np.random.default_rng(seed)
    texts = {bytes(rng.choice([97, 98, 99], size=rng.integers(2, 5)).tolist()) for _ in range(25)}
    ranks = small_ranks(rng.permutation(sorted(texts)).tolist())
    words = [bytes(rng.choice([97, 98, 99], size=rng.integers(1, 14)).tolist()) for _ in range(300)]
    assert [unpack(i) for i in merges.replay(words, ranks)] == [one_by_one(w, ranks) for w in words]


def test_words_that_were_forgotten_are_learned_again(monkeypatch, ranks, library):
    split = merges.Splitter(public_tokenizers.PATTERN, merges.unknown_characters())
    words = merges.Vocabulary(ranks, split, 100)
    texts = [f"word{i} and others, {i} {chr(split.unknown[0])}x" for i in range(50)]
    want = [library.encode_ordinary(t) for t in texts]
    assert [unpack(i) for i in words.encode(texts)] == want
    monkeypatch.setattr(merges, "REMEMBERED_BYTES", 0)
    assert [unpack(i) for t in texts for i in words.encode([t])] == want
    assert len(words.ids) < 20


def test_pairs_that_make_the_same_token_go_from_left_to_right():
    ranks = small_ranks([b"ab", b"ba", b"aba"])
    word = b"abaaba" * 3
    assert unpack(merges.replay([word], ranks)[0]) == one_by_one(word, ranks)


def test_replay_of_long_words(ranks, library):
    words = [b"a" * 100_000, b"ab" * 50_000, b" " * 50_001, b"x"]
    for word, ids in zip(words, merges.replay(words, ranks)):
        assert b"".join(merges.tokens_by_id(merges.RANKS)[i] for i in unpack(ids)) == word
    for word in (b"a" * 3000, b"ab" * 1500):
        assert unpack(merges.replay([word], ranks)[0]) == library.encode_ordinary(word.decode())


def test_query_equals_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.op12_merges(spark, SF).collect()
    assert len(found) == len(texts)
    for row in found:
        ids = library.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_classes_of_characters_equal_the_library():
    """Whether a character continues letters, digits, signs or white space."""
    split = merges.Splitter(public_tokenizers.PATTERN, merges.unknown_characters())
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    firsts = sorted({chr(c).encode()[:1] for c in points})
    for lead in "a1! ":
        probe = small_ranks([lead.encode() + b for b in firsts])
        encode = tiktoken.Encoding(
            "probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=probe, special_tokens={}
        ).encode_ordinary
        for c in points[::3] if lead in "a1" else points[::97]:
            text = lead + chr(c)
            joined = len(encode(text)) < len(text.encode())
            assert joined == (len(split.words_around_unknown(text)[0]) > 1), hex(c)


def test_texts_with_characters_newer_than_the_library(library):
    unknown = merges.unknown_characters()
    split = merges.Splitter(public_tokenizers.PATTERN, unknown)
    assert split.known(["abc", "é"]) and not split.known(["a", chr(unknown[0])])
    text = f"ab{chr(unknown[0])}c {chr(unknown[-1])}1 x"
    ranks = merges.read_ranks(merges.RANKS)
    words = [w.encode() for w in split.words_around_unknown(text)]
    assert [i for ids in merges.replay(words, ranks) for i in unpack(ids)] == library.encode_ordinary(text)


def test_odd_rows_in_small_chunks_and_blocks(spark, make_docs, odd_rows, library):
    rows = [*odd_rows, (9, "<|endoftext|> I'll 'S don't\n\n  x \u0085　 \x1c1½²Ⅷ", None, None)]
    docs = make_docs(rows).repartition(3)
    encoded = merges.encode(docs, chunk_chars=50, block_bytes=40)
    found = encoded.select("doc_id", merges.unpacked(encoded.ids).alias("ids"), merges.decoded(encoded.ids).alias("back"))
    got = sorted((r.doc_id or -1, r.ids, bytes(r.back)) for r in found.collect())
    want = [(r[0] or -1, library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows]
    assert got == sorted(want)


def test_texts_without_words_and_no_texts(spark, make_docs):
    assert [(r.doc_id, bytes(r.ids)) for r in merges.encode(make_docs([(1, ""), (2, None)])).orderBy("doc_id").collect()] == [
        (1, b""),
        (2, b""),
    ]
    assert merges.encode(make_docs([])).count() == 0


def test_ids_of_another_type(spark):
    docs = spark.createDataFrame([("x", "two words"), (None, "w")], "doc_id string, text string")
    assert sorted(r.doc_id or "" for r in merges.encode(docs).collect()) == ["", "x"]
