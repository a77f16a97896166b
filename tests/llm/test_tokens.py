import itertools
import random

import pytest

from strandloom.llm import tokens

TEXTS = [
    None, "", " ", "\n\n\n x", "The cat's  tail\r\n\tisn't 12,345.67 long…", "naïve ﬁne 東京都は大きい。", "a" * 3000, "👩‍👩‍👧 x", "\x1c\x1d a\x85b\u2028c\u00a0 d", "don't   stop  ", "the the the the",
    "<|endoftext|> is ordinary", "\\section{A}\n\n\\begin{equation} x_{1}^2 \\end{equation}\n" * 30,
]


def test_ids_equal_the_library(spark, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK_CHARS", 500)
    rng = random.Random(2)
    alphabet = "ab é東\n\t \u3000'1²Ⅷ.\\{_\u0301\U0001d400"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, chunk int").repartition(4)
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(df, "doc_id", "text").collect()}
    bpe = tokens.encoder(tokens.vocabulary_path())
    assert got == {i: bpe.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_decoding_gives_the_texts_back(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in tokens.decode_corpus(tokens.encode_corpus(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert got == {i: t or "" for i, t in enumerate(TEXTS)}


def test_null_and_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in tokens.encode_corpus(df, "doc_id", "text").collect()) == [(0, [64, 275]), (1, [64]), (1, [64])]
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").collect() == []


@pytest.mark.parametrize("step", [997])
def test_pre_tokens_agree_with_the_library_over_unicode(step):
    bpe = tokens.encoder(tokens.vocabulary_path())
    for cp in [*range(0x3000), *range(0x3000, 0x110000, step)]:
        if not 0xD800 <= cp < 0xE000:
            ch = chr(cp)
            text = f"a{ch}b  {ch} 1{ch}\n{ch} {ch}"
            assert [i for w in tokens.pre_tokens(text) for i in bpe.encode_ordinary(w)] == bpe.encode_ordinary(text)


def test_more_distinct_words_than_two_bytes_can_number(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(w) for w in itertools.islice(itertools.product(letters, repeat=4), 70_000)]
    texts = ["before " * 3, " ".join(words), " ".join(reversed(words[:300])) + " after"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(df, "doc_id", "text").collect()}
    bpe = tokens.encoder(tokens.vocabulary_path())
    assert got == {i: bpe.encode_ordinary(t) for i, t in enumerate(texts)}


def test_decoding_null_and_empty_lists(spark):
    rows = [(1, None), (2, []), (3, [64, 275]), (None, [64]), (3, [275] * 30_000), (4, [64] * 12_000), (5, []), (6, None), (7, [60_000, 64])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    want = [(1, None), (2, ""), (3, "a b"), (None, "a"), (3, " b" * 30_000), (4, "a" * 12_000), (5, ""), (6, None), (7, "a")]
    for parts in (1, 4):
        got = [tuple(r) for r in tokens.decode_corpus(df.coalesce(1).repartition(parts), "doc_id", "ids").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
