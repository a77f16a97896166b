import random

from strandloom.llm import plans, splitting, tokens
from strandloom.session import table


def greedy(text, most, overlap):
    """The cuts one after another, from the boundary table of the text."""
    import numpy as np

    bpe = tokens.encoder(tokens.vocabulary_path())
    ids = bpe.encode_ordinary(text or "")
    if len(ids) <= most:
        return None
    got = splitting._successors(text, np.array([len(bpe.decode_single_token_bytes(i)) for i in ids]), most, overlap)
    at = {int(p): (int(s), int(n)) for p, s, n in zip(got["pos"], got["start"], got["next"])}
    out, pos = [], 0
    while pos < len(ids):
        start, to = at[pos]
        out.append((start, to, b"".join(map(bpe.decode_single_token_bytes, ids[start:to])).decode()))
        pos = to
    return out


def run(spark, docs, most, overlap):
    df = spark.createDataFrame(docs, "doc_id long, text string, pos string")
    out = {}
    for r in splitting.split_texts(df, "doc_id", "text", most, overlap).collect():
        out.setdefault(r["doc_id"], []).append((r["piece_no"], r["start_token"], r["end_token"], r["text"]))
    return {k: [x[1:] for x in sorted(v)] for k, v in out.items()}


def samples():
    rng = random.Random(4)
    parts = ["word ", "two words. ", "\n", "\n\n", "\\section{A}\n", "東京都。", "x" * 90, "é", "👩‍👩‍👧", "  ", "\r\n", "12.5 "]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(400))) for _ in range(60)] + [None, "", "short", "z" * 5000, "字" * 900, "\n" * 700, "👩‍👩‍👧" * 300]


def test_cuts_are_the_greedy_ones_and_no_text_is_lost(spark):
    texts = samples()
    got = run(spark, [(i, t, "x") for i, t in enumerate(texts)], 60, 8)
    bpe = tokens.encoder(tokens.vocabulary_path())
    for i, t in enumerate(texts):
        want = greedy(t, 60, 8)
        if want is None:
            assert got[i] == [(0, None, t)]
            continue
        assert got[i] == want
        ids = bpe.encode_ordinary(t)
        whole, done = want[0][2], want[0][1]
        for (s0, e0, _), (s, e, text) in zip(want, want[1:]):
            assert 8 - 4 <= e0 - s <= 8 and s > s0 and e > e0 and e - s <= 60
            kept = len(b"".join(map(bpe.decode_single_token_bytes, ids[s:done])).decode())
            whole, done = whole + text[kept:], e
        assert whole == t and done == len(ids)


def test_pieces_of_the_table_stay_under_the_limit_when_encoded_again(spark):
    sf = "/root/testdata/sf0.01"
    bpe = tokens.encoder(tokens.vocabulary_path())
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    long = {d for d, t in texts.items() if len(bpe.encode_ordinary(t or "")) > 2048}
    pieces = plans.p8_pieces(spark, sf).collect()
    assert {r["doc_id"] for r in pieces} == set(texts)
    assert {r["doc_id"] for r in pieces if r["piece_no"] == 1} == long == {r["doc_id"] for r in plans.p8_found(spark, sf).collect()}
    assert max(len(bpe.encode_ordinary(r["text"] or "")) for r in pieces) <= 2048


def test_prefers_better_boundaries(spark):
    text = "one two three. four five.\n" * 10 + "\n\\section{B} " + "six seven. " * 30
    got = run(spark, [(1, text, "")], 100, 4)[1]
    assert got[0][2].endswith("\n\n") and got[1][2].endswith(". six seven.") is False
    assert "\\section{B}" in got[1][2]


def test_null_and_repeated_rows_and_empty_table(spark):
    t = "alpha beta. " * 60
    got = run(spark, [(None, t, ""), (1, None, ""), (2, t, ""), (2, t, "")], 60, 8)
    assert got[1] == [(0, None, None)] and len(got[2]) == 2 * len(got[None])
    assert run(spark, [], 60, 8) == {}


def test_long_stretches_without_a_break_have_every_cut_in_their_table():
    for text, most, overlap in [("👩‍👩‍👧" * 4000, 600, 64), ("字" * 9000 + " x " + "z" * 30_000, 2048, 128), ("a" + "é😀" * 8000, 300, 5)]:
        cuts = greedy(text, most, overlap)
        assert len(cuts) > 5 and all(n - s <= most for s, n, _ in cuts)
        assert all(overlap - 3 <= n - s <= overlap for (_, n, _), (s, _, _) in zip(cuts, cuts[1:]))
