"""BPE and token counts against the tokenizer libraries."""

import random
from collections import Counter

import public_tokenizers
from noticelake.llm import bpe, token_count

SPECIAL = "<|endoftext|>"
EDGES = [(1, None), (2, ""), (None, "a null id"), (3, "again"), (3, "again"), (4, "x" * 3000), (5, " \n\t  \r\n \u00a0\u3000 "), (6, "don't we'll it's I'd you're I've I'm 123 ½ Ⅷ 漢字🙂 \u200b"), (7, SPECIAL + "a " + SPECIAL), (8, "q r " * 800)]


def texts(seed, n):
    rng = random.Random(seed)
    parts = ["hello ", "world", "'s", "!!", "<|", "|>", SPECIAL, "<|endof", "  ", "\n", " \n ", "ßéñ ", "漢字", "🙂", "a" * 40, "12345 "]
    return [(100 + i, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(n)]


def test_encode_and_decode_equal_the_library(documents):
    rows = EDGES + texts(1, 150)
    codec = bpe.codec(public_tokenizers.path(bpe.RANKS))
    want = Counter((i, tuple(codec.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    for block in (64, 1 << 20):
        got = Counter((r.doc_id, tuple(r.token_ids), bytes(r.decoded)) for r in bpe.encode_documents(documents(rows), block_bytes=block).collect())
        assert got == want


def letters_of_every_version():
    """Each letter, mark and number that the newest table here knows, before an apostrophe and after a blank."""
    import regex

    found = regex.findall(r"[\p{L}\p{N}\p{M}]", "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000))
    return [(k, "".join(f"a{c}'s x {c}" for c in found[at : at + 400])) for k, at in enumerate(range(0, len(found), 400))]


def test_newer_letters_are_cut_as_the_libraries_cut_them(documents):
    rows = [*letters_of_every_version(), (-1, "plain"), (-2, None), (-3, "\U0001df00's " + SPECIAL + "\U0001df00's")]
    codec, tokenizer = bpe.codec(public_tokenizers.path(bpe.RANKS)), token_count.tokenizer(public_tokenizers.path(token_count.VOCABULARY))
    coded = {r.doc_id: (list(r.token_ids), bytes(r.decoded).decode()) for r in bpe.encode_documents(documents(rows)).collect()}
    assert coded == {i: (codec.encode_ordinary(t or ""), t or "") for i, t in rows}
    for chunk, overlap in ((65_536, 512), (300, 40)):
        counts = {r.doc_id: r.n_tokens for r in token_count.count_tokens(documents(rows), chunk_chars=chunk, overlap_chars=overlap).collect()}
        assert counts == {i: len(tokenizer.encode(t or "", add_special_tokens=False)) for i, t in rows}


def test_encode_empty_table(documents):
    assert bpe.encode_documents(documents([])).collect() == []


def test_decode_joins_the_token_table(spark):
    codec = bpe.codec(public_tokenizers.path(bpe.RANKS))
    words = spark.createDataFrame([(1, [0], "kept", 2)], "k long, token_ids array<int>, _out string, _pos int")
    assert bpe.decode_ids(words, bpe.token_table(spark)).select("_out", "_pos").first() == ("kept", 2)
    rows = [(1, codec.encode_ordinary("héllo wörld, 漢字")), (2, []), (3, None), (4, [10**6]), (1, codec.encode_ordinary("héllo wörld, 漢字"))]
    frame = spark.createDataFrame(rows, "k long, token_ids array<int>")
    got = Counter((r.k, None if r.decoded is None else bytes(r.decoded).decode()) for r in bpe.decode_ids(frame, bpe.token_table(spark)).collect())
    assert got == Counter({(1, "héllo wörld, 漢字"): 2, (2, ""): 1, (3, None): 1, (4, None): 1})


def test_counts_equal_the_library_however_chunks_are_cut(documents):
    rows = EDGES + texts(2, 150)
    tokenizer = token_count.tokenizer(public_tokenizers.path(token_count.VOCABULARY))
    want = Counter((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for i, t in rows)
    for chunk, overlap in ((65_536, 512), (100, 16)):
        found = token_count.count_tokens(documents(rows), chunk_chars=chunk, overlap_chars=overlap).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in found) == want


def test_limits_of_an_empty_table(documents):
    assert token_count.token_limits(documents([])).collect() == []
