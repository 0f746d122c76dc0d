import random

import public_tokenizers
import pytest
import tiktoken

from assayer.llm.byte_bpe import Decoder, Encoder, MergeTransducer, Utf8Stream, decode, encode, read_ranks

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken")]
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module", params=PATHS)
def ranks(request):
    return read_ranks(request.param)


def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(seed, n=400):
    random.seed(seed)
    letters = "aabcdeé ñthen<>\n日本😀 \t1ín'"
    made = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(n)]
    return [*made, "", " ", "a" * 3000, " " * 2000, "é" * 1500, "".join(map(chr, range(1, 400))), "<|endoftext|>", "unbelievably internationalization"]


def test_encoding_is_the_librarys(ranks):
    own, lib = Encoder(ranks, PATTERN), library(ranks)
    for text in texts(1):
        assert own.encode(text) == lib.encode_ordinary(text)


def test_encoding_with_hardly_any_pairs_kept(ranks):
    lib, own = library(ranks), Encoder(ranks, PATTERN)
    own.transducer = MergeTransducer(ranks, pairs_kept=3)
    for text in texts(2, 100):
        assert own.encode(text) == lib.encode_ordinary(text)


def test_round_trip(ranks):
    own, back = Encoder(ranks, PATTERN), Decoder(ranks)
    for text in texts(3):
        assert back.decode(own.encode(text)) == text


def test_stream_is_the_codec_of_the_standard_library():
    random.seed(4)
    for _ in range(2000):
        data = bytes(random.choice([0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xE2, 0xED, 0xF0, 0xF4, 0xFF, 0x9F, 0xA0]) for _ in range(random.randint(0, 8)))
        stream = Utf8Stream()
        assert "".join(stream.feed(data[i : i + 1]) for i in range(len(data))) + stream.end() == data.decode("utf-8", "replace")


def test_query_rows(docs):
    rows = [(1, None), (2, ""), (None, "Hello wörld"), (3, "x" * 40_000), (3, "x" * 40_000)]
    got = decode(encode(docs(rows), PATHS[0], PATTERN), PATHS[0]).collect()
    lib = library(read_ranks(PATHS[0]))
    assert sorted(((r.doc_id, r.ids, r.text) for r in got), key=str) == sorted(((i, lib.encode_ordinary(t or ""), t or "") for i, t in rows), key=str)
    assert encode(docs([]), PATHS[0], PATTERN).collect() == []


def test_one_pass_gives_the_same(docs):
    from assayer.llm.byte_bpe import decode, encode, encode_and_decode

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    frame = docs([(1, "Hello wörld 日本 😀"), (2, None), (2, ""), (None, "a" * 300), (4, "x\u0000y\r\n")])
    key = lambda r: (r.doc_id or 0, r.text)
    assert sorted(encode_and_decode(frame, path, pattern).collect(), key=key) == sorted(decode(encode(frame, path, pattern), path).collect(), key=key)
