import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assayer.llm.token_counts import WordEncoder, count_in_chunks, count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def own():
    return WordEncoder(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(seed, n):
    random.seed(seed)
    letters = "aabcdeé ñthen<>\n日本😀 \t1ín'́  LV"
    made = ["".join(random.choice(letters) for _ in range(random.randint(0, 200))) for _ in range(n)]
    return [*made, "", " ", "I'LL don't <|endoftext|>x<|startoftext|> 12a3", "a" * 700, "日本" * 300, "a1" * 300]


def test_counts_are_the_librarys(own, library):
    some = texts(1, 300)
    assert own.count_all(some) == [len(library.encode(t, add_special_tokens=False)) for t in some]


@pytest.mark.parametrize(("chunk", "overlap"), [(20, 4), (50, 8), (333, 64), (40, 39)])
def test_chunks_give_the_same(own, library, chunk, overlap):
    for text in texts(2, 60):
        assert count_in_chunks(text, own.tokens, chunk, overlap) == len(library.encode(text, add_special_tokens=False)), text


def test_overlaps_widen_where_nothing_is_proven(own):
    spans = []

    def tokens(text):
        spans.append(len(text))
        return own.tokens(text)

    text = "word " * 30 + "x" * 300 + " word" * 30
    assert count_in_chunks(text, tokens, 200, 8) == own.count_all([text])[0]
    assert max(spans) > 208


def test_rows(docs, library):
    long = "some words of a text 12 " * 4000
    rows = [(1, None), (2, ""), (None, "Hello wörld"), (3, long), (3, long)]
    got = count_tokens(docs(rows), PATH).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in rows]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert count_tokens(docs([]), PATH).collect() == []


def test_what_is_remembered_stays_bounded(own, library, monkeypatch):
    import assayer.llm.token_counts as module

    monkeypatch.setattr(module, "OFFSETS_KEPT", 5)
    for text in texts(4, 40):
        assert count_in_chunks(text, own.tokens, 30, 8) == len(library.encode(text, add_special_tokens=False)), text


def test_words_that_come_again_are_kept(library, monkeypatch):
    import assayer.llm.token_counts as module

    class Counting:
        asked = 0

        def encode_batch_fast(self, words, **options):
            self.asked += len(words)
            return library.encode_batch_fast(words, **options)

    monkeypatch.setattr(module, "WORDS_KEPT", 50)
    encoder = WordEncoder(PATH)
    encoder.library = Counting()
    common = " ".join(f"often{i}" for i in range(20))
    for k in range(30):
        text = common + "".join(f" once{k}x{i}" for i in range(20))
        assert encoder.count_all([text]) == [len(library.encode(text, add_special_tokens=False))]
        assert len(encoder.counts) <= 50 + 40 and len(encoder.earlier) <= 50 + 40
    assert encoder.library.asked == 20 + 30 * 20
