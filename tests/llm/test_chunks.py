"""Cut and remembered parts against whole texts, with clashing hashes and a tiny memory."""

import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from scorelake.llm import byte_bpe, chunks, token_files

WORDS = ["foo", "bar.", "it's", "", "\n", "é", "日本", "a\nb", "<|endoftext|>", "x" * 70, "12", "don't", " z", "Ünï,", "...", " ", "ab&&&", "Mot;", " ", "q "]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def same(encoder, tokenizer, texts):
    for text, raw in zip(texts, encoder([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_parts_equal_whole_texts(tokenizer):
    encoder, r = token_files._encoder(P.path("byte_bpe_50k.json")), random.Random(1)
    for _ in range(60):
        part = lambda: r.choice([" ", " ", "", "\n"]) + r.choice(WORDS) + (str(r.randint(0, 50)) if r.random() < 0.3 else "")
        same(encoder, tokenizer, ["".join(part() for _ in range(r.randint(0, 40))) for _ in range(r.randint(1, 20))])


def test_clashing_hashes_and_little_memory(tokenizer, monkeypatch):
    whole = token_files._encoder(P.path("byte_bpe_50k.json"))._encode
    hashes = chunks._hashes
    monkeypatch.setattr(chunks, "_hashes", lambda *a: hashes(*a) % np.uint64(11))
    monkeypatch.setattr(chunks, "AT_ONCE", 300)
    r = random.Random(2)
    for bound in (3, 7, 1_000):
        encoder = chunks.ChunkEncoder(whole, remembered=bound)
        for _ in range(20):
            same(encoder, tokenizer, [" ".join(r.choice(["foo", "bar.", "é", "日本", "a\nb", "12", "qq", "zz", "tt", "uu"]) for _ in range(r.randint(0, 60))) for _ in range(r.randint(1, 20))])


def thue_morse(n):
    """Two texts whose polynomial hashes modulo a power of two agree for every base."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_texts_with_equal_polynomial_hashes(tokenizer, n):
    texts = [*thue_morse(n), " " + thue_morse(n)[1], " " + thue_morse(n)[0]]
    a, b = (np.frombuffer(t.encode(), np.uint8) for t in texts[:2])
    hashes = chunks._hashes(np.concatenate([a, b]), np.array([0, n]), np.array([n, 2 * n]))
    assert n < 2048 or hashes[0] == hashes[1]
    same(token_files._encoder(P.path("byte_bpe_50k.json")), tokenizer, texts)
    bpe, encoder = byte_bpe.coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    found = encoder([t.encode() for t in texts])
    assert [bpe.decode(x).decode() for x in found] == texts
    same(encoder, tokenizer, texts)


def test_short_parts_with_equal_hashes(tokenizer, monkeypatch):
    monkeypatch.setattr(chunks, "_hashes", lambda buf, starts, ends: np.zeros(len(starts), np.uint64))
    encoder = chunks.ChunkEncoder(token_files._encoder(P.path("byte_bpe_50k.json"))._encode, remembered=50)
    for _ in range(3):
        same(encoder, tokenizer, ["foo bar", "bar foo", "qq foo bar zz", " foo", ""])


def test_another_pattern_cuts_no_texts():
    import regex

    bpe, encoder = byte_bpe.coder(P.path("byte_bpe_50k.tiktoken"), r"..?.?|\n", remembered=100)
    text = "one two three, four"
    want = b"".join(np.array(bpe.merge(x.encode()), "<u4").tobytes() for x in regex.findall(r"..?.?|\n", text))
    assert encoder([text.encode()]) == [want]


def test_pieces_by_pattern_equal_the_library(tokenizer):
    r, encoder = random.Random(5), token_files._encoder(P.path("byte_bpe_50k.json"))
    letters = "ab'sStTdDmMlLvVrReE019.,;!-_$%()[]{}<|>\n\t\r\x0b\x0c\x1c\x1d\x85\xa0 éßÀ²¼ªµ×÷ƀɏ"
    for _ in range(400):
        same(encoder, tokenizer, ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(10)])
    same(encoder, tokenizer, [t for n in range(1, 5) for t in ("".join(r.choice("'sdmtlvreX ") for _ in range(n)) for _ in range(200))])
