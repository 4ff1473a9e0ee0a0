"""Words merged many at a time have the ids that the library gives."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer as Library

from recollect.llm import byte_bpe, merges, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def spec():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


def test_words(spec):
    pick = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyzeeeetttaaaßäöüéèñçøīĀŁ".replace("Ł", "")
    words = list({"".join(pick.choices(letters, k=pick.randint(1, 45))) for _ in range(4000)} | {"a", "aaaa", "abababab", "the", "The", "THE", "ß"})
    tok, library = packing.Tokenizer(spec), Library.from_str(spec)
    assert tok.merges.usable
    want = [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
    ids, at = tok.encode_block(pa.array(words, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want


def test_odd_texts_with_a_small_memo(spec):
    texts = ["", " ", "\n\t\x0b\x0c\r", "don't we'll", "a b c\x1cd\x85e", "J̌ H̱ İ K", "ΣΑΣ İstanbul ﬁn", "x<|endoftext|>y <|startoftext|>", "12 3.5%, a1b2!?;:", "Ünïcode. Ünïcode, ünïcode", "été ́", "日本語 텍스트 😀😀", "q" * 300, "same same Same SAME.", "\0 a\0b"]
    library = Library.from_str(spec)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for memo in (3, 1000):
        tok = packing.Tokenizer(spec, memo)
        for _ in range(2):
            ids, at = tok.encode_block(pa.array(texts, pa.string()))
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
    col = pa.array(["skipped", *texts, "skipped"], pa.string()).slice(1, len(texts))
    ids, at = packing.Tokenizer(spec).encode_block(col)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want


def test_empty_block(spec):
    ids, at = packing.Tokenizer(spec).encode_block(pa.array([], pa.string()))
    assert len(ids) == 0 and at.tolist() == [0]


def test_ranked_words_are_those_of_the_plain_merge():
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    table = merges.Merges.of_ranks(ranks)
    rng = np.random.default_rng(3)
    words = {bytes(rng.choice(list(b" aaabcdeehinorst"), rng.integers(2, 30)).tolist()) for _ in range(3000)} | {"élève".encode(), "中文字".encode(), b"aaaaaaaaaaa", bytes(range(200, 230))}
    words = [w for w in words if w not in ranks]
    order, lengths, ids = table.encode(words)
    cuts = np.append(0, np.cumsum(lengths))
    for k, i in enumerate(order):
        assert ids[cuts[k] : cuts[k + 1]].tolist() == byte_bpe.merge(words[i], ranks)


def test_blocks_split_as_the_pattern_does_on_whole_texts():
    find = byte_bpe.compile_pattern(public_tokenizers.PATTERN).findall
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    rng = np.random.default_rng(4)
    parts = ["word", "Word.", "naïve,", "don't", "x's", "12", "a1b", "...", "ªº", "ⅷ", "中文", "", " ", *spaces]
    texts = ["", " ", "one", "two words"] + ["".join(rng.choice([*parts, " ", " "], rng.integers(1, 12))) for _ in range(4000)]
    splitter = byte_bpe.Splitter(public_tokenizers.PATTERN)
    for _ in range(2):  # the second time from the memo
        chunks, offs = splitter.block(pa.array(texts))
        words, ends = splitter.words_of(chunks)
        cut = np.append(0, ends)[offs]
        for t, a, b in zip(texts, cut, cut[1:]):
            assert [splitter.names[k] for k in words[a:b]] == find(t)


def test_the_memo_starts_anew_when_it_is_full(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_BYTES", 1)
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoder = byte_bpe.Encoder(ranks, byte_bpe.Splitter(public_tokenizers.PATTERN), {})
    texts = ["some words here", "other words there, " * 50, "x" * 3000]
    one = [list(encoder.encode(pa.array([t]))) for t in texts]
    assert [spelt.decode() for ((_, _, spelt),) in one] == texts and encoder.splitter.epoch == 3
