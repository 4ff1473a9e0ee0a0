"""Pre-tokens cut in numpy have the ids that the library gives, and forms of a word share them."""

import json
import random

import public_tokenizers
import pyarrow as pa
import pytest

pytest.importorskip("recollect.llm")

from tokenizers import Tokenizer as Library  # noqa: E402

from recollect.llm import packing, pretokens  # noqa: E402

with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
    SPEC = f.read()


def _same(tok, texts, library):
    ids, at = tok.encode_block(pa.array(texts, pa.string()))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b, w in zip(texts, at, at[1:], want) if ids[a:b].tolist() != w] == []


def test_forms_of_a_word_are_learned_once():
    tok = packing.Tokenizer(SPEC)
    _same(tok, ["Word word, (WORD) “word” word-word Word's it's", "Été, ÉTÉ été! <word>"], Library.from_str(SPEC))
    assert set(tok.memo) == {"word", ",", "(", ")", "“word”", "-", "'s", "it", "été", "!", "<", ">"}


def test_random_texts():
    pick = random.Random(11)
    pools = ["'sStTrReEvVmMlLdD aA1!", "abXYéÉñÑßĀāİıµªº×÷«»¿¡²¼\xa0\x85\xad°'s ", " \t\n\x0b\x0c\r\x1c\x1f\0\x7f'ab,.1", "日本aÉ 'śeİΣςﬁ！😀'll", "<|>endoftxar b'é"]
    more = ["'s", "'re", "'LL", "'ve", "'D", "<|endoftext|>", "<|startoftext|>", "É́", "''", "’s", " "]
    texts = ["".join(pick.choice(more) if pick.random() < 0.1 else pick.choice(pool) for _ in range(pick.randint(0, 30))) for pool in pools for _ in range(500)]
    texts += [form % chr(i) for i in range(0x400) for form in ("%s", "a%sb'S", "'%se")]
    tok = packing.Tokenizer(SPEC)
    assert tok.fine
    _same(tok, texts, Library.from_str(SPEC))


def test_other_tokenizer_files_are_cut_at_white_space_only():
    other = json.loads(SPEC)
    other["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": "[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]+"}
    spec = json.dumps(other)
    assert pretokens.fits(SPEC) and not pretokens.fits(spec)
    _same(packing.Tokenizer(spec), ["b2b 123,45 it's Été", "a1 - x"], Library.from_str(spec))
