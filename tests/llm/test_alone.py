"""A text scores the same to the last bit alone, repeated and beside any other; scores are those of plain Python."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("recollect.llm")

from recollect.llm import language_id, quality_classifier, quality_rules, toxicity  # noqa: E402

WORDS = "the quick brown FOX jumps over a lazy dog. near, river banks -- while seven wise owls!! niño été größe a-b c3".split()
ODD = ["", " ", "a", "ab", "a.", "- x", "a b", "b c", "the quick fox", "...", "!", "é", "x" * 700, "NO NO no", "a a a", "\n", "1 2 2"]


def some_texts(n=150, seed=5):
    rng = np.random.default_rng(seed)
    return ODD + [" ".join(rng.choice(WORDS, rng.integers(1, 60))) for _ in range(n)]


TEXTS = some_texts()
Y = np.array([len(t) % 2 for t in TEXTS], float)


def classifier():
    codes = []
    for t in TEXTS:
        for _, _, data, offsets in quality_classifier.blocks.blocks(pa.array([t])):
            codes.append(quality_classifier.tokens(data, offsets)[0])
    return quality_classifier.fit(codes, Y, steps=20)


def scorers():
    one = classifier()
    yield "classifier", lambda col: quality_classifier.probabilities(col, one)
    two = quality_rules.fit(quality_rules.vectors(pa.array(TEXTS)), Y, steps=20)
    yield "rules", lambda col: quality_rules.probabilities(col, two)
    rng = np.random.default_rng(1)
    three = {"langs": ["a", "b", "c"], "logp": np.log(rng.random((language_id.SIZE, 3))) / 50, "prior": np.log([0.2, 0.3, 0.5])}
    yield "language", lambda col: language_id.predict_texts(col, three)[1]
    table = rng.normal(size=1 << toxicity.BITS).astype(np.float32)
    yield "toxicity", lambda col: toxicity.score_texts(col, table, -0.2, (0.1, 0.0))


@pytest.mark.parametrize("name, score", list(scorers()), ids=lambda x: x if isinstance(x, str) else "")
def test_a_text_scores_alike_in_any_company(name, score):
    alone = {t: float(score(pa.array([t]))[0]) for t in TEXTS}
    assert len(set(alone.values())) > 20
    rng = np.random.default_rng(2)
    for _ in range(30):
        batch = list(rng.choice(TEXTS, rng.integers(2, 90)))
        assert [float(x) for x in score(pa.array(batch))] == [alone[t] for t in batch]


def test_training_vectors_do_not_depend_on_company():
    whole = quality_rules.vectors(pa.array(TEXTS))
    for t, v in zip(TEXTS, whole):
        assert (quality_rules.vectors(pa.array([t]))[0] == v).all()
    both = toxicity.features(pa.array(TEXTS))
    assert all((toxicity.features(pa.array([t]))[0] == f).all() for t, f in zip(TEXTS, both))


M = 1 << 64
ODD_NUMBER = 0x9E3779B97F4A7C15


def mixed(h, salt=0):
    h = (h + salt * 0xD6E8FEB86659FD93) % M
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 % M
    h ^= h >> 29
    h = h * 0xBF58476D1CE4E5B9 % M
    return h ^ h >> 32


def hashed(word, salt=0):
    return mixed(sum((b + 1) * pow(ODD_NUMBER, i, M) for i, b in enumerate(word)) % M, salt)


def lowered(b):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


def test_classifier_scores_are_those_of_plain_python():
    model = classifier()
    v = quality_classifier.VOCAB

    def codes(text):
        out, before = [], None
        for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", text.encode()):
            w = m[0]
            if re.match(rb"[0-9A-Za-z\x80-\xff]", w):
                out.append(hashed(lowered(w), 11) % (v - 2) + 2)
                out += [quality_classifier.SAME] if lowered(w) == before else []
                out += [quality_classifier.CAPS] if re.fullmatch(rb"[A-Z]{2,}", w) else []
                before = lowered(w)
            else:
                out.append((w[0] * 3 + min(len(w), 3)) * 2654435761 % (v - 2) + 2)
        return out

    w1, b1, w2, b2 = model["net"]
    for t, p in zip(TEXTS, quality_classifier.probabilities(pa.array(TEXTS), model)):
        c = codes(t)
        mean = sum((model["table"][k].astype(float) for k in c), np.zeros(2 * quality_classifier.DIM)) / max(1, len(c))
        x = (mean - model["mean"]) / model["std"] * len(c) / (len(c) + quality_classifier.SHRINK)
        z = float(np.tanh(x @ w1 + b1) @ w2 + b2) / model["temperature"]
        assert abs(p - 1 / (1 + math.exp(-z))) < 1e-4, t


def test_toxicity_scores_are_those_of_plain_python():
    rng = np.random.default_rng(3)
    table = rng.normal(size=1 << toxicity.BITS).astype(np.float32)
    mask = (1 << toxicity.BITS) - 1

    def features(text):
        out = set()
        for w in re.findall(rb"[0-9a-z\x80-\xff]+", lowered(text.encode())):
            out.add(hashed(w, 1) & mask)
            out |= {hashed(w[:k], k) & mask for k in (4, 5)} if len(w) >= 4 else set()
        return out

    for t, p in zip(TEXTS, toxicity.score_texts(pa.array(TEXTS), table, -0.3, (0.2, 0.1))):
        z = 0.2 * (-0.3 + sum(float(table[k]) for k in features(t))) + 0.1
        assert abs(p - 1 / (1 + math.exp(-z))) < 1e-9, t


def test_rules_probabilities_are_those_of_plain_python():
    rng = np.random.default_rng(4)
    weights = rng.normal(size=quality_rules.DIM)
    size, bits = 1 << quality_rules.WORD_BITS, quality_rules.CHAR_BITS

    def trigram(a, b, c):
        h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % (1 << 32)
        h ^= h >> 15
        return (h * 0x2C1B3C6D % (1 << 32) >> (32 - bits)) + size

    for t, p in zip(TEXTS, quality_rules.probabilities(pa.array(TEXTS), {"weights": weights, "bias": 0.1, "scale": (0.7, -0.2)})):
        words = [hashed(lowered(w), 3) for w in t.encode().split()]
        one = [h % size for h in words]
        two = [0 if a == b else max(1, mixed((a + (b << 1)) % M, 4) % size) for a, b in zip(words, words[1:])]
        two = one[:1] + two
        data = t.encode() + b"\0\0"
        three = [trigram(*data[i : i + 3]) for i in range(len(data) - 2)]
        z = 0.1 + sum(sum(weights[k] for k in part) / max(1, len(part)) for part in (one, two, three))
        assert abs(p - 1 / (1 + math.exp(-(0.7 * z - 0.2)))) < 1e-9, t
