"""Crowds around the wanted similarity: every pair that is alike is connected, whatever the size of an entry."""

import numpy as np
import pytest

pytest.importorskip("recollect.llm")

from recollect.llm import near_copies, runtime  # noqa: E402
from tests.llm.test_near_copies import brute_links, groups  # noqa: E402


def edited(rng, words, edits):
    out = list(words)
    for at in rng.choice(len(out) // 6, edits, replace=False) * 6:  # five shingles each
        out[at + 5 if at + 5 < len(out) else at] = f"new{rng.integers(1 << 40)}"
    return out


def crowd(seed):
    rng = np.random.default_rng(seed)
    base = [f"w{rng.integers(5000)}" for _ in range(200)]
    copies = [edited(rng, base, int(rng.integers(3, 7))) for _ in range(70)]  # some within 0.8 of the original, some not
    copies += [edited(rng, c, 4) for c in copies[:35]]  # links beside the leader
    large = [[f"v{rng.integers(10**6)}" for _ in range(3000)] for _ in range(2)]
    copies += [edited(rng, x, e) for x in large for e in (40, 62, 64, 66, 70)]
    return [" ".join(x) for x in (base, *copies, *large)]


def test_no_link_is_lost_in_a_crowd(spark):
    texts = crowd(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    want = groups(len(texts), brute_links(texts))
    assert len(texts) > len(set(want)) > 3
    assert sorted(r.doc_id for r in near_copies.keep_first(docs, bucket=4).collect()) == sorted(set(want))


def test_filters_keep_every_pair(spark):
    rng = np.random.default_rng(1)
    none = near_copies._NONE
    for n in (1, 5, 9, 300, 1000, 1030, 5000):
        for _ in range(20):
            both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            more = rng.integers(0, 1 << 63, (2, n // 9), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, m])) for m in more)
            if len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b)):
                continue
            often = (np.sort(rng.permutation(both)[: n // 2]), rng.permutation(n // 2))
            for order in (none, often):
                assert len(np.intersect1d(near_copies.prefix(a, order), near_copies.prefix(b, order)))
            for words in (4, 16, 64):
                differ = int(np.bitwise_count((near_copies.parities(a, words) ^ near_copies.parities(b, words)).view(np.uint64)).sum())
                assert differ <= len(np.setxor1d(a, b)) <= (len(a) + len(b)) * 0.2 / 1.8 + 1e-6
            wide = near_copies.parities(a, 64)
            assert (wide[:32] ^ wide[32:]).tolist() == near_copies.parities(a, 32).tolist()


def test_memos_are_released():
    runtime.MEMOS.append(memo := {"a": 1})
    runtime.release()
    runtime.MEMOS.remove(memo)
    assert not memo
