"""Large vocabularies: types in blocks of token numbers, and new pre-tokens merged together, give what one by one gives."""

import random

import numpy as np
import pytest

from glyphmill.operators import bpe_codec as C
from glyphmill.operators import bpe_train as B

RNG = random.Random(5)
COUNTS = {"".join(RNG.choice("abcdé ") for _ in range(RNG.randint(1, 12))): RNG.randint(1, 40) for _ in range(300)} | {"aaaaaaa": 90, "a" * 300: 3}


@pytest.mark.parametrize(("block", "rounds"), [(64, 2), (1 << 18, 4)])
def test_blocks_give_the_merges_of_one_process(spark, monkeypatch, block, rounds):
    monkeypatch.setattr(B, "BLOCK", block)
    monkeypatch.setattr(B, "ROUNDS", rounds)
    df = spark.createDataFrame(list(COUNTS.items()), "pretoken string, n long")
    want = B.learn({k.encode(): n for k, n in COUNTS.items()}, 80)
    assert B.train_distributed(df, 80) == want
    assert B.train_distributed(df, 0) == [] and B.train_distributed(df.limit(0), 5) == []


def test_changes_are_those_of_a_new_count():
    """Of runs too, and without pairs across types."""
    end = 300
    tokens = np.array([97, 97, 97, 98, end, 98, 97, end, 97, 97, end, 97, end], np.uint16)
    weights = np.array([5, 3, 2, 9])
    for merges in ([(97, 97, 256)], [(98, 97, 256)], [(97, 98, 256)]):
        after = B._merged(tokens, [merges], end)
        before, now = (dict(zip(*(x.tolist() for x in B._totals(*B._changes(t, weights, [], end)[0])), strict=True)) for t in (tokens, after))
        parts = B._changes(tokens, weights, merges, end)
        for key, n in zip(*(x.tolist() for x in B._totals(*(np.concatenate(x) for x in zip(*parts, strict=True)))), strict=True):
            before[key] = before.get(key, 0) + n
        assert {k: n for k, n in before.items() if n} == now and (after == end).sum() == 4


def test_words_together_equal_one_by_one(monkeypatch):
    merges = [(a, b) for a, b, _ in B.learn({k.encode(): n for k, n in COUNTS.items()}, 60)]
    tok = C.Tokenizer(dict(enumerate([*(bytes([i]) for i in range(256)), *(a + b for a, b in merges)])), merges, ["<|x|>"])
    words = [*COUNTS, "日本語", "aaaa" * 99]
    for dense in (1 << 22, 1):
        monkeypatch.setattr(C, "DENSE_PAIRS", dense)
        assert [np.frombuffer(x, np.int32).tolist() for x in C.Words(tok)([w.encode() for w in words])] == [tok.merge(w.encode()) for w in words]
    assert C.Words(tok)([]) == []
    texts = ["<|x|>aaa bé<|x|>", None, "", " aaa" * 40]
    want = [x.tolist() if x is not None else None for x in C.Encoder(tok)(texts)]
    monkeypatch.setattr(C, "MEMO_ENTRIES", 2)  # forgets, and makes ids anew
    encode = C.Encoder(tok)
    assert [x.tolist() if (x := encode([t])[0]) is not None else None for t in texts] == want and want[1:3] == [None, []]
