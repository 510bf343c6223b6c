"""The model over many sequences equals the plain one, also where exponents are large; tiles of a text are scored in one batch."""

import numpy as np
import pyarrow as pa
import pytest

from glyphmill.functions import nn
from glyphmill.operators import bpe_codec as C
from glyphmill.operators import training as TR
from glyphmill.plans.queries import tokenizer


@pytest.mark.parametrize("scale", [1.0, 400.0])
def test_many_sequences_equal_the_plain_model(scale, monkeypatch):
    monkeypatch.setattr(nn, "LOGIT_PLACES", 7)
    w = nn.random_weights(50, 16, 2, 24, seed=3)
    rng = np.random.default_rng(1)
    w = {k: v * rng.uniform(0.5, 1.5, v.shape) * (scale if "lm_head" in k or "q_proj" in k else 1) for k, v in w.items()}
    ids, targets = rng.integers(0, 50, (9, 5)), rng.integers(0, 50, (9, 5))
    y = nn.language_model(ids, w, 2, 4)
    model = nn.LanguageModel(w, 2, 4)
    best, top, loss = model(ids, targets)
    assert model.small == (scale == 1.0) and best.tolist() == y.argmax(-1).ravel().tolist() and np.allclose(top, y.max(-1).ravel())
    assert np.isclose(loss.mean(), nn.cross_entropy(y, targets))


def test_tiles_equal_sequences_of_their_own(spark):
    tok, weights = tokenizer(), nn.random_weights(270, 16, 1, 24)
    texts = {1: "the dog in the den " * 9, 2: "", 3: None, 4: "x", None: "ten men"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.at + r.pos): (r.best_id, round(r.best_logit, 9), r.loss and round(r.loss, 9)) for r in TR.tiled_logits(docs, tok, weights, 1, 4, 8).collect()}
    want = {}
    for k, text in texts.items():
        ids = np.array(C.encode_text(text or "", tok))
        for at in range(0, len(ids), 8):
            y = nn.language_model(ids[at : at + 8], weights, 1, 4)
            for i, row in enumerate(y):
                loss = round(nn.cross_entropy(row[None], ids[at + i + 1 : at + i + 2]), 9) if at + i + 1 < len(ids) else None
                want[k, at + i] = (int(row.argmax()), round(float(row.max()), 9), loss)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    for k, (_, top, loss) in want.items():
        assert np.isclose(got[k][1], top) and (got[k][2] is None if loss is None else np.isclose(got[k][2], loss))


def test_what_tiles_begin_with_alike_is_computed_once(monkeypatch):
    monkeypatch.setattr(nn, "TILES", 16)
    w = nn.random_weights(50, 16, 2, 24, seed=3)
    rng = np.random.default_rng(1)
    ids, after = rng.integers(0, 3, (300, 8)), rng.integers(0, 50, 300)
    ids[200:], ids[100:150, :6] = ids[:100], 7
    model = nn.LanguageModel(w, 2, 4)
    places, hidden = [], model.hidden
    monkeypatch.setattr(model, "hidden", lambda ids, *a: places.append(ids.size) or hidden(ids, *a))
    best, top, loss = model.tiles(ids, after)
    targets = np.append(ids[:, 1:], after[:, None], 1)
    y = nn.language_model(ids, w, 2, 4)
    assert sum(places) < 0.6 * ids.size and (best == y.argmax(-1)).all() and np.allclose(top, y.max(-1))
    assert np.allclose(loss, np.log(np.exp(y).sum(-1)) - np.take_along_axis(y, targets[..., None], -1)[..., 0])


@pytest.mark.parametrize("scale", [1.0, 400.0])
@pytest.mark.parametrize("n", [1, 4, 5, 16])
def test_tiles_of_any_length_equal_the_plain_model(n, scale):
    w = {k: v * (scale if "lm_head" in k or "q_proj" in k else 1) for k, v in nn.random_weights(50, 16, 2, 24, seed=3).items()}
    ids = np.random.default_rng(2).integers(0, 50, (40, n))
    y = nn.language_model(ids, w, 2, 4)
    best, top, loss = nn.LanguageModel(w, 2, 4).tiles(ids, ids[:, 0])
    assert (best == y.argmax(-1)).all() and np.allclose(top, y.max(-1))
    assert np.isclose(loss.mean(), nn.cross_entropy(y, np.append(ids[:, 1:], ids[:, :1], 1)))


def test_texts_are_tiled_alike_however_many_are_held(spark, monkeypatch):
    tok, weights = tokenizer(), nn.random_weights(270, 16, 1, 24)
    docs = [(f"{i}", (w * k)[: 31 * i]) for i, (w, k) in enumerate([("the dog in the den ", 9), ("", 1), ("then ", 40), ("the dog in the ", 20), ("é\n", 30)])] + [("n", None)]
    runs = []
    for held, rows in ((1, 3), (1 << 22, 1 << 16)):
        model, of, texts = nn.LanguageModel(weights, 1, 4), pa.array([k for k, _ in docs]), [np.array(C.encode_text(x or "", tok), np.int32) for _, x in docs]
        monkeypatch.setattr(TR, "ROWS", rows)
        parts = [(of, texts)] if held > 1 else [(of.slice(i, 1), texts[i : i + 1]) for i in range(len(texts)) if len(texts[i])]
        runs.append([tuple(r.values()) for o, t in parts for b in TR._placed(o, *TR._tiled(model, t, 8), 8) for r in b.to_pylist()])
    assert [r[:4] for r in runs[0]] == [r[:4] for r in runs[1]] and [r[0] for r in runs[0]] == [k for (k, _), x in zip(docs, texts, strict=True) for _ in x]
    assert np.allclose([r[4] for r in runs[0]], [r[4] for r in runs[1]]) and [r[5] is None for r in runs[0]] == [r[5] is None for r in runs[1]]
    got = TR.tiled_logits(spark.createDataFrame(docs, "doc_id string, text string").coalesce(1), tok, weights, 1, 4, 8).collect()
    assert [tuple(r)[:4] for r in got] == [r[:4] for r in runs[1]]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*docs[i : i + 2], strict=True)], names=["id", "text"]) for i in (0, 2, 4)]
    monkeypatch.setattr(TR, "HELD", 20)
    groups = list(TR._held(C.Encoder(tok), iter(batches)))
    assert len(groups) > 1 and [k for of, _ in groups for k in of.to_pylist()] == [k for k, _ in docs]
