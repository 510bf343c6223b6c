"""Sources, sinks, streams, checkpoints, and the numeric functions against NumPy and known answers."""

import gzip
import io
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import nn
from glyphmill.functions import tensors as X
from glyphmill.operators import analytics as A
from glyphmill.operators import training as TR
from glyphmill.operators.bpe_codec import Tokenizer, encode_arrays
from glyphmill.sources import artifacts
from glyphmill.sources import text as S
from glyphmill.streaming import encode as ST

TOK = Tokenizer({**{i: bytes([i]) for i in range(256)}, 256: b"th"}, [(b"t", b"h")])


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\r\nb\rc\n".encode())
    assert S.whole_files(spark, f"{tmp_path}/a.txt").first().text == "é\nb\nc\n"
    assert S.whole_files(spark, f"{tmp_path}/a.txt", 2).first().text == "é\n"
    (tmp_path / "r.txt").write_text("one<|endoftext|>two\nlines<|endoftext|>")
    assert [r.text for r in S.records(spark, f"{tmp_path}/r.txt").collect()] == ["one", "two\nlines"]
    with gzip.open(tmp_path / "z.gz", "wt") as f:
        f.write("x\ny\n")
    assert sorted(r.text for r in S.complete_lines(spark, f"{tmp_path}/z.gz", 3).collect()) == ["x", "y"]
    assert S.existing(spark, [f"{tmp_path}/a.txt", f"{tmp_path}/none"]) == [f"{tmp_path}/a.txt"]


@pytest.mark.parametrize("wanted", [1, 3, 8])
def test_chunk_boundaries(wanted):
    data = b"".join(b"x" * (97 * i % 311) + b"<|end|>" for i in range(2000))
    at = S.chunk_boundaries(io.BytesIO(data), wanted, b"<|end|>")
    assert at[0] == 0 and at[-1] == len(data) and len(at) <= wanted + 1 and at == sorted(set(at))
    assert all(data.startswith(b"<|end|>", x) for x in at[1:-1])
    assert b"".join(data[a:b] for a, b in zip(at, at[1:], strict=False)) == data


def test_token_sink_and_catalog(spark, tmp_path):
    df = encode_arrays(spark.createDataFrame([(1, "the thing"), (2, "")], "doc_id long, text string"), TOK).select("doc_id", "tokens")
    assert artifacts.save_tokens(df, f"{tmp_path}/t") == "uint16"
    assert artifacts.save_tokens(df.limit(0), f"{tmp_path}/t") == "uint16"  # what is there stays
    row = artifacts.catalog(spark, {"t": f"{tmp_path}/t"}).first()
    assert (row["name"], row.n_rows, row.n_tokens, row.max_id, row.dtype) == ("t", 2, 7, 256, "uint16") and row.bytes > 0
    assert artifacts.save_tokens(spark.createDataFrame([([70000],)], "tokens array<int>"), f"{tmp_path}/w") == "uint32"
    artifacts.save_report(df, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == 2


def test_checkpoint(spark, tmp_path):
    params = spark.createDataFrame([("w", [2, 2], [1.0, 2.0, 3.0, 4.0])], artifacts.STATE)
    artifacts.save_checkpoint(spark, f"{tmp_path}/c", 7, params, params)
    artifacts.save_checkpoint(spark, f"{tmp_path}/c", 8, params, params)
    it, p, o = artifacts.load_checkpoint(spark, f"{tmp_path}/c")
    assert it == 8 and p.collect() == params.collect() == o.collect()


def test_streams_equal_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"the thing {i}\n  foo") for i in range(40)], "doc_id long, text string")
    docs.repartition(5).write.parquet(f"{tmp_path}/in")
    stream = ST.documents(spark, f"{tmp_path}/in", "doc_id long, text string", 2)
    ST.to_files(ST.encoded(stream, TOK), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert sorted(spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(encode_arrays(docs, TOK).collect())
    for name, made in (("tok", ST.token_counts(stream, TOK)), ("pre", ST.pretoken_counts(stream))):
        ST.to_table(made, name, f"{tmp_path}/{name}").awaitTermination()
        assert spark.table(name).agg(F.sum("n")).first()[0] > 0
    assert spark.table("tok").filter("token_id = 256").first().n == 80
    counters = ST.Counters()
    spark.streams.addListener(counters)
    done = ST.to_files(ST.encoded(stream, TOK), f"{tmp_path}/out2", f"{tmp_path}/state2")
    done.awaitTermination()
    assert sum(p["rows"] for p in ST.progress(done)) == 40
    for _ in range(100):
        if counters.of.get(str(done.id), {}).get("rows") == 40:
            break
        time.sleep(0.1)
    spark.streams.removeListener(counters)
    assert counters.of[str(done.id)]["rows"] == 40 and counters.of[str(done.id)]["batches"] >= 3


def test_char_limit_and_sessions(spark):
    docs = spark.createDataFrame([(i, "abcdefghij") for i in range(20)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in A.char_limit(docs, 34).collect()}
    assert got == {0: "abcdefghij", 1: "abcdefghij", 2: "abcdefghij", 3: "abcd"}
    assert A.char_limit(docs.limit(0), 34).count() == 0
    text = " a \nb\n\n \nc\n"
    made = A.blank_line_documents(A.lines(spark.createDataFrame([(1, text)], "doc_id long, text string")), longer_than=0)
    assert sorted(r.text for r in made.collect()) == ["a\nb", "c"]
    assert [r.text for r in A.blank_line_documents(A.lines(spark.createDataFrame([(1, text)], "doc_id long, text string")), longer_than=0, first=1).collect()] == ["a\nb"]


def one(spark, c):
    return spark.range(1).select(c.alias("y")).first().y


def lit(x):
    return F.array(*(lit(v) if isinstance(v, list) else F.lit(float(v)) for v in x))


def test_known_answers(spark):
    assert one(spark, X.linear(lit([1, 0.5]), X.matrix([[1, 2], [3, 4], [5, 6]]))) == [2.0, 5.0, 8.0]
    x = [0.3, -1.2, 2.5, 0.0]
    assert np.allclose(one(spark, X.softmax(lit(x))), nn.softmax(np.array(x))) and np.allclose(one(spark, X.softmax(lit([v + 100 for v in x]))), nn.softmax(np.array(x)))
    assert np.allclose(one(spark, X.silu(lit(x))), nn.silu(np.array(x)))
    assert np.allclose(one(spark, X.rmsnorm(lit(x), lit([1, 2, 3, 4]))), nn.rmsnorm(np.array(x), np.arange(1, 5)))
    assert np.isclose(one(spark, X.cross_entropy(lit([1000 * v for v in x]), F.lit(2))), nn.cross_entropy(1000 * np.array([x]), np.array([2])))
    w = [np.random.default_rng(i).normal(size=s) for i, s in enumerate([(6, 4), (4, 6), (6, 4)])]
    assert np.allclose(one(spark, X.swiglu(lit(x), *(X.matrix(m.tolist()) for m in w))), nn.swiglu(np.array(x), *w))
    assert np.allclose(one(spark, X.rope(lit(x), F.lit(3))), nn.rope(np.array([x]), np.array([3]))[0])
    rows = np.random.default_rng(9).normal(size=(3, 4))
    mask = [True, True, False]
    got = one(spark, X.attention(lit(x), lit(rows.tolist()), lit(rows.tolist()), F.array(*map(F.lit, mask))))
    assert np.allclose(got, nn.attention(np.array([x]), rows, rows, np.array([mask]))[0])
    assert one(spark, X.attention(lit(x), lit(rows.tolist()), lit(rows.tolist()), F.array(*[F.lit(False)] * 3))) == [0.0] * 4
    assert one(spark, F.size(X.windows(F.array(*map(F.lit, [1, 2, 3])), 3))) == 0


def test_schedule(spark):
    got = [r.y for r in spark.range(25).select(X.cosine_schedule(F.col("id"), 1.0, 0.1, 7, 21).alias("y")).collect()]
    want = [t / 7 if t < 7 else 0.1 + 0.45 * (1 + math.cos((t - 7) / 14 * math.pi)) if t <= 21 else 0.1 for t in range(25)]
    assert np.allclose(got, want) and got[7] == 1.0 and got[24] == 0.1


def test_batches():
    data = np.arange(100)
    starts = []
    for seed in range(200):
        x, y = TR.get_batch(data, 32, 7, seed)
        assert x.shape == y.shape == (32, 7) and (y == x + 1).all()
        starts += x[:, 0].tolist()
    assert min(starts) == 0 and max(starts) == 92
    n, p = len(starts), 1 / 93
    assert all(abs(starts.count(s) - n * p) < 5 * math.sqrt(n * p * (1 - p)) for s in range(93))
    with pytest.raises(ValueError):
        TR.get_batch(data, 1, 100)


def test_clip_and_adamw(spark):
    g = spark.createDataFrame([("a", [3.0, 4.0]), ("b", None), ("c", [12.0])], "name string, grad array<double>")
    got = {r["name"]: r.grad for r in TR.clip_gradients(g, 1.0).collect()}
    assert got["b"] is None and np.allclose([*got["a"], *got["c"]], np.array([3, 4, 12]) / 13, atol=1e-6)
    same = {r["name"]: r.grad for r in TR.clip_gradients(g, 100.0).collect()}
    assert same["a"] == [3.0, 4.0]
    p, m, v = 0.5, 0.0, 0.0
    state = spark.createDataFrame([("w", p, 0.2, m, v, 0)], "name string, p double, g double, m double, v double, t int")
    for t in range(1, 4):
        m, v = 0.9 * m + 0.1 * 0.2, 0.999 * v + 0.001 * 0.04
        p = p * (1 - 1e-3 * 0.01) - 1e-3 * (m / (1 - 0.9**t)) / (math.sqrt(v / (1 - 0.999**t)) + 1e-8)
        state = TR.adamw_step(state.withColumn("g", F.lit(0.2)))
        state = state.withColumn("g", F.lit(0.0)).select("name", "p", "g", "m", "v", "t")
    row = state.first()
    assert np.isclose(row.p, p) and row.t == 3


def test_adamw_over_a_thousand_steps(spark):
    """Towards a target, against the plain recurrence."""
    def step(s, t):
        g = 2 * (s["p"] - 3.0)
        p, m, v = X.adamw(s["p"], g, s["m"], s["v"], t, lr=1e-2, decay=0.1)
        return F.struct(p.alias("p"), m.alias("m"), v.alias("v"))

    start = F.struct(F.lit(-1.0).alias("p"), F.lit(0.0).alias("m"), F.lit(0.0).alias("v"))
    got = spark.range(1).select(F.aggregate(F.sequence(F.lit(1), F.lit(1000)), start, step).alias("s")).first().s
    p, m, v = -1.0, 0.0, 0.0
    for t in range(1, 1001):
        g = 2 * (p - 3.0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p * (1 - 1e-2 * 0.1) - 1e-2 * (m / (1 - 0.9**t)) / (math.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.isclose(got.p, p) and np.isclose(got.m, m) and np.isclose(got.v, v)


def test_block_against_places_one_by_one():
    """A transformer block written out by place, head and component."""
    rng = np.random.default_rng(3)
    d, heads, n, ff = 8, 2, 5, 12
    w = {k: v for k, v in nn.random_weights(10, d, 1, ff, seed=4).items() if k.startswith("layers.0.")}
    w = {k[9:]: rng.normal(size=v.shape) * 0.3 for k, v in w.items()}
    x = rng.normal(size=(n, d))

    def norm(r, g):
        return [a / math.sqrt(sum(b * b for b in r) / len(r) + 1e-5) * c for a, c in zip(r, g, strict=True)]

    def times(m, r):
        return [sum(a * b for a, b in zip(row, r, strict=True)) for row in m]

    def turned(r, at):
        out = list(r)
        for i in range(0, len(r), 2):
            a = at / 10000 ** (i / len(r))
            out[i], out[i + 1] = r[i] * math.cos(a) - r[i + 1] * math.sin(a), r[i] * math.sin(a) + r[i + 1] * math.cos(a)
        return out

    rows = [norm(r, w["ln1.weight"]) for r in x]
    size, mixed = d // heads, []
    for t in range(n):
        out = []
        for h in range(heads):
            part = lambda m, r, h=h: times(w[f"attn.{m}_proj.weight"], r)[h * size : (h + 1) * size]
            q = turned(part("q", rows[t]), t)
            scores = [sum(a * b for a, b in zip(q, turned(part("k", rows[u]), u), strict=True)) / math.sqrt(size) for u in range(t + 1)]
            e = [math.exp(s - max(scores)) for s in scores]
            out += [sum(e[u] / sum(e) * part("v", rows[u])[c] for u in range(t + 1)) for c in range(size)]
        mixed.append([a + b for a, b in zip(x[t], times(w["attn.output_proj.weight"], out), strict=True)])
    want = []
    for r in mixed:
        y = norm(r, w["ln2.weight"])
        gated = [a / (1 + math.exp(-a)) * b for a, b in zip(times(w["ffn.w1.weight"], y), times(w["ffn.w3.weight"], y), strict=True)]
        want.append([a + b for a, b in zip(r, times(w["ffn.w2.weight"], gated), strict=True)])
    assert np.allclose(nn.block(x, w, heads), want)


def test_start_counts(spark):
    drawn = spark.createDataFrame([(int(s),) for s in np.random.default_rng(2).integers(0, 10, 5000)] + [(3,)] * 400, "start long")
    got = {r.start: r for r in TR.start_counts(drawn, 12).collect()}
    assert sum(r.n for r in got.values()) == 5400 and got[11].n == 0 and not got[11].is_fair and not got[3].is_fair and got[5].is_fair


def test_queries_that_see_no_key_give_zeros():
    got = nn.attention(np.ones((2, 4)), np.ones((3, 4)), np.ones((3, 4)), np.array([[False] * 3, [True, False, False]]))
    assert got.tolist() == [[0.0] * 4, [1.0] * 4]


def test_transformer_is_causal_and_accepts_short_input(spark):
    w = nn.random_weights(50, 16, 2, 32)
    ids = np.arange(10) * 7 % 50
    whole = nn.language_model(ids, w, 2, 4)
    assert whole.shape == (10, 50) and np.allclose(nn.language_model(ids[:4], w, 2, 4), whole[:4])
    assert np.allclose(nn.language_model(np.stack([ids, ids[::-1]]), w, 2, 4)[0], whole)
    got = TR.logits(spark.createDataFrame([(1, ids.tolist()), (2, [])], "seq long, tokens array<int>"), w, 2, 4).collect()
    assert [r.best_id for r in got] == whole.argmax(-1).tolist() and got[-1].loss is None
    x = np.random.default_rng(1).normal(size=(5, 16))
    ws = {k: nn.truncated_normal((16, 16), seed=i) for i, k in enumerate("qkvo")}
    row = TR.self_attention(spark.createDataFrame([(1, x.tolist())], "seq long, x array<array<double>>"), ws, 4, True).first()
    assert np.allclose(row.x, nn.multihead(x, ws["q"], ws["k"], ws["v"], ws["o"], 4, np.arange(5)))
    assert np.abs(nn.truncated_normal((1000,))).max() <= 2


def test_random_windows(spark):
    df = spark.createDataFrame([(list(range(50)),), ([1, 2],)], "tokens array<int>")
    got = TR.sample_windows(df, 20, 5, seed=1).collect()
    assert 5 <= len(got) <= 40 and all(r.y[:-1] == r.x[1:] for r in got)
