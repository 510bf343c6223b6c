"""Training and coding against plain recounting, known answers and each other."""

import random
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import bpe_codec as C
from glyphmill.operators import bpe_train as B
from glyphmill.sources import artifacts

TEXTS = ["low low low lower newest newest widest", "Hello, how are you?", "Héllò hôw are ü? \U0001f643", "", "s", "  two  spaces\n\n\nlines ", "don't they'll we've I'm", "x<|endoftext|>y<|endoftext|><|endoftext|>z"]
END = "<|endoftext|>"


def plain_learn(counts, n):
    words = {w: [bytes([b]) for b in w] for w in counts}
    out = []
    for _ in range(n):
        pairs = Counter()
        for w, parts in words.items():
            for p in zip(parts, parts[1:], strict=False):
                pairs[p] += counts[w]
        if not pairs:
            break
        best = max(pairs, key=lambda p: (pairs[p], p))
        out.append((*best, pairs[best]))
        for w, parts in words.items():
            new, i = [], 0
            while i < len(parts):
                if tuple(parts[i : i + 2]) == best:
                    new.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    new.append(parts[i])
                    i += 1
            words[w] = new
    return out


def counted(texts):
    return Counter(w.encode() for t in texts for w in regex.findall(T.PATTERN, t))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_learning_equals_recounting():
    rng = random.Random(3)
    for _ in range(20):
        counts = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))).encode(): rng.randint(1, 5) for _ in range(30)}
        assert B.learn(counts, 25) == plain_learn(counts, 25)


def test_distributed_loop_equals_driver_loop(spark, docs):
    counts = B.histogram(docs)
    merges = B.train_distributed(counts, 12)
    assert merges == B.learn(dict(counted(TEXTS)), 12)
    assert B.train_distributed(spark.createDataFrame([("ab", 2)], "pretoken string, n long"), 5) == [(b"a", b"b", 2)]


def test_passes_of_several_merges_equal_one_by_one(spark, monkeypatch):
    """Also where few pairs are looked at, counts tie, and two merges make one token."""
    rng = random.Random(8)
    for top in (256, 3):
        monkeypatch.setattr(B, "TOP", top)
        for _ in range(3):
            counts = {"".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))): rng.randint(1, 30) for _ in range(60)}
            df = spark.createDataFrame(list(counts.items()), "pretoken string, n long")
            assert B.train_distributed(df, 30) == plain_learn({k.encode(): n for k, n in counts.items()}, 30)
    assert B.settled([(9, b"a", b"b"), (8, b"c", b"d"), (7, b"b", b"e")]) == [(b"a", b"b", 9), (b"c", b"d", 8)]
    assert B.settled([(9, b"a", b"b"), (8, b"c", b"d"), (8, b"b", b"e")]) == [(b"a", b"b", 9)]
    assert B.settled([(9, b"a", b"bc"), (8, b"d", b"e"), (7, b"f", b"g")], [b"abc"]) == [(b"a", b"bc", 9)]


def test_texts_with_the_mark(spark):
    """Pre-tokens are parted by a mark in the whole-text form; texts that hold it go another way."""
    tok = C.Tokenizer({**{i: bytes([i]) for i in range(256)}, 256: b"th"}, [(b"t", b"h")])
    texts = ["the \u0001th t\u0001h", "th\u0001", "\u0001", "t h th", None]
    got = [r.tokens for r in C.encode_arrays(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), tok, form="chain").collect()]
    assert got == [C.encode_text(t, tok) if t is not None else None for t in texts]


def test_token_totals(spark):
    tok = C.Tokenizer({**{i: bytes([i]) for i in range(256)}, 256: b"th"}, [(b"t", b"h")])
    texts = ["the th", "th", "", None, "x"]
    want: Counter = Counter()
    docs: Counter = Counter()
    for t in filter(None, texts):
        ids = C.encode_text(t, tok)
        want.update(ids)
        docs.update(set(ids))
    got = C.token_totals(spark.createDataFrame([(t,) for t in texts], "text string"), tok).collect()
    assert {r.token_id: (r.n, r.n_docs) for r in got} == {k: (n, docs[k]) for k, n in want.items()}


def test_ties_go_to_the_greatest_bytes():
    assert B.learn({b"ab": 1, b"ba": 1, b"b\xff": 1}, 1) == [(b"b", b"\xff", 1)]


def test_train_ids_and_specials(docs):
    vocab, merges = B.train(docs, 270, [END])
    assert len(vocab) == 270 and vocab[65] == b"A" and vocab[256] == END.encode() and vocab[257] == b"".join(merges[0])
    assert not [t for i, t in vocab.items() if b"<|" in t and i != 256]
    assert B.train(docs, 100)[1] == []


def test_pretokens_are_those_of_the_pattern(docs):
    got = {r.doc_id: r.p for r in docs.select("doc_id", T.pretokens(F.col("text")).alias("p")).collect()}
    assert got == {i: regex.findall(T.PATTERN, t) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("form", ["chain", "fold", "arrow"])
def test_forms_agree_and_round_trip(docs, form):
    vocab, merges = B.train(docs, 300, [END])
    tok = C.Tokenizer(vocab, merges, [END])
    for r in C.encode_arrays(docs, tok, form=form).collect():
        assert r.tokens == C.encode_text(r.text, tok)
        assert C.decode_ids(r.tokens, tok) == r.text and r.tokens.count(256) == r.text.count(END)
    for r in C.decode_arrays(C.encode_arrays(docs, tok, form=form), tok).collect():
        assert r.decoded == r.text
    long = C.encode_long(docs, tok, form=form)
    back = {r.doc_id: r.text for r in C.decode_long(long, C.vocab_rows(docs.sparkSession, tok)).collect()}
    assert back == {i: t for i, t in enumerate(TEXTS) if t}


def test_overlapping_specials_keep_the_longer(spark):
    tok = C.Tokenizer({i: bytes([i]) for i in range(256)}, [], [END, END + END])
    text = f"a{END}{END}b{END}c"
    ids = C.encode_text(text, tok)
    assert [tok.vocab[i].decode() for i in ids] == ["a", END + END, "b", END, "c"]
    df = spark.createDataFrame([(text,)], "text string")
    assert C.encode_arrays(df, tok, form="chain").first().tokens == ids


def test_small_vocabulary_and_bad_merges():
    vocab = {**{i: bytes([i]) for i in range(256)}, 256: b"an", 257: b"na", 258: b"s,", 259: b"ban"}
    tok = C.Tokenizer(vocab, [(b"a", b"n"), (b"n", b"a"), (b"b", b"an"), (b"q", b"zz")], ["[in]", "[out]"])
    assert C.encode_text("[in]banana nab[out]", tok) == [260, 259, 256, 97, 32, 257, 98, 261]
    assert tok.usable == [(b"a", b"n"), (b"n", b"a"), (b"b", b"an")]
    assert list(C.encode_iterable(["nab", "", "ban"], tok)) == [257, 98, 259]


def test_decode_of_odd_ids():
    tok = C.Tokenizer({i: bytes([i]) for i in range(256)}, [])
    assert C.decode_ids([], tok) == "" and C.decode_ids([72, 9999, 105], tok) == "Hi"
    assert C.decode_ids([0xC3], tok) == "�" and C.decode_ids([0xE6, 0xBC, 65], tok) == b"\xe6\xbcA".decode(errors="replace")


@pytest.mark.parametrize("limit", [0, 4096])
def test_decode_arrays_skips_unknown(spark, monkeypatch, limit):
    monkeypatch.setattr(C, "LITERAL_VOCABULARY", limit)
    tok = C.Tokenizer({i: bytes([i]) for i in range(256)}, [])
    df = spark.createDataFrame([([72, 9999, 105],), ([],), ([0xE6, 0xBC, 65],)], "tokens array<int>")
    assert [r.decoded for r in C.decode_arrays(df, tok).collect()] == ["Hi", "", b"\xe6\xbcA".decode(errors="replace")]


def test_equal_tokens_last_id_counts():
    assert C.Tokenizer({0: b"a", 1: b"a"}, []).ids == {b"a": 1}


def test_artifacts_round_trip(spark, docs, tmp_path):
    vocab, merges = B.train(docs, 290, [END])
    tok = C.Tokenizer(vocab, merges, [END])
    artifacts.save_tokenizer(spark, tok, f"{tmp_path}/tok")
    back = artifacts.load_tokenizer(spark, f"{tmp_path}/tok")
    assert (back.vocab, back.merges, back.specials) == (tok.vocab, tok.merges, tok.specials)
    artifacts.save_tokenizer_json(spark, tok, f"{tmp_path}/json")
    back = artifacts.load_tokenizer_json(spark, f"{tmp_path}/json")
    assert (back.vocab, back.merges, back.specials) == (tok.vocab, tok.merges, tok.specials)
    chars = T.byte_characters()
    assert len(set(chars)) == 256 and chars[32] == "Ġ" and chars[65] == "A"
    show = lambda b: "".join(chars[x] for x in b)
    import json

    (tmp_path / "v.json").write_text(json.dumps({show(t): i for i, t in vocab.items()}))
    (tmp_path / "m.txt").write_text("#version\n" + "\n".join(f"{show(a)} {show(b)}" for a, b in merges) + "\n")
    printed = artifacts.load_printable(spark, f"{tmp_path}/v.json", f"{tmp_path}/m.txt", [END])
    assert printed.vocab == tok.vocab and printed.merges == tok.merges
    (tmp_path / "v2.json").write_text(json.dumps({"0": "é", "1": [255, 0]}))
    (tmp_path / "m2.json").write_text(json.dumps([["a", [98]], ["a"], ["a", "b", "c"]]))
    assert artifacts.load_vocab_json(spark, f"{tmp_path}/v2.json") == {0: "é".encode(), 1: b"\xff\x00"}
    assert artifacts.load_merges_json(spark, f"{tmp_path}/m2.json") == [(b"a", b"b")]
    with pytest.raises(ValueError):
        artifacts.load_vocab_json(spark, "x.pkl")


@pytest.mark.parametrize("limit", [2_000_000, 2])
def test_train_by_group(spark, monkeypatch, limit):
    monkeypatch.setattr(B, "DRIVER_TYPES", limit)
    df = spark.createDataFrame([("a", "aa aa ab"), ("b", "bb bb")], "lang string, text string")
    got = {(r.lang, r["rank"]): bytes(r.left + r.right) for r in B.train_by_group(df, "lang", 258).collect()}
    assert got[("b", 0)] == b"bb" and got[("a", 0)] == b"aa"
