"""Operators that learn or rewrite: held-out accuracy, brute force of their parts, and odd rows."""

import math
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from glyphmill.llm import language_id, pii_surrogates, quality, toxicity
from glyphmill.llm.common import Scratch

from .helpers import empty_documents, odd_documents, prose, write

SF = "/root/testdata/sf0.01"


def labels_of(spark, name):
    return {r.doc_id: r[name] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_quality_held_out(spark):
    truth = labels_of(spark, "quality")
    got = [r for r in quality.op3_nbsvm_quality(spark, SF).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in got]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_held_out(spark):
    truth = labels_of(spark, "toxic")
    got = [r for r in toxicity.op8_toxic_segments(spark, SF).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in got]) >= 0.9
    assert not [r for r in got if r.predicted and not truth[r.doc_id]]


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in language_id.op7_language_id(spark, SF).collect() if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got]) >= 0.97


def language_model():
    return language_id.Model(language_id.count_words(pa.array(["the there then", "der die das über"]), ["en", "de"]))


def all_segmentations(word, model):
    """Log of the sum over all segmentations, by the definition, place by place in exact scale."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(language_id.VOCABULARY))
    names = {bytes([i]): i for i in range(256)}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            piece = sp.id_to_piece(i).replace("▁", " ").encode()
            if len(piece) > 1 and b" " not in piece[1:]:
                names.setdefault(piece, len(names))
    longest = max(map(len, names))
    logs = [[0.0] * 2]
    for end in range(1, len(word) + 1):
        terms = [[], []]
        for size in range(1, min(longest, end) + 1):
            k = names.get(word[end - size : end])
            if k is not None:
                for g in range(2):
                    terms[g].append(logs[end - size][g] + math.log(model.scaled[k, g]))
        logs.append([max(t) + math.log(sum(math.exp(x - max(t)) for x in t)) for t in terms])
    return logs[-1]


@pytest.mark.parametrize("word", [" thereön", " " + "überthere" * 22, " 漢字" * 1 + "漢字かな交じり文" * 40, " " + "x" * 3000, " " + "responsibilities" * 30])
def test_forward_sums_all_segmentations(word):
    model, vocabulary, raw = language_model(), language_id.pieces(), np.frombuffer(word.encode(), np.uint8)
    lattice = language_id.Lattice(raw, np.array([0]), np.array([len(raw)]), vocabulary)
    sums, log = lattice.forward(model.scaled)
    want = all_segmentations(word.encode(), model)
    assert np.allclose(np.log(sums[-1]) + log[-1], want)
    back, back_log = lattice.backward(model.scaled)
    assert np.allclose(np.log(back[0]) + back_log[0], want)


def test_long_words_go_on_from_slice_to_slice(monkeypatch):
    monkeypatch.setattr(language_id, "LATTICE_BYTES", 200)
    model, text = language_model(), "überthere" * 150
    start, raw = np.array([0, 5]), np.frombuffer(b"then " + text.encode(), np.uint8)
    got = model._scores(raw, start, np.array([4, len(raw)]), language_id.pieces())
    for k, word in enumerate([" then", " " + text]):
        assert np.allclose(got[k], np.array(all_segmentations(word.encode(), model)) - len(word.encode()) * math.log(language_id.GAIN))


def test_language_of_odd_rows(spark):
    docs = odd_documents(spark)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert got[0] == got[1] == got[2] == got[16] == ("und", 0.0) and got[4][0] in ("en", "de") and None in got
    kept = language_id.keep_identified(docs, language_id.fit(docs))
    assert kept.columns == docs.columns and kept.filter("text IS NULL").count() == 0
    empty = empty_documents(spark)
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, language_id.fit(empty)).collect()} == {"und"}


def test_dual_descent_against_a_plain_solver():
    """The hinge loss reached is that of subgradient steps on the primal, and the naive Bayes scale is the log ratio of shares."""
    rng = np.random.default_rng(5)
    rows, y = [], []
    for i in range(60):
        y.append(1.0 if i % 2 else -1.0)
        rows.append(np.unique(np.concatenate([rng.choice(30, 6, replace=False), rng.choice(np.arange(30, 40) if i % 2 else np.arange(38, 48), 2, replace=False)])))
    y, weight, scale = np.array(y), rng.uniform(0.5, 1.5, 60), np.zeros(quality.DIM)
    scale[:48] = rng.normal(size=48)
    x = np.zeros((60, 49))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / np.linalg.norm(scale[r])
        x[i, 48] = 1.0

    def loss(w):
        return 0.5 * w @ w + 0.1 * (weight * np.maximum(0, 1 - y * (x @ w))).sum()

    w = quality.descend(rows, y, weight, scale, epochs=400)
    w = np.append(w[:48], w[-1])
    plain = np.zeros(49)
    best = loss(plain)
    for t in range(1, 60001):
        plain = plain - (plain - 0.1 * ((weight * (y * (x @ plain) < 1) * y)[:, None] * x).sum(0)) / t
        best = min(best, loss(plain))
    assert loss(w) <= best + 1e-6 and best - loss(w) < 1e-3

    texts = ["aaa bbb", "aaa ccc", "ddd bbb", "ddd eee"] * 40
    model = quality.Model(list(quality.packed(pa.array(texts))), [1, 1, 0, 0] * 40)
    good, bad = model.scores(pa.array(["aaa xyz", "ddd xyz"]))
    assert good > 0.5 > bad


def test_share_of_any_number_of_rows():
    from glyphmill.llm import fit

    for n in (1, 400, 401, 10**7, 10**11, 10**15):
        assert abs(fit.share(n, 400) / fit.SPOTS * n - min(n, 400)) < 1


def test_maximal_segments_against_recursion():
    rng = random.Random(5)

    def recursive(s, lo, hi):
        best = None
        for i in range(lo, hi):
            t = 0.0
            for j in range(i, hi):
                t += s[j]
                if t > 1e-12 and (best is None or t > best[0] + 1e-9):
                    best = (t, i, j)
        return [] if best is None else [*recursive(s, lo, best[1]), best[1:], *recursive(s, best[2] + 1, hi)]

    for _ in range(500):
        s = [rng.choice([-0.25, -0.25, rng.uniform(0.05, 2)]) for _ in range(rng.randint(1, 14))]
        at = np.array([i for i, x in enumerate(s) if x > 0], int)
        got = toxicity.maximal_segments(at, np.array([s[i] for i in at]), 0.25, len(s))
        assert [x[:2] for x in got] == recursive(s, 0, len(s))


def test_passages_of_odd_rows_and_no_labels(spark):
    docs = odd_documents(spark)
    for model, run in ((toxicity.Model([], []), toxicity.score), (quality.Model([], []), quality.score)):
        got = run(docs, model).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        assert run(empty_documents(spark), model).count() == 0
    rng = random.Random(1)
    texts = [prose(rng, 60) + (" awful vile rotten " if i % 3 == 0 else " ") + prose(rng, 60) for i in range(600)]
    model = toxicity.Model(texts, [int(i % 3 == 0) for i in range(600)])
    (p, where), (q, none) = model.of(pa.array(["x y " + "vile awful rotten " + prose(rng, 30), prose(rng, 30)]))
    assert p > 0.3 > q and not none and where[0]["start"] == 4


def test_queries_with_empty_tables(spark, tmp_path):
    where = write(spark, tmp_path, documents=odd_documents(spark), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert quality.op3_nbsvm_quality(spark, where).count() == toxicity.op8_toxic_segments(spark, where).count() == odd_documents(spark).count()


TEXTS = [
    "Write to Anna.Lee@corp.com or ANNA.LEE@CORP.COM now.", "Mr. John Smith met Mrs. Smith and Dr. Maria Lopez; Mr Smith left.", "card 4111 1111 1111 1111 or 4111111111111111, bad 4111111111111112",
    "call +1 (337) 555-7349 or 337-555-7349.", "ip 10.0.0.1 and v1.2.3 and 1.2.3.4.5", 'tok "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "Госпожа Анна Иванова",
]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def test_surrogates_keep_kind_format_and_coreference(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii_surrogates.pseudonymise(df).collect()}
    again = {r.doc_id: r.text for r in pii_surrogates.pseudonymise(df).collect()}
    assert got == again
    mails = re.findall(r"\S+@\S+", got[0])
    assert mails[0].upper() == mails[1] and mails[0].lower() != "anna.lee@corp.com"
    surnames = re.findall(r"M\w+\.? (?:\w+ )?(\w+)(?= met| and| left)", got[1])
    assert len(set(surnames)) == 1 and "Smith" not in got[1]
    assert re.match(r"Mr\. (\w+) ", got[1])[1] in pii_surrogates.GIVEN["given_m_latin"] and re.search(r"Dr\. (\w+) ", got[1])[1] in pii_surrogates.GIVEN["given_f_latin"]
    a, b, c = re.findall(r"(\d[\d ]{14,18}\d)", got[2])
    assert a.replace(" ", "") == b != c and luhn(b) == luhn("4111111111111111") and luhn(c) == luhn("4111111111111112") and a.count(" ") == 3
    assert re.fullmatch(r"call \+1 \((\d{3})\) (\d{3}-\d{4}) or \1-\2\.", got[3])
    assert "10.0.0.1" not in got[4] and got[4].endswith("and v1.2.3 and 1.2.3.4.5")
    assert re.fullmatch(r'tok "[0-9a-f]{40}"', got[5]) and got[5] != TEXTS[5]
    assert re.search("[а-я]", got[6]) and "Иванов" not in got[6]
    other = {r.doc_id: r.text for r in pii_surrogates.pseudonymise(df, key="other").collect()}
    assert all(other[i] != got[i] for i in got)


def test_surrogates_stay_distinct(spark):
    """More given names than the list holds: clashes are drawn again until none is left."""
    names = [f"n{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)] + [n.lower() for n in pii_surrogates.GIVEN["given_m_latin"]]
    df = spark.createDataFrame([("given_m_latin", n) for n in names], "kind string, canon string")
    got = pii_surrogates.surrogates(df, Scratch(spark, "t"), "tests").collect()
    made = [r.surrogate for r in got]
    assert len(got) == len(names) == len(set(made)) and not set(made) & set(names)


def test_pii_of_odd_rows(spark):
    docs = odd_documents(spark)
    got = pii_surrogates.pseudonymise(docs, kinds_col="__kinds")
    assert got.columns == [*docs.columns, "__kinds"] and got.count() == docs.count()
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[0].text is None and by_id[4].text == {r.doc_id: r.text for r in docs.collect()}[4] and by_id[14]["__kinds"] == "card,email,phone"
    assert pii_surrogates.pseudonymise(empty_documents(spark)).count() == 0
