"""Two tokenisations are compared where the texts are; rows that share an id, null ids and texts with the mark give what the join gives."""

from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import bpe_codec as C
from glyphmill.plans.queries import MERGES, QUERIES, tokenizer

SF = "/root/testdata/sf0.001"
ROWS = [(1, "the other thing in there"), (2, "the then"), (2, "on the"), (2, ""), (3, None), (4, ""), (5, f"the{T.MARK} de{T.MARK}then"), (None, "the"), (None, "de in"), (6, "qqq"), (7, "Ünïcode the größe \u00a0 on"), (8, f"{T.MARK}")]


def _few():
    return C.Tokenizer(tokenizer().vocab, MERGES[:7])


def test_counts_of_the_join(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    long = [C.encode_long(docs, t) for t in (tokenizer(), _few())]
    want = {r.doc_id: r["n"] for r in C.difference(*long).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    got = C.n_different(docs, tokenizer(), _few()).collect()
    assert {r.doc_id: r.n_differ for r in got} == want and len(got) == len(want) and None in want and 2 in want
    # other ids and merges that do not begin alike; a list beyond the chain
    other = C.Tokenizer({i + 5: t for i, t in tokenizer().vocab.items()}, MERGES[1:4])
    special = C.Tokenizer(tokenizer().vocab, MERGES, ["de"])
    plain = docs.filter(~F.contains(F.coalesce("text", F.lit("")), F.lit(T.MARK)))  # special tokens are cut out with the mark's help
    for a, b, docs in ((tokenizer(), other, docs), (special, _few(), plain)):
        long = [C.encode_long(docs, t) for t in (a, b)]
        want = {r.doc_id: r["n"] for r in C.difference(*long).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
        assert {r.doc_id: r.n_differ for r in C.n_different(docs, a, b).collect()} == want


def test_no_token_is_shuffled(spark):
    plan = QUERIES["tokenization_diff"][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
