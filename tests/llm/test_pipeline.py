"""The pipeline's stages on odd rows, each against what it is to do."""

import hashlib

import pytest

import corpus_pipeline

from .helpers import SCHEMA, empty_documents, odd_documents, write


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = odd_documents(spark)
    seen = [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{i}-{name}")
        docs = spark.read.parquet(f"{tmp_path}/{i}-{name}")
        seen.append(docs)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == seen[0].columns
    texts = [r.text for r in seen[1].collect()]
    assert None not in texts and "... !!! ???" not in texts and LONGEST(seen[0]) in map(len, texts)
    ids = [r.doc_id for r in seen[2].collect()]
    assert 4 in ids and 5 not in ids and 6 not in ids and ids.count(4) == 1
    assert not [r for r in seen[3].collect() if "a.b@mail.example.com" in r.text or "555-7349" in r.text]
    before, after = seen[3].count(), seen[4].count()
    assert 0 < after <= 2 * before
    by_text = {hashlib.sha256(r.text.encode()).hexdigest() for r in seen[4].collect()}
    assert {r.decoded_sha256 for r in seen[5].collect()} == by_text


def LONGEST(docs):
    return max(len(r.text or "") for r in docs.collect())


@pytest.mark.parametrize("rows", [[], [(1, "some words of a short text here", "en", "a", 1, *[None] * 10)]])
def test_run_on_tiny_tables(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, SCHEMA) if rows else empty_documents(spark)
    where = write(spark, tmp_path, documents=docs)
    assert corpus_pipeline.run(spark, where).count() >= 0


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
