"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The training figure is taken as the published gate is: a vocabulary of 500 with one special
token from a text of about 133,000 bytes, here the first documents of the table, histogram included.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, os.environ.get("PYTHONPATH"))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

HEADLINE = (
    "pretoken_counts", "bpe_pair_counts", "bpe_best_pair", "bpe_train_full", "bpe_encode_k", "bpe_encode_arrow", "bpe_decode_roundtrip", "token_frequency",
    "corpus_compression", "compression_by_lang", "longest_tokens", "token_char_profile", "blank_line_documents", "linear", "softmax", "attention",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from glyphmill.operators.bpe_train import learn, train
    from glyphmill.plans.queries import QUERIES

    spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.sum(F.length("text"))).collect()  # JVM and page cache
    times: dict[str, float] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)

    docs, size = [], 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(200).collect():
        if size < 133_000:
            docs.append((r["doc_id"], r["text"]))
            size += len(r["text"].encode())
    small = spark.createDataFrame(docs, "doc_id long, text string")
    train(small, 500, ["<|endoftext|>"])
    began = time.perf_counter()
    train(small, 500, ["<|endoftext|>"])
    times["train_vocab_500_133kB"] = round(time.perf_counter() - began, 3)
    import regex

    from glyphmill.functions.text import PATTERN

    counts: dict[bytes, int] = {}
    began = time.perf_counter()
    for _, text in docs:
        for w in regex.findall(PATTERN, text):
            counts[w.encode()] = counts.get(w.encode(), 0) + 1
    learn(counts, 243)
    times["train_vocab_500_133kB_loop_only"] = round(time.perf_counter() - began, 3)
    total = sum(v for k, v in times.items() if k in HEADLINE)
    print(json.dumps({"metric": "headline queries, total", "value": round(total, 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
