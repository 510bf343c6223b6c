"""Tokenizer, report and checkpoint files. Tokens are kept as bytes or hex, so that nothing is lost."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import byte_characters
from ..operators.bpe_codec import Tokenizer
from ..operators.bpe_train import merges_table, vocab_table


def save_tokenizer(spark: SparkSession, tok: Tokenizer, path: str, mode: str = "errorifexists") -> None:
    """vocab/ and merges/ as Parquet with BINARY tokens, and special tokens beside them."""
    vocab_table(spark, tok.vocab).coalesce(1).write.mode(mode).parquet(f"{path}/vocab")
    merges_table(spark, tok.merges).coalesce(1).write.mode(mode).parquet(f"{path}/merges")
    spark.createDataFrame([(i, s) for i, s in enumerate(tok.specials)], "place int, special string").coalesce(1).write.mode(mode).parquet(f"{path}/specials")


def load_tokenizer(spark: SparkSession, path: str) -> Tokenizer:
    vocab = {r["token_id"]: bytes(r["token"]) for r in spark.read.parquet(f"{path}/vocab").collect()}
    merges = [(bytes(r["left"]), bytes(r["right"])) for r in spark.read.parquet(f"{path}/merges").orderBy("rank").collect()]
    return Tokenizer(vocab, merges, [r["special"] for r in spark.read.parquet(f"{path}/specials").orderBy("place").collect()])


HEX = "token_id int, token_hex string"


def save_tokenizer_json(spark: SparkSession, tok: Tokenizer, path: str, mode: str = "errorifexists") -> None:
    """vocab/, merges/ and specials/ as lines of JSON with hex tokens: readable, and nothing is lost."""
    tables = {
        "vocab": spark.createDataFrame([(i, t.hex()) for i, t in tok.vocab.items()], HEX),
        "merges": spark.createDataFrame([(i, a.hex(), b.hex()) for i, (a, b) in enumerate(tok.merges)], "rank int, left_hex string, right_hex string"),
        "specials": spark.createDataFrame(list(enumerate(tok.specials)), "place int, special string"),
    }
    for name, t in tables.items():
        t.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode(mode).text(f"{path}/{name}")


def load_tokenizer_json(spark: SparkSession, path: str) -> Tokenizer:
    read = lambda name, schema: [r["x"] for r in spark.read.text(f"{path}/{name}").select(F.from_json("value", schema).alias("x")).collect()]
    merges = sorted(read("merges", "rank int, left_hex string, right_hex string"), key=lambda r: r["rank"])
    specials = sorted(read("specials", "place int, special string"), key=lambda r: r["place"])
    return Tokenizer({r["token_id"]: bytes.fromhex(r["token_hex"]) for r in read("vocab", HEX)}, [(bytes.fromhex(r["left_hex"]), bytes.fromhex(r["right_hex"])) for r in merges], [r["special"] for r in specials])


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def _bytes(x: str | list[int]) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


def _json_only(path: str) -> None:
    if not path.endswith(".json"):
        raise ValueError(f"not a JSON file: {path}; pickled tokenizers are refused, as reading one runs whatever code it holds")


def load_vocab_json(spark: SparkSession, path: str) -> dict[int, bytes]:
    """{id: token}; a token is a string, taken as UTF-8, or a list of byte values. Pickled files are refused."""
    _json_only(path)
    return {int(k): _bytes(v) for k, v in json.loads(_text(spark, path)).items()}


def load_merges_json(spark: SparkSession, path: str) -> list[tuple[bytes, bytes]]:
    """A list of pairs, each side as in a vocabulary; entries that are no pair are left out."""
    _json_only(path)
    return [(_bytes(m[0]), _bytes(m[1])) for m in json.loads(_text(spark, path)) if len(m) == 2]


def load_printable(spark: SparkSession, vocab_path: str, merges_path: str, specials: list[str] | None = None) -> Tokenizer:
    """{printable token: id} and lines of two printable tokens, each byte written as its printable character."""
    byte_of = {c: bytes([b]) for b, c in enumerate(byte_characters())}
    plain = lambda s: b"".join(byte_of[c] for c in s)
    vocab = {i: plain(t) for t, i in json.loads(_text(spark, vocab_path)).items()}
    lines = (line.rstrip().split(" ") for line in _text(spark, merges_path).split("\n"))
    return Tokenizer(vocab, [(plain(m[0]), plain(m[1])) for m in lines if len(m) == 2 and all(m)], specials)


def save_tokens(tokens: DataFrame, path: str, mode: str = "ignore") -> str:
    """ARRAY<INT> tokens as Parquet, 32 or 64 bits by the largest id; ``ignore`` leaves an output that is there. Gives the width."""
    top = tokens.agg(F.max(F.array_max("tokens")).alias("m")).first()["m"]
    wide = top is not None and top > 2**31 - 1
    tokens.withColumn("tokens", F.col("tokens").cast(f"array<{'bigint' if wide else 'int'}>")).write.mode(mode).parquet(path)
    return "uint16" if top is None or top <= 65535 else "uint32"


def catalog(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, n_rows, n_tokens, max_id, dtype, bytes): what encoded datasets hold, and their size on disk."""
    out = None
    for name, path in paths.items():
        size = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).agg(F.sum("length").alias("bytes"))
        one = spark.read.parquet(path).agg(F.count("*").alias("n_rows"), F.sum(F.size("tokens").cast("long")).alias("n_tokens"), F.max(F.array_max("tokens")).cast("long").alias("max_id"))
        one = one.join(F.broadcast(size)).select(F.lit(name).alias("name"), "n_rows", "n_tokens", "max_id", F.when(F.col("max_id") > 65535, "uint32").otherwise("uint16").alias("dtype"), "bytes")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no dataset to list")
    return out


def save_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    report.write.mode(mode).json(path)


STATE = "name string, shape array<int>, data array<double>"


def save_checkpoint(spark: SparkSession, path: str, iteration: int, params: DataFrame, optimizer: DataFrame) -> None:
    """Parameters and optimizer state as (name, shape, data) tables, and the iteration, which is written last: it marks a whole checkpoint."""
    params.write.mode("overwrite").parquet(f"{path}/params")
    optimizer.write.mode("overwrite").parquet(f"{path}/optimizer")
    spark.createDataFrame([(iteration,)], "iteration long").coalesce(1).write.mode("overwrite").parquet(f"{path}/iteration")


def load_checkpoint(spark: SparkSession, path: str) -> tuple[int, DataFrame, DataFrame]:
    iteration = spark.read.parquet(f"{path}/iteration").first()["iteration"]
    return iteration, spark.read.parquet(f"{path}/params"), spark.read.parquet(f"{path}/optimizer")


def plain_names(state: DataFrame, prefix: str = "_orig_mod.") -> DataFrame:
    """State names without what a compiler puts before them."""
    return state.withColumn("name", F.replace("name", F.lit(prefix), F.lit("")))
