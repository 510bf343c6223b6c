"""Queries over documents and their tokens: compression, frequencies, vocabularies, sampling, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def compression(tokens: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_chars, n_tokens, ratio) of each document; ratio is bytes per token, 0 without tokens."""
    n = tokens.groupBy(id_col).agg(F.count("*").alias("n_tokens"))
    out = docs.select(id_col, F.octet_length(text_col).cast("long").alias("n_bytes"), F.length(text_col).cast("long").alias("n_chars")).join(n, id_col, "left")
    out = out.withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)).cast("long"))
    return out.withColumn("ratio", T.ratio(F.col("n_bytes"), F.col("n_tokens")))


def overall(per_doc: DataFrame, *by: str) -> DataFrame:
    """Sums of bytes and tokens and the ratio of the sums (no mean of ratios), for each group."""
    total = per_doc.groupBy(*by).agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_chars").alias("n_chars"), F.sum("n_tokens").alias("n_tokens"))
    return total.withColumn("ratio", T.ratio(F.col("n_bytes"), F.col("n_tokens"))).withColumn("chars_per_token", T.ratio(F.col("n_chars"), F.col("n_tokens")))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longer_than: int = 100) -> DataFrame:
    """(id, part, paragraph): stripped paragraphs between empty lines, of more than a number of characters."""
    parts = docs.select(id_col, F.posexplode(F.split(F.col(text_col), "\n\n", -1)).alias("part", "p"))
    return parts.select(id_col, "part", T.strip(F.col("p")).alias("paragraph")).filter(F.length("paragraph") > longer_than)


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_blank: bool = False) -> DataFrame:
    """(id, line_no, line); blank lines are kept unless asked otherwise, as dropping them loses tokens."""
    out = docs.select(id_col, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))
    return out.filter(~T.is_blank(F.col("line"))) if drop_blank else out


def blank_line_documents(rows: DataFrame, id_col: str = "doc_id", longer_than: int = 100, first: int | None = None) -> DataFrame:
    """(id, session, text): runs of non-blank lines of each file, stripped and joined by newlines, above a length.

    With ``first``, only so many of them, in order of id and session.
    """
    order = W.partitionBy(id_col).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    marked = rows.withColumn("session", F.sum(F.when(T.is_blank(F.col("line")), 1).otherwise(0)).over(order)).filter(~T.is_blank(F.col("line")))
    joined = marked.groupBy(id_col, "session").agg(F.array_sort(F.collect_list(F.struct("line_no", T.strip(F.col("line")).alias("l")))).alias("x"))
    out = joined.select(id_col, F.col("session").cast("long").alias("session"), F.array_join("x.l", "\n").alias("text")).filter(F.length("text") > longer_than)
    return out if first is None else out.orderBy(id_col, "session").limit(first)


def char_limit(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", parts: int = 256) -> DataFrame:
    """The first ``limit`` characters of the corpus in id order, the last document cut: (id, text).

    Lengths are summed in two levels: ranges of the id first, then inside of the one range the limit ends in.
    """
    sized = docs.select(F.col(id_col), F.col(text_col), F.length(text_col).cast("long").alias("n"))
    span = sized.agg(F.min(id_col).alias("lo"), F.max(id_col).alias("hi")).first()
    if span["lo"] is None:
        return docs.select(id_col, text_col)
    step = max(1, -(-(span["hi"] - span["lo"] + 1) // parts))
    sized = sized.withColumn("part", F.floor((F.col(id_col) - span["lo"]) / step).cast("int"))
    so_far = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = sized.groupBy("part").agg(F.sum("n").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(so_far), F.lit(0))).filter(F.col("before") < limit)
    inside = W.partitionBy("part").orderBy(id_col).rowsBetween(W.unboundedPreceding, -1)
    at = sized.join(F.broadcast(before.select("part", "before")), "part").withColumn("at", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return at.filter(F.col("at") < limit).select(id_col, F.expr(f"substring({text_col}, 1, cast(least(n, {limit} - at) AS int))").alias(text_col))


def chunks(text: Column, size: int) -> Column:
    """ARRAY<STRING> of fixed-size pieces; empty for an empty text."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def hash_sample(docs: DataFrame, n: int, id_col: str = "doc_id", seed: str = "42") -> DataFrame:
    """``n`` rows (all, if there are fewer) in the order of a seeded hash of the id: the same on every run."""
    return docs.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}/"), F.col(id_col).cast("string")).cast("binary"))).orderBy("_h", id_col).limit(n).drop("_h")


def longest(tokens: DataFrame, token_col: str) -> DataFrame:
    """All tokens of the greatest length in characters, with it."""
    sized = tokens.withColumn("n_chars", F.length(token_col).cast("long"))
    top = sized.agg(F.max("n_chars").alias("top"))
    return sized.join(F.broadcast(top), F.col("n_chars") == F.col("top")).drop("top")


def profile(tokens: DataFrame, token_col: str) -> DataFrame:
    """Counts of tokens by the flags of ``char_profile``."""
    flags = T.char_profile(F.col(token_col))
    return tokens.agg(F.count("*").alias("n"), *(F.sum(c.cast("long")).alias(k) for k, c in flags.items()))


def token_width(ids: DataFrame) -> DataFrame:
    """Largest id and the integer width that holds it: 16 bits unsigned or 32."""
    top = ids.agg(F.max("token_id").cast("long").alias("max_id"), F.count("*").alias("n"))
    return top.withColumn("fits_uint16", F.coalesce(F.col("max_id") <= 65535, F.lit(True))).withColumn("dtype", F.when(F.col("fits_uint16"), "uint16").otherwise("uint32"))
