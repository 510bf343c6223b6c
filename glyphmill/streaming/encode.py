"""Structured Streaming: encoding and counting as records arrive. A record is atomic, so the result is that of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent

from ..functions import text as T
from ..operators.bpe_codec import Tokenizer, encode_arrays


def documents(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path).select(F.col("value").alias("text"))


def encoded(stream: DataFrame, tok: Tokenizer, text_col: str = "text") -> DataFrame:
    return encode_arrays(stream, tok, text_col)


def token_counts(stream: DataFrame, tok: Tokenizer, text_col: str = "text") -> DataFrame:
    """(token_id, n), counted on from batch to batch."""
    return encoded(stream, tok, text_col).select(F.explode("tokens").alias("token_id")).groupBy("token_id").agg(F.count("*").alias("n"))


def pretoken_counts(stream: DataFrame, text_col: str = "text") -> DataFrame:
    return stream.select(F.explode(T.pretokens(F.col(text_col))).alias("pretoken")).groupBy("pretoken").agg(F.count("*").alias("n"))


def to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once Parquet files, one set a micro-batch; ``progress`` reads the query's rates."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


class Counters(StreamingQueryListener):
    """Running counters of queries while they go: batches, rows and milliseconds of each, by the query's id."""

    def __init__(self) -> None:
        self.of: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self.of.setdefault(str(event.id), {"batches": 0, "rows": 0, "ms": 0})

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        own = self.of.setdefault(str(p.id), {"batches": 0, "rows": 0, "ms": 0})
        own["batches"], own["rows"], own["ms"] = own["batches"] + 1, own["rows"] + p.numInputRows, own["ms"] + p.batchDuration

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass


def progress(query: StreamingQuery) -> list[dict]:
    """(batch, rows, ms) of the last batches of a query, as far as it keeps them."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "ms": p["batchDuration"]} for p in query.recentProgress]


def to_table(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    return counts.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
