"""Text scans: whole files, records between a marker, complete lines; gzip by suffix."""

from __future__ import annotations

import os
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_files(spark: SparkSession, path: str, max_chars: int | None = None) -> DataFrame:
    """(path, text): one row a file, CR LF and CR as LF, the first ``max_chars`` characters where a limit is asked for."""
    text = F.regexp_replace("value", "\r\n?", "\n")
    out = spark.read.text(path, wholetext=True)
    return out.select(F.input_file_name().alias("path"), (F.substring(text, 1, max_chars) if max_chars is not None else text).alias("text"))


def records(spark: SparkSession, path: str, marker: str = "<|endoftext|>") -> DataFrame:
    """(text): pieces between a marker. Spark's splits do the cutting of large files; a record is never cut."""
    return spark.read.text(path, lineSep=marker).select(F.col("value").alias("text"))


def complete_lines(spark: SparkSession, path: str, spread: int = 0) -> DataFrame:
    """(text): one row a line. A gzip file cannot be split; ``spread`` deals its lines out to so many partitions."""
    out = spark.read.text(path).select(F.col("value").alias("text"))
    return out.repartition(spread) if spread else out


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that are there, on whatever file system they name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            out.append(p)
    return out


def chunk_boundaries(file: BinaryIO, wanted: int, marker: bytes) -> list[int]:
    """Byte offsets that part an open file into about ``wanted`` runs of whole records, each run from the second on
    beginning at a marker; fewer if markers are rare. First 0, last the file's size."""
    if not marker:
        raise ValueError("an empty marker parts nothing")
    size = file.seek(0, os.SEEK_END)
    found = {0, size}
    for k in range(1, wanted):
        at = size * k // wanted
        file.seek(at)
        tail = b""
        while block := file.read(1 << 16):
            hit = (tail + block).find(marker)
            if hit >= 0:
                found.add(at - len(tail) + hit)
                break
            at += len(block)
            tail = (tail + block)[-(len(marker) - 1) :] if len(marker) > 1 else b""
    return sorted(found)
