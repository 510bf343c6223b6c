"""What the operators share: durable scratch tables and the held-out fold of a document."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written tables: spark.checkpoint.dir, else the context's checkpoint folder.

    Only a local master may fall back to a temporary folder; on a cluster that would be
    invisible to the other machines, so an unset folder is an error there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="glyphmill-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Setting, Spark's own value, and the bytes of an Arrow batch that texts are handed to Python in.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def small_batches(spark: SparkSession) -> None:
    """Lets the session hand texts to Python in batches of BATCH_BYTES, unless it was given a size: a batch is held, and
    while it grows held twice, by the executor for each of its tasks."""
    if spark.conf.get(BATCH_SETTING, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


#: Tables that an operator writes before the garbage of the driver and of the executors is collected.
GARBAGE = 4


def collect_executors(spark: SparkSession) -> None:
    """Has each executor collect its garbage, after which its JVM gives heap that it does not use back to the system.

    Left alone, an executor's heap grows to its bound and stays there, beside what its Python workers hold. A task for
    each executor does it; idle ones get one each. Without executors of their own (a local master) nothing is done.
    """
    n = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1
    if n > 0:
        spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


_opened: list[list[Scratch]] = []


@contextmanager
def released() -> Iterator[None]:
    """Frees at its end the tables of all operators called inside, whose results must have been written by then."""
    _opened.append([])
    try:
        yield
    finally:
        for s in _opened.pop():
            s.close()


class Scratch:
    """Written tables of one operator call. ``cut`` ends a lineage; ``drop`` frees a table no longer read.

    What an operator returns still reads some of them, so the rest goes when the caller calls ``close``, or
    else when the application ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}
        if _opened:
            _opened[-1].append(self)

    def _at(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.parquet(path)
        if self.n % GARBAGE == 0:
            # the driver's heap would grow to its bound before it is collected, with what plans and shuffles of ended jobs have left
            self.spark.sparkContext._jvm.System.gc()
            collect_executors(self.spark)
        if self.n == 1:
            at, files = self._at(self.root)
            files.deleteOnExit(at)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            at, files = self._at(self.paths.pop(id(t)))
            files.delete(at, True)

    def close(self) -> None:
        at, files = self._at(self.root)
        files.delete(at, True)
        self.paths.clear()


#: At most so many keys can hold more than this share of all rows, which bounds what ``hot_join`` broadcasts.
HOT_KEYS = 20_000
#: Rows of a key below which it is never dealt out.
HOT_ROWS = 1_000


def hot_join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], how: str = "inner", rows: DataFrame | None = None) -> DataFrame:
    """``left.join(right, on, how)`` (inner or left) where a key may hold any share of ``left``, and ``right`` has few rows a key.

    Keys of more than 1 / HOT_KEYS of the rows are dealt over tasks by a hash of ``spread``, and the right
    side's rows of these keys are repeated for each share. All other keys are joined once. ``rows``: (``on``, __rows)
    of the keys of ``left``, where that is known; else ``left`` is counted, and should be a written table.
    """
    spark = left.sparkSession
    key = F.xxhash64(*on)
    if rows is None:
        rows = left.groupBy(*on).agg(F.count("*").alias("__rows"))
    whole = rows.agg(F.sum("__rows").alias("n"), F.max("__rows").alias("top")).first()
    most = max(HOT_ROWS, (whole["n"] or 0) // HOT_KEYS)
    if (whole["top"] or 0) <= most:
        return left.join(right, on, how)
    hot = rows.filter(F.col("__rows") > most).groupBy(key.alias("__key")).agg(F.sum("__rows").alias("__rows")).collect()
    shares = F.broadcast(spark.createDataFrame([(r["__key"], -(-r["__rows"] // most)) for r in hot], "__key long, __shares long"))
    a = left.withColumn("__key", key).join(shares, "__key", "left")
    a = a.withColumn("__share", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("__shares")), F.lit(0))).drop("__key", "__shares")
    b = right.withColumn("__key", key).join(shares, "__key", "left")
    b = b.withColumn("__share", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("__shares"), F.lit(1)) - 1))).drop("__key", "__shares")
    return a.join(b, [*on, "__share"], how).drop("__share")


def fresh(columns: list[str], name: str) -> str:
    """``name``, with as many underscores behind it as make it none of ``columns``, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's decimal text leaves ``fold`` modulo ``folds``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
