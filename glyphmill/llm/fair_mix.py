"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

A source's documents stand in a keyed order; one pass over them may follow another, up to
``PASSES``. A document's virtual finish time is the tokens of its source up to and with it,
divided by the source's target. All entries are put in one order of finish times and cut at
the total budget.

Running sums are two-level, so that no task holds a source or the corpus: rows are range-sorted, each range is
summed, and a row's sum is that of the ranges before its own and of the rows before it. The place where the budget
ends is found by histograms of finish times, each over the one bin of the last that it ends in, until few
entries are left to be sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, hot_join, table

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Share of all sizes that the mix takes, in halves; and the passes over a source at most.
BUDGET_HALVES, PASSES = 3, 2
KEY = "mix-1"
#: Bins of a histogram of finish times; entries that are sorted in one task in the end.
BINS, EDGE_ROWS = 4096, 10_000
#: Sources, and characters of their names, up to which their table is broadcast; above, it is joined by source.
BROADCAST_SOURCES, BROADCAST_CHARS = 10_000, 1 << 22
WORD = r"[^\x20\x09-\x0D]+"


def running(df: DataFrame, order: list[str], values: dict[str, Column], scratch: Scratch) -> DataFrame:
    """``df`` with columns of running sums, up to and with each row, of ``values`` in the order of columns that tell its rows apart."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    totals = dealt.groupBy("__part").agg(*(F.sum(v).alias(k) for k, v in values.items()))
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row per partition
    before = totals.select("__part", *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"__before_{k}") for k in values))
    inside = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = dealt.select("*", *(F.sum(v).over(inside).alias(k) for k, v in values.items())).join(F.broadcast(before), "__part")
    return summed.select(*df.columns, *((F.col(k) + F.col(f"__before_{k}")).alias(k) for k in values))


def targets(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """(skey, source_size, start, target) of (skey, source_size): sizes of all sources before, and weights' shares of the
    budget, none above ``PASSES`` times its source, what is over being shared out anew by weight.

    Sources in order of the level at which they are full: one stays full if the level, were all
    before it full, is not below its own. The sums are of integers, so the order of adding does not show.
    """
    s = running(sources, ["skey"], {"n": F.lit(1), "upto": F.col("source_size")}, scratch)
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("n") - 1) % len(WEIGHTS) + 1).cast("int")).cast("long"))
    s = s.withColumn("level", F.col("source_size") * PASSES / F.col("w"))
    s = scratch.cut(running(s, ["level", "skey"], {"sizes": F.col("source_size"), "weights": F.col("w")}, scratch))
    whole = s.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    s = s.withColumn("rest", F.lit(BUDGET_HALVES * (whole["size"] or 0)) - 2 * PASSES * (F.col("sizes") - F.col("source_size")))
    s = s.withColumn("rest_w", F.lit(whole["w"] or 0) - F.col("weights") + F.col("w"))
    s = s.withColumn("full", F.col("source_size") * 2 * PASSES * F.col("rest_w") <= F.col("w") * F.col("rest"))
    first = s.filter(~F.col("full")).agg(F.min_by(F.struct("rest", "rest_w"), F.struct("level", "skey")).alias("at")).first()["at"]
    share = (F.col("w") * F.lit(first["rest"])).cast("double") / F.lit(2 * first["rest_w"]).cast("double") if first else F.lit(None).cast("double")
    target = F.when(F.col("full"), (F.col("source_size") * PASSES).cast("double")).otherwise(share)
    return s.select("skey", "source_size", (F.col("upto") - F.col("source_size")).alias("start"), target.alias("target"))


def _finish(k: int) -> Column:
    """Virtual finish time of pass ``k``."""
    return F.when(F.col("target") > 0, (k * F.col("source_size") + F.col("cum")).cast("double") / F.col("target"))


ORDER = ("finish", "skey", "key", "id", "size", "h", "pass")


def edge(entries: DataFrame, budget: int) -> tuple[float, object] | None:
    """Where the budget (of half tokens) ends among ``entries``: every entry that finishes before the time is taken, and of the
    others those up to the row, if there is one, in ``ORDER``. None if all fit."""
    low, high = 0.0, 2.0 * PASSES
    while True:
        width = (high - low) / BINS
        bin_of = F.when(F.col("finish") < low, -1).when(F.col("finish") >= high, BINS).otherwise(F.least(F.floor((F.col("finish") - low) / width), F.lit(BINS - 1)).cast("int"))
        bins = {r["bin"]: r for r in entries.groupBy(bin_of.alias("bin")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("finish").alias("most")).collect()}  # BINS + 2 rows at most
        total, cut = 0, None
        for b in sorted(bins):
            if (total + bins[b]["size"]) * 2 > budget:
                cut = b
                break
            total += bins[b]["size"]
        if cut is None:
            return None
        if cut == BINS:  # later than thought
            low, high = high, max(2 * high, bins[BINS]["most"] * 1.001)
            continue
        few = sum(bins[b]["n"] for b in (cut - 1, cut, cut + 1) if 0 <= b < BINS and b in bins)
        # a bin to either side, as times are rounded when they are put into bins
        now = max(low, low + (cut - 1) * width), min(high, low + (cut + 2) * width)
        if few <= EDGE_ROWS or now == (low, high):
            low, high = now
            break
        low, high = now
    before = entries.filter(F.col("finish") < low).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    line = F.sum("size").over(W.orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)) + before
    inside = entries.filter((F.col("finish") >= low) & (F.col("finish") < high))
    last = inside.withColumn("line", line).filter(F.col("line") * 2 <= budget).orderBy(*(F.col(c).desc() for c in ORDER)).first()
    return low, last


def _mixed(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """A written row per row of ``df``: (id, skey, h, size, source_size, target, copies), h being a hash of the text."""
    spark = df.sparkSession
    scratch = Scratch(spark, "mix")
    text = F.col(f"`{text_col}`").cast("string")
    sized = scratch.cut(
        df.select(
            F.col(f"`{id_col}`").alias("id"),
            _source_key(source_col).alias("skey"),
            F.xxhash64(text).alias("h"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"),
        ).withColumn("key", F.md5(F.concat(F.lit(f"{KEY}/"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary")))
    )
    sizes = sized.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("__rows"))
    sizes = scratch.cut(sizes)
    sources = scratch.cut(targets(sizes.drop("__rows"), scratch))
    placed = running(sized, ["skey", "key", "id", "size", "h"], {"upto": F.col("size")}, scratch)
    names = sources.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("skey")), F.lit(0)).alias("chars"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("total")).first()
    if names["n"] <= BROADCAST_SOURCES and names["chars"] <= BROADCAST_CHARS:
        placed = placed.join(F.broadcast(sources), "skey")
    else:
        placed = hot_join(placed, sources, ["skey"], ["key", "h"], rows=sizes.select("skey", "__rows"))
    placed = scratch.cut(placed.select("id", "skey", "key", "h", "size", "source_size", "target", (F.col("upto") - F.col("start")).alias("cum")))

    passes = F.explode(F.array(*(F.struct(F.lit(k).alias("pass"), _finish(k).alias("finish")) for k in range(PASSES))))
    entries = placed.filter("size > 0").select("skey", "key", "id", "size", "h", passes.alias("e")).select("skey", "key", "id", "size", "h", "e.*")
    end = edge(entries, BUDGET_HALVES * names["total"])
    taken = []
    for k in range(PASSES):
        if end is None:
            taken.append(F.lit(True))
            continue
        low, last = end
        mine = F.lit(False)
        if last:  # ids compare as the window ordered them; a null id stands first
            mine = F.struct(_finish(k), "skey", "key", "id", "size", "h", F.lit(k)) <= F.struct(*(F.lit(last[c]).cast(entries.schema[c].dataType) for c in ORDER))
        taken.append((_finish(k) < low) | mine)
    copies = F.when(F.col("size") > 0, sum((F.coalesce(t, F.lit(False)).cast("int") for t in taken), F.lit(0))).otherwise(0)
    return placed.select("id", "skey", "h", "size", "source_size", "target", copies.alias("copies"))


def _source_key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("t"))  # t: after every source


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``df``: (``id_col``, size, source_size, target, taken, copies).

    A null text has size 0, as an empty one; a document of size 0 is never taken. A null source
    is a source of its own, after all others. A null id is ordered as an empty one. Repeated rows
    are rows of their own. An empty table gives an empty one. Only the three columns are read, texts whole.
    Ties in finish time go by source, key, id, size, text and pass.
    """
    out = _mixed(df, id_col, text_col, source_col)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``df`` that the mix takes, each as often as it takes it; columns may have any name.

    It goes by rows: those equal in id, source and text are taken as often, together, as the mix says; where the budget
    ends among them, those whose columns' hash is least come first.
    """
    mixed = _mixed(df, id_col, text_col, source_col)
    groups = mixed.groupBy("id", "skey", "h").agg(F.count("*").alias("n"), *(F.sum((F.col("copies") > k).cast("long")).alias(f"n{k}") for k in range(PASSES))).filter("n0 > 0")
    groups = Scratch(df.sparkSession, "mix").cut(groups).withColumnsRenamed({"id": "g_id", "skey": "g_skey", "h": "g_h"})
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    rows = df.select(row.alias("row"), F.col(f"`{id_col}`").alias("id"), _source_key(source_col).alias("skey"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("h"))
    rows = rows.join(groups, F.col("id").eqNullSafe(F.col("g_id")) & (F.col("skey") == F.col("g_skey")) & (F.col("h") == F.col("g_h"))).drop("g_id", "g_skey", "g_h")
    whole = " AND ".join(f"n{k} IN (0, n)" for k in range(PASSES))
    out = rows.filter(whole).withColumn("copies", sum((F.col(f"n{k}") > 0).cast("int") for k in range(PASSES)))
    if groups.filter(f"NOT ({whole})").limit(1).count():  # the groups that the budget ends in
        nth = F.row_number().over(W.partitionBy("id", "skey", "h").orderBy(F.xxhash64(F.to_json("row"))))
        split = rows.filter(f"NOT ({whole})").withColumn("nth", nth)
        out = out.unionByName(split.withColumn("copies", sum((F.col("nth") <= F.col(f"n{k}")).cast("int") for k in range(PASSES))).drop("nth").filter("copies > 0"))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth")).select("row.*")


def op10_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mix`` of documents: its docstring says what becomes of odd rows."""
    return mix(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH sized AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce('s' || source, 't') AS skey, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0) AS BIGINT) AS size,
         md5('{KEY}/' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
s0 AS (SELECT source, skey, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1, 2),
s1 AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s0),
s2 AS (SELECT *, CAST(source_size * 2 AS DOUBLE) / w AS level FROM s1),
s3 AS (SELECT *,
         3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (ORDER BY level, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY level, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM s2),
s4 AS (SELECT *, source_size * 4 * rest_w <= w * rest AS is_full FROM s3),
s5 AS (SELECT *, first_value(rest) OVER (PARTITION BY is_full ORDER BY level, skey) AS at_rest,
         first_value(rest_w) OVER (PARTITION BY is_full ORDER BY level, skey) AS at_w FROM s4),
targets AS (SELECT skey, source_size,
         CASE WHEN is_full THEN CAST(source_size * 2 AS DOUBLE) ELSE CAST(w * at_rest AS DOUBLE) / CAST(2 * at_w AS DOUBLE) END AS target FROM s5),
placed AS (SELECT s.*, t.source_size, t.target,
         sum(size) OVER (PARTITION BY skey ORDER BY key, doc_id, size, row_no ROWS UNBOUNDED PRECEDING) AS cum
  FROM sized s JOIN targets t USING (skey)),
entries AS (SELECT p.*, k, CAST(k * source_size + cum AS DOUBLE) / target AS finish FROM placed p, (VALUES (0), (1)) AS passes(k) WHERE size > 0),
line AS (SELECT row_no, size, 2 * sum(size) OVER (ORDER BY finish, skey, key, doc_id, size, cum, k ROWS UNBOUNDED PRECEDING)
         <= 3 * (SELECT sum(size) FROM sized) AS is_taken FROM entries),
got AS (SELECT row_no, count(*) FILTER (is_taken) AS copies FROM line GROUP BY row_no)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(p.size * coalesce(g.copies, 0) AS BIGINT) AS taken, CAST(coalesce(g.copies, 0) AS INTEGER) AS copies
FROM placed p LEFT JOIN got g USING (row_no)
"""
