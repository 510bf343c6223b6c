"""MinHash near-dedup: universal-hash minima, banding, signature verification, exact confirmation, star components.

A text is lower-cased (A-Z) and cut into words at bytes 9-13 and 32; its set holds its distinct
five-word shingles, as 128-bit hashes that mix the words' bytes (of long words, their BLAKE2). Texts with equal sets form a class, which
goes on as one node. Of a class 128 minima are kept; 32 bands of 4 put two sets of similarity 0.75
in no common bucket with a chance of (1 - 0.75^4)^32 < 6e-6.

Buckets are not expanded into pairs. Each bucket links its members to one center, checked on
signatures and then on the texts themselves, a center with some of its members a task; components of the
confirmed links follow. Only buckets that still hold more than one component go on, in blocks of bounded
members and shingles, a block against another in one task. There signatures are held against each other as
matrices; members with a partner of another component come back once more with their texts, and the task
gives of the links that it confirms a spanning forest: no more rows than members. A pair is
compared in the first band that it shares. So each pair that shares a bucket is in one
component already, or differs in its signature, or was compared in full.

Hashes only find candidates and equal sets; a link between different texts is confirmed on their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, hot_join, small_batches, table
from .components import components
from .textscan import chunks, shingle_codes, shingle_hashes

SHINGLE = 5
HASHES, BANDS = 128, 32
#: Link if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Signatures that agree in fewer minima are not compared in full: a pair of similarity 0.75 does so
#: with a chance below 3e-6.
LEAST_EQUAL = 72
#: Members and shingles of a bucket that a block holds on average (at least one whole text); members that a task holds with their center.
BLOCK, BLOCK_SHINGLES, STAR = 512, 1 << 18, 512
#: Rows (16 bytes each) up to which a set of texts to fetch or drop is broadcast; above, it is shuffled.
BROADCAST_ROWS = 1_000_000

_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def sets(col: pa.Array) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Distinct shingle hashes of each text in order, as two halves, with the first row of a chunk of texts."""
    for lo, hi, raw, off in chunks(col, 1 << 19):
        high, low, at = shingle_hashes(raw, off, SHINGLE)
        yield lo, [_distinct(high[at[d] : at[d + 1]], low[at[d] : at[d + 1]]) for d in range(hi - lo)]


def _distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(high)
    a, b = high[order], low[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():  # one half of two shingles is equal
        order = np.lexsort((low, high))
        a, b = high[order], low[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    new = np.append(len(a) > 0, ~same) if len(a) else np.zeros(0, bool)
    return a[new], b[new]


def minima(shingles: np.ndarray) -> np.ndarray:
    """Least value of each universal hash over the set, upper 32 bits."""
    best = np.full(HASHES, (1 << 64) - 1, np.uint64)
    for i in range(0, len(shingles), 4096):
        hashed = np.multiply.outer(_MUL, shingles[i : i + 4096])
        hashed += _ADD[:, None]
        np.minimum(best, hashed.min(1), out=best)
    return (best >> np.uint64(32)).astype("<u4")


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n, the two halves of a hash of the whole set, and the signature of each (id, t, text)."""
    for batch in batches:
        for lo, found in sets(batch.column(2)):
            whole = np.frombuffer(b"".join(blake2b(a.tobytes() + b.tobytes(), digest_size=16).digest() for a, b in found), "<i8").reshape(-1, 2)
            longs = [pa.array(np.ascontiguousarray(x)) for x in (np.array([len(a) for a, _ in found], np.int64), whole[:, 0], whole[:, 1])]
            sigs = pa.array([minima(a).tobytes() if len(a) else None for a, _ in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(found)), batch.column(1).slice(lo, len(found)), *longs, sigs], names=["id", "t", "n", "high", "low", "sig"])


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree often enough."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u4").reshape(-1, HASHES) for k in (3, 4))
        keep = pa.array((x == y).sum(1) >= LEAST_EQUAL)
        yield batch.select([0, 1, 2]).filter(keep)


def _confirm(t: pa.Table) -> pa.Table:
    """Links (a, b) of one center with members, from their texts."""
    node, center = t.column("node").to_numpy(), t.column("is_center").to_numpy()
    found = shingle_codes(t.column("text"), SHINGLE)
    out = []
    for c in np.flatnonzero(center)[:1]:
        for m in np.flatnonzero(~center):
            shared = len(np.intersect1d(found[c], found[m], assume_unique=True))
            if shared * 100 >= PERCENT * (len(found[c]) + len(found[m]) - shared):
                out.append((int(node[c]), int(node[m])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


_MEMBER = "key long, i int, j int, node long, n long, band int, c long, block int, sig binary"


def _candidates(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (x, y) of a block pair's members to compare in full, in order of x: of different components, with sizes
    that allow a link, agreeing signatures, and no common band before this one."""
    ids, c, n, block = (t.column(k).to_numpy() for k in ("node", "c", "n", "block"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u4").reshape(-1, HASHES)
    low, high, band = (int(t.column(k)[0].as_py()) for k in ("i", "j", "band"))
    first, rows = np.flatnonzero(block == low), HASHES // BANDS
    second = first if low == high else np.flatnonzero(block == high)
    other = np.ascontiguousarray(sig[second].T)
    for k in range(0, len(first), 512):
        part = first[k : k + 512]
        agree = np.zeros((len(part), len(second)), np.uint8)
        fits = (c[part][:, None] != c[second]) & (np.minimum(n[part][:, None], n[second]) * 100 >= np.maximum(n[part][:, None], n[second]) * PERCENT)
        if low == high:
            fits &= ids[part][:, None] < ids[second]
        for b in range(BANDS):
            equal = np.ones(agree.shape, bool)
            for h in range(b * rows, (b + 1) * rows):
                same = sig[part, h][:, None] == other[h]
                agree += same
                equal &= same
            if b < band:
                fits &= ~equal
        x, y = np.nonzero(fits & (agree >= LEAST_EQUAL))
        yield part[x], second[y]


def _with_partner(t: pa.Table) -> pa.Table:
    """The members that have a candidate."""
    hit = np.zeros(t.num_rows, bool)
    for x, y in _candidates(t):
        hit[x] = hit[y] = True
    return t.filter(pa.array(hit))


def _forest(t: pa.Table) -> pa.Table:
    """Links (a, b) of candidates confirmed on their texts, as far as they join components."""
    ids = t.column("node").to_numpy()
    _, label = np.unique(t.column("c").to_numpy(), return_inverse=True)
    found = shingle_codes(t.column("text"), SHINGLE)
    size = np.array([len(s) for s in found])
    off, code = np.concatenate([[0], np.cumsum(size)]), np.concatenate(found)
    mark = np.zeros(len(code) and int(code.max()) + 1, np.int32)
    out: list[tuple[int, int]] = []
    for xs, ys in _candidates(t):
        each, at = np.unique(xs, return_index=True)
        for x, y in zip(each.tolist(), np.split(ys, at[1:]), strict=True):
            y = y[label[y] != label[x]]
            if not len(y):
                continue
            mine = code[off[x] : off[x + 1]]
            mark[mine] = 1
            shared = np.array([mark[code[off[k] : off[k + 1]]].sum() for k in y.tolist()], np.int64)
            mark[mine] = 0
            linked = y[shared * 100 >= PERCENT * (size[x] + size[y] - shared)]
            joined, one = np.unique(label[linked], return_index=True)
            out += [(int(ids[x]), int(ids[k])) for k in linked[one]]
            label[np.isin(label, joined)] = label[x]
    return pa.table({"a": pa.array([min(p) for p in out], pa.int64()), "b": pa.array([max(p) for p in out], pa.int64())})


def _texts_of(nodes: DataFrame, reps: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Written (node, text) of written distinct ``nodes``: a text of each, fetched by its id and hash."""
    wanted = scratch.cut(reps.join(nodes, "node", "left_semi").select("node", "id", "t"))
    n = wanted.count()
    rows = scratch.cut(texts.join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted, ["id", "t"]).select("node", "text"))
    if rows.count() == n:
        return rows
    return scratch.cut(rows.groupBy("node").agg(F.min("text").alias("text")))  # repeated rows


def _star_links(buckets: DataFrame, texts: DataFrame, reps: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (center, member) whose signatures agree often enough and whose texts confirm the link."""
    stars = scratch.cut(buckets.filter("node <> center").groupBy(F.col("center").alias("a"), F.col("node").alias("b")).agg(F.max("parts").alias("parts")))
    sig = reps.select("node", "sig")
    signed = hot_join(stars, sig.select(F.col("node").alias("a"), F.col("sig").alias("x")), ["a"], ["b"]).join(sig.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b")
    pairs = scratch.cut(signed.select("a", "b", "parts", "x", "y").mapInArrow(_agreeing, "a long, b long, parts long"))
    ids = scratch.cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    full = _texts_of(ids, reps, texts, scratch)
    members = pairs.select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.col("b").alias("node"), F.lit(False).alias("is_center"))
    centers = members.select("a", "part").distinct().select("a", "part", F.col("a").alias("node"), F.lit(True).alias("is_center"))
    links = scratch.cut(members.unionByName(centers).join(full, "node").groupBy("a", "part").applyInArrow(_confirm, "a long, b long"))
    scratch.drop(stars, pairs, ids)
    return links


def _bucket_links(buckets: DataFrame, found: DataFrame, texts: DataFrame, reps: DataFrame, scratch: Scratch) -> DataFrame:
    """Links that join components inside of buckets."""
    placed = scratch.cut(buckets.join(found.withColumnRenamed("id", "node"), "node", "left").select("key", "node", "n", "band", F.coalesce("component", "node").alias("c")))
    per_key = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("members"), F.sum("n").alias("shingles")).filter("low <> high")
    blocks = scratch.cut(per_key.select("key", "members", F.ceil(F.greatest(F.col("members") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("nb")))
    rows = hot_join(placed, blocks.select("key", "nb"), ["key"], ["node"], rows=blocks.select("key", F.col("members").alias("__rows")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("nb")).cast("int"))
    # a block meets itself and every other one of its bucket
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o"))
    rows = rows.join(reps.select("node", "sig"), "node").select("key", "i", "j", "node", "n", "band", "c", "block", "sig")
    members = scratch.cut(rows.groupBy("key", "i", "j").applyInArrow(_with_partner, _MEMBER))
    ids = scratch.cut(members.select("node").distinct())
    full = _texts_of(ids, reps, texts, scratch)
    links = scratch.cut(members.join(full, "node").groupBy("key", "i", "j").applyInArrow(_forest, "a long, b long"))
    scratch.drop(placed, blocks, members, ids)
    return links


def _grouped(df: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Written (id, t, n, high, low) of each row, t being a hash of its text, and the classes that rows with an id and
    words are in: (high, low, the least id of what the class reaches, and that row's t)."""
    small_batches(df.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    texts = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    signed = scratch.cut(texts.mapInArrow(_signed, "id long, t long, n long, high long, low long, sig binary"))
    alive = signed.filter("n > 0 AND id IS NOT NULL")
    # written, so that the number of a class is settled
    reps = scratch.cut(alive.groupBy("high", "low").agg(F.min(F.struct("id", "t", "n", "sig")).alias("r")).select("high", "low", "r.*", F.monotonically_increasing_id().alias("node")))
    rows = HASHES // BANDS * 4
    bands = reps.select("node", "n", F.posexplode(F.expr(f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, substring(sig, b * {rows} + 1, {rows})))")).alias("band", "key"))
    parts = F.ceil(F.greatest(F.col("m") / STAR, F.col("shingles") / BLOCK_SHINGLES)).cast("long")
    groups = scratch.cut(bands.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"), F.min("node").alias("center")).filter("m > 1").select("key", "center", "m", parts.alias("parts")))
    buckets = scratch.cut(hot_join(bands, groups.drop("m"), ["key"], ["node"], rows=groups.select("key", F.col("m").alias("__rows"))).select("key", "node", "n", "band", "center", "parts"))
    confirmed = _star_links(buckets, texts, reps, scratch)
    found = components(confirmed, scratch)
    more = _bucket_links(buckets, found, texts, reps, scratch)
    if more.limit(1).count():  # the first components stand for their links
        found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more), scratch)
    named = reps.select("high", "low", "id", "t", "node").join(found.withColumnRenamed("id", "node"), "node", "left")
    least = named.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("id", "t")).alias("l"))
    classes = named.join(least, "component", "left").select("high", "low", F.coalesce("l.id", "id").alias("least"), F.coalesce("l.t", "t").alias("least_t"))
    return signed, scratch.cut(classes)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: (``id_col``, n_shingles, component_id, kept).

    Null and empty texts and texts without words have an empty set, link with nothing, and are
    their own component. Rows of one id are one document: what any of them links with. A null id
    links with nothing; its component is null and it is kept. Ties cannot arise: a component's
    smallest id stays. A text is read whole, however long. Other columns are not read. An empty table gives an empty one.
    """
    scratch = Scratch(df.sparkSession, "minhash")
    signed, classes = _grouped(df, id_col, text_col, scratch)
    rows = hot_join(signed.select("id", "t", "n", "high", "low"), classes.select("high", "low", "least"), ["high", "low"], ["id", "t"], "left")
    rows = rows.select("id", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("least")).alias("least"))
    ids = signed.agg(F.count("id"), F.count_distinct("id")).first()
    if ids[0] != ids[1]:
        rows = _merge_ids(scratch.cut(rows), scratch)
    component = F.coalesce("least", "id")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _merge_ids(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` with one least id for rows of one id, also where it stands on different texts and so joins components."""
    edges = rows.filter("id IS NOT NULL").select(F.col("id").alias("a"), F.coalesce("least", "id").alias("b")).distinct()
    joined = components(edges, scratch).select("id", F.col("component").alias("root"))
    return rows.join(joined, "id", "left").select("id", "n", F.col("root").alias("least"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of near-duplicate texts: that of the smallest id, then of the smallest text hash.

    It goes by rows, not by ids: a row of the same id whose text is no near-duplicate stays. Of rows equal in id and
    text the one whose columns' hash is least stays. Rows without an id or without words stay. Columns may have any
    name. An empty table gives an empty one.
    """
    scratch = Scratch(df.sparkSession, "minhash")
    signed, classes = _grouped(df, id_col, text_col, scratch)
    alive = signed.filter("n > 0 AND id IS NOT NULL").select("id", "t", "high", "low")
    rows = scratch.cut(hot_join(alive, classes, ["high", "low"], ["id", "t"]).select("id", "t", (F.col("id") == F.col("least")) & (F.col("t") == F.col("least_t"))).toDF("id", "t", "stays"))
    gone = scratch.cut(rows.filter("NOT stays").select("id", "t").distinct())
    again = scratch.cut(rows.filter("stays").groupBy("id", "t").count().filter("count > 1").select("id", "t"))
    t, key, other = (fresh(df.columns, x) for x in ("t", "gone_id", "gone_t"))
    marked = df.withColumn(t, F.xxhash64(F.col(f"`{text_col}`").cast("string")))

    def at(some: DataFrame, how: str) -> DataFrame:
        some = some.toDF(key, other)
        some = F.broadcast(some) if some.count() <= BROADCAST_ROWS else some
        return marked.join(some, (F.col(f"`{id_col}`").cast("long") == F.col(key)) & (F.col(t) == F.col(other)), how)

    if not again.limit(1).count():
        return at(gone, "left_anti").drop(t)
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    one = at(again, "left_semi").groupBy(F.col(f"`{id_col}`").alias(key), t).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias(other)).select(f"{other}.*")
    return at(gone.unionByName(again), "left_anti").drop(t).unionByName(one)


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_duplicates`` of documents: its docstring says what becomes of odd rows."""
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' ')) END)) AS s FROM w),
c AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM s WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY s),
x AS (SELECT rep, s, n, unnest(s) AS g FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, a.n + b.n AS total, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.s <> b.s AND 100 * a.n >= {PERCENT} * b.n AND 100 * b.n >= {PERCENT} * a.n GROUP BY a.rep, b.rep, a.s, b.s, a.n, b.n),
l AS (SELECT a, b FROM p WHERE 100 * shared >= {PERCENT} * (total - shared) UNION SELECT s.doc_id, c.rep FROM s JOIN c ON s.s = c.s WHERE s.doc_id IS NOT NULL),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, root) AS (SELECT DISTINCT doc_id, doc_id FROM documents WHERE doc_id IS NOT NULL UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b),
k AS (SELECT id, min(root) AS component FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, k.component AS component_id, coalesce(s.doc_id = k.component, true) AS kept FROM s LEFT JOIN k ON k.id = s.doc_id
"""
