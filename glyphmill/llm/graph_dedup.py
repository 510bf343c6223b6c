"""Embedding near-dedup on a robust-pruned flat graph.

Equal vectors form a class. Centroids of a bounded sample cut the classes into overlapping
shards: a class belongs to its nearest centroid (its home) and to others about as near. Each
shard keeps, per vector, a robust-pruned list of neighbours with reverse edges; lists of a
vector from all its shards are united. A shard is searched with the near vectors that united lists
lead to outside of it: from the shard's medoid (and the query's own node) a greedy search walks
to the query, then expands as long as nodes lie in range. Every hit is verified in double precision.
A vector whose candidates all lie in range has not seen its whole neighbourhood: it is compared with
all of its cell, as are the queries of shards cut into blocks. The others keep every neighbour in range.
A recall audit against brute force follows; below its goal, shards are built with more overlap, and
then all vectors are compared block by block.

Hits are counted and united inside a shard; pairs are never emitted. A shard that is home to more than ``CAP``
vectors is parted anew by centroids of its own sample, so that shards grow in number and not in size. What
cannot be parted, as a third of all rows in one dense spot, is cut into blocks, and each block
of queries meets each block of data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .components import components

COSINE = 0.95
#: Nodes down to this cosine are expanded, so that thin spots in range are crossed.
SLACK = 0.88
#: Vectors that centroids are fitted on; centroids; vectors at home in a shard on average.
SAMPLE, MOST_SHARDS, PER_SHARD = 16_384, 4_096, 1_000
#: Vectors of a shard that one task holds; times that a shard is parted; parts, and vectors that their centroids are fitted on.
CAP, LEVELS, PARTS, PART_SAMPLE = 12_000, 3, 1024, 8_192
#: A vector joins its OVERLAP nearest shards, as far as their centroids are less than MARGIN of cosine farther than the nearest.
OVERLAP, MARGIN = 4, 0.12
CANDIDATES, DEGREE, ALPHA, BEAM = 40, 12, 1.2, 24
#: Queries of the recall audit, and its goal.
AUDIT, RECALL = 512, 0.98


def centroids(x: np.ndarray, k: int, turns: int = 8) -> np.ndarray:
    """Spherical k-means from rows spread over the sample; an empty cluster keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(turns):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.where(size > 0, size, 1), c)
    return c


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def prune(v: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Neighbour lists of one shard's unit vectors: the nearest, robustly pruned, with reverse edges; those of them
    within SLACK; which vectors have more in range than candidates."""
    n = len(v)
    c = min(CANDIDATES, n - 1)
    if c < 1:
        none = [np.zeros(0, np.int64) for _ in range(n)]
        return none, none, np.zeros(n, bool)
    src, dst, crowded = [], [], np.zeros(n, bool)
    for i in range(0, n, 256):
        sim = v[i : i + 256] @ v.T
        rows = np.arange(len(sim))
        sim[rows, i + rows] = -2
        near = np.argpartition(-sim, c - 1, axis=1)[:, :c]
        order = np.argsort(-np.take_along_axis(sim, near, 1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        far = 1 - np.take_along_axis(sim, near, 1)
        among = v[near]
        among = 1 - among @ among.transpose(0, 2, 1)
        alive = np.ones(near.shape, bool)
        chosen = np.zeros(near.shape, bool)
        for j in range(c):
            chosen[:, j] = alive[:, j] & (chosen.sum(1) < DEGREE)
            alive &= ~(chosen[:, j, None] & (ALPHA * among[:, j] <= far))
        near_by = far <= 1 - COSINE + 1e-9
        crowded[i : i + 256] = near_by.all(1) & (c < n - 1)
        chosen |= near_by & ~crowded[i : i + 256, None]
        at, to = np.nonzero(chosen)
        src.append(at + i)
        dst.append(near[at, to])
    a, b = np.concatenate(src), np.concatenate(dst)
    # all reverse edges: a hub keeps each node that leans on it, else those could not be reached
    both = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = both // n, both % n
    close = np.concatenate([np.einsum("ij,ij->i", v[a[i : i + 65536]], v[b[i : i + 65536]]) >= SLACK for i in range(0, len(a), 65536)]) if len(a) else np.zeros(0, bool)
    lists = lambda a, b: np.split(b, np.searchsorted(a, np.arange(1, n)))
    return lists(a, b), lists(a[close], b[close]), crowded


def search(q: np.ndarray, v: np.ndarray, adjacent: list[np.ndarray], entries: list[int], seen: np.ndarray, mark: int) -> np.ndarray:
    """Nodes near q: greedy with a beam from the entries, expanding everything within SLACK."""
    nodes = np.unique(np.array(entries))
    seen[nodes] = mark
    sims = v[nodes] @ q
    done = np.zeros(len(nodes), bool)
    while True:
        # the BEAM best are expanded, and however many lie in range
        limit = SLACK if len(sims) <= BEAM else min(SLACK, np.partition(sims, -BEAM)[-BEAM])
        todo = np.flatnonzero(~done & (sims >= limit))
        if len(sims) <= BEAM:
            todo = np.flatnonzero(~done)
        if not len(todo):
            return nodes[sims >= SLACK]
        if len(todo) > 4:  # the best few, unless in range, where all of them will be needed
            ahead = todo[np.argsort(-sims[todo])]
            inside = ahead[sims[ahead] >= SLACK]
            todo = inside if len(inside) > 4 else ahead[:4]
        done[todo] = True
        new = np.unique(np.concatenate([adjacent[x] for x in nodes[todo]])) if len(todo) > 1 else adjacent[nodes[todo[0]]]
        new = new[seen[new] != mark]
        if len(new):
            seen[new] = mark
            nodes = np.concatenate([nodes, new])
            sims = np.concatenate([sims, v[new] @ q])
            done = np.concatenate([done, np.zeros(len(new), bool)])


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(x, "<f8") for x in col.to_pylist()])


def _build(t: pa.Table) -> pa.Table:
    ids = t.column("id").to_numpy()
    order = np.argsort(ids)
    ids = ids[order]
    lists, near, crowded = prune(unit(_matrix(t.column("v"))[order]))
    kind = pa.list_(pa.int64())
    return pa.table({"id": ids, "nbrs": pa.array([ids[x] for x in lists], kind), "near": pa.array([ids[x] for x in near], kind), "crowded": crowded})


class Union:
    """Sets of numbered nodes; ``label`` is the least number of each node's set as of the last ``settle``."""

    def __init__(self, n: int):
        self.parent, self.label, self.loose = np.arange(n), np.arange(n), False

    def join(self, a: int, b: int) -> None:
        while self.parent[a] != a:
            a = self.parent[a]
        while self.parent[b] != b:
            b = self.parent[b]
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.loose = True

    def settle(self) -> np.ndarray:
        while self.loose:
            up = self.parent[self.parent]
            self.loose = bool((up != self.parent).any())
            self.parent = up
        self.label = self.parent[self.label]
        return self.label


def _find(t: pa.Table) -> pa.Table:
    """(id, n_links, root) of each query of a cell, and (id, null, root) of other nodes united with some."""
    rows = t.to_pandas()
    rows = rows.sort_values(["id", "is_q"], kind="stable")
    data = rows[rows.is_d].drop_duplicates("id")
    queries = rows[rows.is_q].drop_duplicates("id")
    if not len(queries) or not len(data):
        return pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    scaled = lambda col: (x := np.stack([np.frombuffer(v, "<f8") for v in col])) / np.abs(x).max(1, keepdims=True)
    raw, asked = scaled(data.v), scaled(queries.v)
    squares, sizes = np.einsum("ij,ij->i", raw, raw), np.einsum("ij,ij->i", asked, asked)
    v, ids, mult, q_ids = raw / np.sqrt(squares)[:, None], data.id.to_numpy(), data.mult.to_numpy(), queries.id.to_numpy()
    every = np.unique(np.concatenate([ids, q_ids]))
    node, q_node = np.searchsorted(every, ids), np.searchsorted(every, q_ids)
    own = np.minimum(np.searchsorted(ids, q_ids), len(ids) - 1)
    own = np.where(ids[own] == q_ids, own, -1)
    links, sets = np.zeros(len(q_ids), np.int64), Union(len(every))
    crowded = queries.crowded.to_numpy(bool)

    def exactly(k: int, hits: np.ndarray) -> np.ndarray:
        return (raw[hits] @ asked[k]) / np.sqrt(squares[hits] * sizes[k]) >= COSINE

    whole = np.flatnonzero(crowded)
    for a in range(0, len(whole), 256):  # compared with all nodes, a block of queries at a time
        ks = whole[a : a + 256]
        cosine = (asked[ks] / np.sqrt(sizes[ks])[:, None]) @ v.T
        hit = cosine >= COSINE
        for r, c in np.argwhere(np.abs(cosine - COSINE) < 1e-9).tolist():
            hit[r, c] = exactly(ks[r], np.array([c]))[0]
        known = own[ks] >= 0
        hit[np.flatnonzero(known), own[ks[known]]] = False
        links[ks] = hit @ mult
        label = sets.settle()
        of_node = label[node]
        some = np.flatnonzero(hit.any(1))
        least = np.minimum(np.where(hit[some], of_node, len(every)).min(1), label[q_node[ks[some]]])
        r, c = np.nonzero(hit[some] & (of_node != least[:, None]))
        pairs = np.concatenate([of_node[c] * len(every) + least[r], label[q_node[ks[some]]] * len(every) + least])
        for p in np.unique(pairs).tolist():
            sets.join(p // len(every), p % len(every))
    rest = np.flatnonzero(~crowded)
    if len(rest):
        adjacent = []
        for x in data.nbrs:
            if x is None or not len(x):
                adjacent.append(np.zeros(0, np.int64))
                continue
            at = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
            adjacent.append(at[ids[at] == x])
        medoid = int((v @ v.mean(0)).argmax())
        seen = np.full(len(ids), -1, np.int64)
        for k in rest.tolist():
            hits = search(asked[k] / np.sqrt(sizes[k]), v, adjacent, [medoid, int(own[k])] if own[k] >= 0 else [medoid], seen, k)
            hits = hits[(hits != own[k]) & exactly(k, hits)] if len(hits) else hits
            links[k] = mult[hits].sum()
            for h in node[hits].tolist():
                sets.join(int(q_node[k]), h)
    root = every[sets.settle()]
    is_query = np.zeros(len(every), bool)
    is_query[q_node] = True
    count = np.zeros(len(every), np.int64)
    count[q_node] = links
    shown = np.flatnonzero(is_query | (root != every))
    return pa.table({"id": every[shown], "links": pa.array(count[shown], pa.int64(), mask=~is_query[shown]), "root": root[shown]})


def _parted(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """``placed`` with every shard that is home to more than CAP vectors parted by centroids of its own sample, as far as that
    makes it smaller. A vector at home in it joins the nearest parts as it joined shards; others join the nearest alone."""
    done = None
    for _ in range(LEVELS):
        sizes = scratch.cut(placed.groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("homes")))
        large = sizes.filter(F.col("homes") > CAP)
        if not large.limit(1).count():
            break
        large = scratch.cut(large.select("shard", "n", "homes", F.least(F.lit(PARTS), F.ceil(F.col("homes") / PER_SHARD)).cast("int").alias("k"), F.ceil(F.col("n") / CAP).cast("int").alias("nb")))
        some = placed.filter("home").join(F.broadcast(large), "shard")  # fewer rows than vectors / CAP
        some = some.filter(F.pmod(F.xxhash64("id", F.lit("part")), F.lit(1 << 40)) < F.least(F.lit(1.0), PART_SAMPLE / F.col("homes")) * (1 << 40))

        def fitted(t: pa.Table) -> pa.Table:
            x = unit(_matrix(t.column("v"))[np.argsort(t.column("id").to_numpy())])
            c = centroids(x, min(t.column("k")[0].as_py(), max(1, len(x) // 4)))
            near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
            # a spot that centroids do not part stays whole
            return pa.table({"shard": t.column("shard")[:1], "c": pa.array([c.astype("<f8").tobytes()] if np.bincount(near).max() < 0.75 * len(x) else [None], pa.binary())})

        centers = scratch.cut(some.groupBy("shard").applyInArrow(fitted, "shard long, c binary").filter("c IS NOT NULL"))
        parting = large.join(centers.select("shard"), "shard", "left_semi")
        stays = placed.join(F.broadcast(parting.select("shard")), "shard", "left_anti")
        if not centers.limit(1).count():
            break
        rows = placed.join(F.broadcast(parting.select("shard", "nb")), "shard").withColumn("part", F.pmod(F.xxhash64("id"), F.col("nb"))).drop("nb")
        each = centers.join(parting, "shard").select("shard", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb").cast("long") - 1)).alias("part"))

        def dealt(t: pa.Table, c: pa.Table) -> pa.Table:
            x = unit(_matrix(t.column("v")))
            near = np.frombuffer(c.column("c")[0].as_py(), "<f8").reshape(-1, x.shape[1])
            at, part, first = _nearest(x, near, OVERLAP)
            home = t.column("home").to_numpy()
            keep = home[at] | first
            at, part, first = at[keep], part[keep], first[keep]
            out = t.select(["id", "v", "mult"]).take(pa.array(at))
            return pa.table({"shard": t.column("shard").to_numpy()[at] * PARTS + part, "id": out.column("id"), "v": out.column("v"), "mult": out.column("mult"), "home": home[at] & first})

        schema = "shard long, id long, v binary, mult long, home boolean"
        parted = rows.groupBy("shard", "part").cogroup(each.groupBy("shard", "part")).applyInArrow(dealt, schema)
        done = stays if done is None else done.unionByName(stays)
        placed = scratch.cut(parted)
    return placed if done is None else scratch.cut(done.unionByName(placed))


def _nearest(x: np.ndarray, centers: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, center, whether it is the row's nearest) for the centers that each row joins."""
    sim = x @ centers.T
    best = np.argsort(-sim, axis=1, kind="stable")[:, :overlap]
    r, j = np.nonzero(np.take_along_axis(sim, best, 1) >= sim.max(1, keepdims=True) - MARGIN)
    return r, best[r, j], j == 0


def _search_once(classes: DataFrame, centers: dict[int, np.ndarray], overlap: int, scratch: Scratch, exact: bool = False) -> DataFrame:
    """(id, links, root) rows of all cells; ``exact``: each query is compared with all of its cell."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[list, list, list]] = [([], [], [])]
            at, shard, home = out[0]
            vectors = [np.frombuffer(x, "<f8") for x in b.column("v").to_pylist()]
            for dim in {len(x) for x in vectors}:
                rows = [i for i, x in enumerate(vectors) if len(x) == dim]
                c = centers.get(dim)
                if c is None:
                    at, shard, home = at + rows, shard + [dim * MOST_SHARDS] * len(rows), home + [True] * len(rows)
                    continue
                r, near, first = _nearest(unit(np.stack([vectors[i] for i in rows])), c, overlap)
                at, shard, home = at + [rows[x] for x in r], shard + (dim * MOST_SHARDS + near).tolist(), home + first.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), *b.take(pa.array(at, pa.int64())).columns, pa.array(home, pa.bool_())], names=["shard", "id", "v", "mult", "home"])

    placed = scratch.cut(classes.select("id", "v", "mult").mapInArrow(place, "shard long, id long, v binary, mult long, home boolean"))
    placed = placed if exact else _parted(placed, scratch)
    blocks = scratch.cut(placed.groupBy("shard").agg(F.ceil(F.count("*") / CAP).cast("int").alias("nb")).filter("nb > 1"))
    # a row per shard of more than CAP vectors
    placed = placed.join(F.broadcast(blocks), "shard", "left").withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    lists = placed.groupBy("shard", "block").applyInArrow(_build, "id long, nbrs array<long>, near array<long>, crowded boolean")
    lists = scratch.cut(lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.max(F.col("crowded") | F.lit(exact)).alias("crowded")))  # 2 * DEGREE on average, overlap * CAP at most
    vectors = classes.select("id", "v", "mult").join(lists, "id")
    member = placed.select("shard", "nb", "block", "id", "home").join(vectors, "id")
    member = scratch.cut(member)
    # far neighbours guide a search inside of their shard; beyond it only near ones can lead to links
    outside = member.filter("nb = 1").select("shard", F.explode("near").alias("id")).distinct().join(member.select("shard", "id"), ["shard", "id"], "left_anti")
    whole = member.filter("nb = 1").select(F.col("shard"), F.lit(0).alias("i"), F.lit(0).alias("j"), "id", "v", "mult", "nbrs", F.col("home").alias("is_q"), F.lit(True).alias("is_d"), "crowded")
    halo = outside.join(vectors, "id").select("shard", F.lit(0).alias("i"), F.lit(0).alias("j"), "id", "v", "mult", "nbrs", F.lit(False).alias("is_q"), F.lit(True).alias("is_d"), F.lit(False).alias("crowded"))
    every = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    data = member.filter("nb > 1").withColumn("i", every).select("shard", "i", F.col("block").alias("j"), "id", "v", "mult", "nbrs", F.lit(False).alias("is_q"), F.lit(True).alias("is_d"), F.lit(False).alias("crowded"))
    queries = member.filter("nb > 1 AND home").withColumn("j", every).select("shard", F.col("block").alias("i"), "j", "id", "v", "mult", F.lit(None).cast("array<long>").alias("nbrs"), F.lit(True).alias("is_q"), F.lit(False).alias("is_d"), F.lit(True).alias("crowded"))
    cells = whole.unionByName(halo).unionByName(data).unionByName(queries)
    return scratch.cut(cells.groupBy("shard", "i", "j").applyInArrow(_find, "id long, links long, root long"))


def _audit(classes: DataFrame, links: DataFrame) -> float:
    """Share of its links that were found, on average over the AUDIT queries (half of them with links, if there are) that have some; brute force in blocks."""
    scored = classes.join(links, "id").select("id", "v", "links")
    order = F.xxhash64("id", F.lit("audit"))
    some = scored.filter("links > 0").orderBy(order).limit(AUDIT // 2).collect() + scored.orderBy(order).limit(AUDIT // 2).collect()
    got = {r["id"]: r for r in some}
    if not got:
        return 1.0
    ids = np.array(list(got))
    by_dim: dict[int, list[int]] = {}
    raw = [np.frombuffer(got[i]["v"], "<f8") for i in ids.tolist()]
    for k, x in enumerate(raw):
        by_dim.setdefault(len(x), []).append(k)
    tables = {d: (np.array(ks), unit(np.stack([raw[k] for k in ks]))) for d, ks in by_dim.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            vs, m, own = b.column("v").to_pylist(), b.column("mult").to_numpy(), b.column("id").to_numpy()
            dims = np.array([len(x) // 8 for x in vs])
            for d, (ks, q) in tables.items():
                rows = np.flatnonzero(dims == d)
                if len(rows):
                    hit = (q @ unit(np.stack([np.frombuffer(vs[r], "<f8") for r in rows])).T >= COSINE) & (ids[ks][:, None] != own[rows])
                    total[ks] += hit @ m[rows]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["id", "n"])

    truth = {r["id"]: r["n"] for r in classes.select("id", "v", "mult").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    shares = [min(got[i]["links"], n) / n for i, n in truth.items() if n]
    return float(np.mean(shares)) if shares else 1.0


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``df``: (``id_col``, n_links, component_id, kept).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing;
    vectors of different lengths do not link. Equal vectors of different ids link. Rows of one id
    are one vector if equal; else the id has the most links of any, and joins all their components.
    A null id links with nothing, has a null component and is kept. Ties cannot arise: a component's smallest id
    stays. Other columns, texts of any length among them, are not read. An empty table gives an empty one. Where the
    audit finds too few links at any overlap, all vectors are compared with all, block by block: no result is below the goal.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "graph")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.filter(F.col("id").isNotNull() & F.col("e").isNotNull() & finite & F.exists("e", lambda x: x != 0)).distinct()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column(1)
            off, flat = e.offsets.to_numpy(), e.values.to_numpy() + 0.0  # no negative zeros
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([flat[x:y].astype("<f8").tobytes() for x, y in zip(off, off[1:], strict=False)], pa.binary())], names=["id", "v"])

    packed = scratch.cut(good.mapInArrow(pack, "id long, v binary"))
    classes = scratch.cut(packed.groupBy(F.sha2("v", 256).alias("h")).agg(F.min("id").alias("id"), F.first("v").alias("v"), F.count("*").alias("mult")))
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    by_dim: dict[int, list[np.ndarray]] = {}
    for r in sample:
        x = np.frombuffer(r["v"], "<f8")
        by_dim.setdefault(len(x), []).append(x)
    centers = {}
    for dim, xs in by_dim.items():
        k = int(np.clip(n * len(xs) / len(sample) / PER_SHARD, 1, min(MOST_SHARDS, max(1, len(xs) // 4))))
        if k > 1:
            centers[dim] = centroids(unit(np.stack(xs)), k)
    overlap, exact = OVERLAP, False
    while True:
        hits = _search_once(classes, centers, overlap, scratch, exact)
        links = scratch.cut(hits.filter("links IS NOT NULL").groupBy("id").agg(F.sum("links").alias("links")))
        if exact or _audit(classes, links) >= RECALL:
            break
        if centers and overlap < 32:
            overlap *= 2
        else:
            centers, exact = {}, True
    copies = packed.select("id", F.sha2("v", 256).alias("h")).join(classes.select("h", F.col("id").alias("rep"), "mult"), "h").select("id", "rep", "mult")
    copies = scratch.cut(copies)
    edges = hits.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(copies.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    found = components(edges, scratch)
    n_links = copies.join(links.select(F.col("id").alias("rep"), "links"), "rep", "left").groupBy("id").agg(F.max(F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    known = n_links.join(found, "id", "left").select(F.col("id").alias("k"), "n_links", "component")
    out = rows.select("id").join(known, F.col("id") == F.col("k"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op4_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_duplicates`` of embeddings: its docstring says what becomes of odd rows."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS MATERIALIZED (SELECT DISTINCT * FROM v WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM g x, g y WHERE x.vec_id <> y.vec_id AND CASE WHEN len(x.e) = len(y.e) THEN list_cosine_similarity(x.e, y.e) >= {COSINE} ELSE false END),
r(id, root) AS (SELECT DISTINCT vec_id, vec_id FROM v WHERE vec_id IS NOT NULL UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id WHERE r.root < l.b),
c AS (SELECT id, min(root) AS component FROM r GROUP BY id),
n AS (SELECT a, count(DISTINCT b) AS n FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component AS component_id, coalesce(v.vec_id = c.component, true) AS kept
FROM v LEFT JOIN c ON c.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
