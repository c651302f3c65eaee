"""Near-duplicate embeddings by range search over a robust-pruned flat graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, settle
from .components import components

LIMIT = 0.9
#: Vectors that the centroids are fitted on, vectors meant for a shard, most shards, and how many
#: shards a vector joins.
SAMPLE, SHARD, SHARDS, OVERLAP = 20_000, 800, 4096, 3
#: Out-degree, candidates for pruning, slack of pruning, beam of the search, nodes expanded and queries walked at once.
DEGREE, CANDIDATES, SLACK, BEAM, STEP, QUERIES = 24, 48, 1.2, 24, 4, 256
#: Queries of the audit, and the recall below which the search is repeated with twice the width.
AUDIT, RECALL = 256, 0.95
#: Recall below which the result is not given out, audited queries with links that are enough, and most queries drawn for them.
LEAST, ENOUGH, MOST = 0.9, 64, 16_384


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Unit rows in double precision, scaled first so that no square leaves the range."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of a bounded sample, begun at evenly spread rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
    return c


def robust_prune(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, slack: float = SLACK) -> np.ndarray:
    """Out-neighbours of each row, padded with -1: going from near to far a candidate stays unless
    one that stayed is nearer to it, by the slack, than the row is. Half of each row's candidates
    are its nearest ones and half lie along a fixed shuffle, which keeps the graph in one piece."""
    n = len(x)
    if n < 2:
        return np.full((n, 1), -1)
    near, far = min(n - 1, candidates // 2), min(n - 1, candidates - candidates // 2)
    steps = np.unique(np.linspace(1, n - 1, far).astype(int))
    place = np.random.default_rng(7).permutation(n)
    back = np.argsort(place)
    short = x.astype(np.float32)
    out = np.full((n, degree), -1)
    for lo in range(0, n, 256):
        rows = np.arange(lo, min(n, lo + 256))
        s = short[rows] @ short.T
        s[np.arange(len(rows)), rows] = -2
        top = np.argpartition(-s, near - 1, axis=1)[:, :near]
        cand = np.concatenate([top, back[(place[rows][:, None] + steps) % n]], axis=1)
        sim = np.take_along_axis(s, cand, axis=1)
        order = np.argsort(-sim, axis=1, kind="stable")
        cand, dist = np.take_along_axis(cand, order, 1), 1 - np.take_along_axis(sim, order, 1)
        y = short[cand]
        between = 1 - y @ y.transpose(0, 2, 1)
        alive = cand != rows[:, None]
        count = np.zeros(len(rows), int)
        for j in range(cand.shape[1]):
            take = np.flatnonzero(alive[:, j] & (count < degree))
            if not len(take):
                continue
            out[rows[take], count[take]] = cand[take, j]
            count[take] += 1
            alive[take] &= ~(slack * between[take, j] <= dist[take])
    return out


def range_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, medoid: int, limit: float, beam: int = BEAM) -> list[np.ndarray]:
    """For each query (a row number) the other rows found with cosine >= limit. A greedy search from the
    medoid and the query's own list with a beam, STEP nodes a hop; then all that was found in range is
    expanded, level by level, along near edges in either direction, until nothing new is in range. Going
    back along edges reaches those that are on nobody's list."""
    n, degree = len(x), graph.shape[1]
    short = x.astype(np.float32)
    tail, head = np.repeat(np.arange(n), degree)[graph.ravel() >= 0], graph[graph >= 0]
    close = np.concatenate([np.einsum("nd,nd->n", short[tail[k : k + 65536]], short[head[k : k + 65536]]) for k in range(0, len(tail), 65536)]) >= limit - 0.1 if len(tail) else np.zeros(0, bool)
    edges = np.unique(np.concatenate([tail[close] * n + head[close], head[close] * n + tail[close]]))
    ends, first = edges % n, np.searchsorted(edges, np.arange(n + 1) * n)
    lists = np.where(graph < 0, n, graph)  # n is nobody, and always seen
    lists = np.concatenate([lists, np.full((1, degree), n)])
    low, found = np.float32(limit - 1e-5), []
    for lo in range(0, len(queries), QUERIES):
        q = queries[lo : lo + QUERIES]
        m = len(q)
        rows = np.arange(m)
        seen = np.zeros((m, n + 1), bool)
        seen[:, n] = seen[rows, q] = True
        ids, sims = np.full((m, beam), n), np.full((m, beam), -2, np.float32)
        spent = np.ones((m, beam), bool)
        hit_row, hit_node = [], []

        def look(who: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Of (query, node) pairs those seen for the first time, and their similarities."""
            fresh = np.flatnonzero(~seen[who, nodes])
            flat = np.unique(who[fresh] * (n + 1) + nodes[fresh])
            who, nodes = np.divmod(flat, n + 1)
            seen[who, nodes] = True
            sim = np.einsum("nd,nd->n", short[q[who]], short[nodes])
            near = sim >= low
            hit_row.append(who[near])
            hit_node.append(nodes[near])
            return who, nodes, sim

        new = np.concatenate([lists[q], np.full((m, 1), medoid)], axis=1)
        active = rows
        while len(active):
            who, nodes, sim = look(np.repeat(active, new.shape[1]), new.ravel())
            nth = np.arange(len(who)) - np.searchsorted(who, who)
            width = int(nth.max()) + 1 if len(nth) else 0
            place = np.searchsorted(active, who)
            more, more_sim = np.full((len(active), width), n), np.full((len(active), width), -2, np.float32)
            more[place, nth], more_sim[place, nth] = nodes, sim
            all_ids, all_sims = np.concatenate([ids[active], more], axis=1), np.concatenate([sims[active], more_sim], axis=1)
            all_spent = np.concatenate([spent[active], more == n], axis=1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[active], sims[active], now = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1), np.take_along_axis(all_spent, best, 1)
            open_ = np.where(now, np.float32(-3), sims[active])
            go = np.argpartition(-open_, STEP - 1, axis=1)[:, :STEP]
            value = np.take_along_axis(open_, go, 1)
            new = np.where(value > -3, np.take_along_axis(ids[active], go, 1), n)
            np.put_along_axis(now, go, True, axis=1)
            spent[active] = now
            left = (new < n).any(axis=1)
            active = active[left]
            new = lists[new[left]].reshape(len(active), STEP * degree)
        who, nodes = (np.concatenate(h) if h else np.zeros(0, int) for h in (hit_row, hit_node))
        while len(who):
            level = len(hit_row)
            width = first[nodes + 1] - first[nodes]
            look(np.repeat(who, width), ends[np.repeat(first[nodes] - np.cumsum(width) + width, width) + np.arange(int(width.sum()))])
            who, nodes = np.concatenate(hit_row[level:]), np.concatenate(hit_node[level:])
        who, nodes = (np.concatenate(h) if h else np.zeros(0, int) for h in (hit_row, hit_node))
        order = np.lexsort((nodes, who))
        found += np.split(nodes[order], np.searchsorted(who[order], np.arange(1, m)))
    return found


def _labels(n: int, pairs: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The smallest row reachable, of rows 0 to n - 1."""
    parent = np.arange(n)

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k, others in pairs:
        a = root(k)
        for b in {root(int(o)) for o in others}:
            a, b = min(a, b), max(a, b)
            parent[b] = a
    return np.array([root(k) for k in range(n)])


def _assign(classes: DataFrame, dims: int, centroids, overlap: int) -> DataFrame:
    """(shard, home, id, m, x): each class in the shards of its nearest centroids, home in the nearest."""

    def run(batches):
        c = centroids.value
        for batch in batches:
            s = _matrix(batch.column(2), dims) @ c.T
            k = min(overlap, c.shape[0])
            near = np.argpartition(-s, k - 1, axis=1)[:, :k]
            first = np.argmax(s, axis=1)
            row = np.repeat(np.arange(len(s)), k)
            shard = near.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(shard == first[row]), *[batch.column(j).take(pa.array(row)) for j in range(3)]], names=["shard", "home", "id", "m", "x"])

    return classes.select("id", "m", "x").mapInArrow(released(run), f"shard int, home boolean, id long, m long, x {dict(classes.dtypes)['x']}")


def _search(classes: DataFrame, dims: int, centroids, overlap: int, limit: float, beam: int) -> DataFrame:
    """(id, others, label): for each class met in a shard its smallest reachable one there, and for those at
    home the number of vectors of other classes that are linked to it, else null."""
    spread = settle(_assign(classes, dims, centroids, overlap), "graph-shards")
    kind = dict(classes.dtypes)["x"]

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("id").to_numpy()
        order = np.argsort(ids)
        x = _matrix(table.column("x").combine_chunks(), dims)[order]
        ids = ids[order]
        g = robust_prune(x)
        lists, near = [], []
        for k, row in enumerate(g):
            row = row[row >= 0]
            lists.append(ids[row])
            near.append(ids[row[x[row] @ x[k] >= limit - 0.1]])
        shard = pa.array(np.full(len(ids), table.column("shard")[0].as_py(), np.int32))
        longs = pa.list_(pa.int64())
        return pa.table({"shard": shard, "id": ids, "nbrs": pa.array(lists, longs), "near": pa.array(near, longs)})

    built = settle(spread.select("shard", "id", "x").groupBy("shard").applyInArrow(build, "shard int, id long, nbrs array<bigint>, near array<bigint>"), "graph-lists")
    # what other shards found near a vector joins its list in its home shard, and with it the
    # vectors at the other ends that are strangers there
    home = spread.where("home").select("shard", "id")
    near = built.select("id", F.explode("near").alias("v")).distinct().join(home, "id")
    near = settle(near, "graph-near")
    added = near.groupBy("shard", "id").agg(F.collect_set("v").alias("more"))  # overlap * DEGREE at most
    lists = built.select("shard", "id", "nbrs").join(added, ["shard", "id"], "left").select("shard", "id", F.array_union("nbrs", F.coalesce("more", F.array().cast("array<bigint>"))).alias("nbrs"))
    halo = near.select("shard", F.col("v").alias("id")).distinct().join(spread.select("shard", "id"), ["shard", "id"], "left_anti").join(classes.select("id", "m", "x"), "id")
    rows = spread.join(lists, ["shard", "id"], "left").select("shard", "home", "id", "m", "x", "nbrs").unionByName(halo.select("shard", F.lit(None).cast("boolean").alias("home"), "id", "m", F.col("x").cast(kind).alias("x"), F.lit(None).cast("array<bigint>").alias("nbrs")))

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("id").to_numpy()
        order = np.argsort(ids)
        ids, m = ids[order], table.column("m").to_numpy()[order]
        x = _matrix(table.column("x").combine_chunks(), dims)[order]
        told = table.column("home").to_pylist()
        home, member = np.array([h is True for h in told])[order], np.array([h is not None for h in told])[order]
        lists = table.column("nbrs").combine_chunks()
        width = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy()
        graph = np.full((len(ids), max(1, int(width.max()))), -1)
        back = np.empty(len(order), int)
        back[order] = np.arange(len(order))
        row = np.repeat(back, width)
        graph[row, np.arange(len(flat)) - np.repeat(np.cumsum(width) - width, width)] = np.searchsorted(ids, flat)
        inner = np.flatnonzero(member)
        medoid = int(inner[np.argmax(x[inner] @ x[inner].mean(axis=0))])
        asked = np.flatnonzero(home)
        hits = range_search(x, graph, asked, medoid, limit, beam)
        hits = [h[x[h] @ x[k] >= limit] for k, h in zip(asked, hits, strict=True)]  # every link in double precision
        label = _labels(len(ids), list(zip(asked.tolist(), hits, strict=True)))
        others = np.zeros(len(ids), np.int64)
        others[asked] = [int(m[h].sum()) for h in hits]
        tell = np.unique(np.concatenate([asked[others[asked] > 0], *hits])) if len(asked) else np.zeros(0, int)
        return pa.table({"id": ids[tell], "others": pa.array(others[tell], mask=~home[tell]), "label": ids[label[tell]]})

    return settle(rows.groupBy("shard").applyInArrow(search, "id long, others long, label long"), "graph-links")


def audit(classes: DataFrame, counts: DataFrame, dims: int, limit: float) -> tuple[float | None, float | None]:
    """(the mean over classes with links of the share of a class's links that were found, the share of
    all their links), by brute force. Classes are drawn by a hash, AUDIT at first and four times as many while fewer than
    ENOUGH of them have links, MOST at most; None if none has."""
    drawn, n = AUDIT, classes.count()
    while True:
        told, *recall = _audited(classes, counts, dims, limit, drawn)
        if told >= ENOUGH or drawn >= MOST or drawn >= n:
            return tuple(recall)
        drawn *= 4


def _audited(classes: DataFrame, counts: DataFrame, dims: int, limit: float, queries: int):
    """(classes with links among so many, the mean share of their links that was found, the share of all).
    What was found is verified, so its number tells what is missing."""
    drawn = classes.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(queries).select("id", "x").toArrow()
    asked, q = drawn.column("id").to_numpy(), _matrix(drawn.column("x").combine_chunks(), dims)
    sent = classes.sparkSession.sparkContext.broadcast((asked, q))  # MOST rows at most

    def run(batches):
        asked, q = sent.value
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            ids, m = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            linked = _matrix(batch.column(2), dims) @ q.T >= limit
            linked &= ids[:, None] != asked
            total += m @ linked
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": asked[some], "n": total[some]})

    true = classes.select("id", "m", "x").mapInArrow(released(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    told = true.join(counts, "id", "left").select("n", F.coalesce("others", F.lit(0)).alias("hit"))
    out = told.agg(F.count("*"), F.avg(F.col("hit") / F.col("n")), F.sum("hit") / F.sum("n")).first()
    sent.destroy()
    return out


def near_duplicates(vectors: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall): vectors are linked when their cosine, in double
    precision, is at least limit.

    Equal vectors are one class. Classes join the shards of their OVERLAP nearest centroids; each
    shard builds a robust-pruned graph; adjacency lists are united; in its home shard, whose lists
    reach into the others where those found it near vectors, each class is searched for from the
    medoid, range-expanding. Every link is checked in double precision and counted where it is
    found; what leaves a shard is a count and a label for each class, no pairs. A brute-force audit
    measures recall by class and by link; with either below RECALL the search is done again with
    twice the overlap and beam, the labels of all rounds together and the largest counts. Less than
    LEAST by class after the third is an error. recall is the lesser of the two, null where no
    audited vector has links.

    Null, zero and non-finite vectors, those with null parts and those of another length than most
    have no links and are kept. Rows that repeat a vec_id are linked rows. An empty table gives an
    empty result. Other columns are not read. A shard is one task's work: with SHARDS of them at
    most, that is OVERLAP * classes / SHARDS vectors.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    part = dict(vectors.dtypes)["embedding"].removeprefix("array<").removesuffix(">")
    base = vectors.select("vec_id", (e if part in ("float", "double") else F.transform(e, lambda x: x.cast("double"))).alias("x"))
    good = F.coalesce(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("x", lambda x: x != 0), F.lit(False))
    sized = base.where(good).groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sized:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"), F.lit(None).cast("double").alias("recall"))
    dims = sized[0][0]
    # a class is told by its parts, zeros of either sign alike; a row by its class
    clean = F.transform("x", lambda x: F.when(x == 0, F.lit(0).cast(part if part in ("float", "double") else "double")).otherwise(x))
    marked = base.select("vec_id", F.when(good & (F.size("x") == dims), clean).alias("x"))
    classes = settle(marked.where("x is not null").groupBy("x").agg(F.min("vec_id").cast("long").alias("id"), F.count("*").alias("m")).select("id", "m", "x"), "graph-classes")
    n = classes.count()
    drawn = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x").toArrow()
    sample = _matrix(drawn.column("x").combine_chunks(), dims)
    k = int(max(1, min(SHARDS, n // SHARD, len(sample) // 4)))
    centroids = spark.sparkContext.broadcast(_centroids(sample, k))  # SHARDS rows at most
    overlap, beam, found = OVERLAP, BEAM, None
    for _ in range(3):
        more = _search(classes, dims, centroids, overlap, limit, beam)
        found = more if found is None else found.union(more)
        counts = settle(found.groupBy("id").agg(F.max("others").alias("others")), "graph-counts")
        recall, of_all = audit(classes, counts, dims, limit)
        if recall is None or min(recall, of_all) >= RECALL:
            break
        overlap, beam = 2 * overlap, 2 * beam
    centroids.destroy()
    if recall is not None and recall < LEAST:
        raise RuntimeError(f"the search found {recall:.3f} of the links of audited vectors, less than {LEAST}")
    labels = components(found.select(F.col("id").alias("u"), F.col("label").alias("v")))
    told = counts.join(labels, counts["id"] == labels["node"], "left").select("id", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("component", "id").alias("component"))
    of_class = classes.join(told, "id", "left").select("x", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = marked.join(of_class, "x", "left")
    lone = F.col("vec_id").cast("long")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", lone).alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        F.lit(None if recall is None else float(min(recall, of_all))).cast("double").alias("recall"),
    )
