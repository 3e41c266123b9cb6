"""Nearest neighbours: exact in numpy blocks, by inverted lists of codes, by random-hyperplane sketches and over layered graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.hashing import fnv32

QUERY_BLOCK = 2_000  # query vectors that one pass over the data compares; more queries make more passes


def checked(vectors: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rejected vectors are null, of another length, or hold a null."""
    good = F.coalesce((F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull()), F.lit(False))
    return vectors.where(good), vectors.where(~good)


def distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if metric == "dot":
        return -(q @ x.T)
    if metric == "cosine":
        norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)
        return np.where(norms == 0, 1.0, 1 - (q @ x.T) / np.where(norms == 0, 1, norms))
    return np.sqrt(np.stack([((x - v) ** 2).sum(axis=1) for v in q])) if len(q) else np.empty((0, len(x)))


def dimension(queries: DataFrame) -> int:
    """The length of the first query's vector, by query_id; 0 without one."""
    return queries.where(F.size("embedding") > 0).agg(F.min_by(F.size("embedding"), "query_id")).first()[0] or 0


def query_blocks(queries: DataFrame, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of queries(query_id, embedding), at most about QUERY_BLOCK at a time; one empty block without any."""
    parts = -(-queries.count() // QUERY_BLOCK) or 1
    for part in range(parts):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).select("query_id", "embedding").toArrow().to_pylist()  # a block of queries
        yield np.array([r["query_id"] for r in own], np.int64), np.array([r["embedding"] for r in own], float).reshape(-1, dim)


def matrix(column, dim: int) -> np.ndarray:
    """An Arrow column of lists of dim numbers, none of them null, as rows."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dim)


class Best:
    """The k rows of the least distance for each query, of all the rows shown so far; equal ones (to 9 places) by id."""

    def __init__(self, n: int, k: int):
        self.k, self.cut = k, np.full(n, np.inf)  # cut: the k-th distance so far
        self.held: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        self.fresh = 0

    def limits(self, d: np.ndarray, slack: np.ndarray | None = None) -> np.ndarray:
        """What a row of d (queries, rows) must not exceed to matter: by the k-th distance so far, or that of d where there is none.

        With slack, d holds squares that are at most so far off.
        """
        kth, bare = self.cut.copy(), np.flatnonzero(np.isinf(self.cut))
        if self.k < d.shape[1] and len(bare):
            own = np.partition(d[bare], self.k - 1, axis=1)[:, self.k - 1]
            kth[bare] = own if slack is None else np.sqrt(np.maximum(own + slack[bare], 0))
        return kth + 1e-9 if slack is None else (kth + 1e-9) ** 2 + slack

    def add(self, query: np.ndarray, row: np.ndarray, d: np.ndarray) -> None:
        good = np.isfinite(d)
        self.held.append((query[good], row[good], d[good]))
        self.fresh += int(good.sum())
        if self.fresh > max(20_000, len(self.cut) * self.k):
            self.cull()

    def cull(self) -> None:
        query, row, d = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((row, d.round(9), query))
        query, row, d = query[order], row[order], d[order]
        first = np.searchsorted(query, np.arange(len(self.cut)))
        keep = np.arange(len(query)) - first[query] < self.k
        self.held, self.fresh = [(query[keep], row[keep], d[keep])], 0
        last = first + self.k - 1
        full = np.flatnonzero(np.diff(np.append(first, len(query))) >= self.k)
        self.cut[full] = d[last[full]]

    def rows(self) -> tuple[np.ndarray, ...]:
        self.cull()
        return self.held[0]


CELLS = 1 << 20  # distances that a task works out at once


def tops(rows: DataFrame, ids: np.ndarray, score: Callable, k: int, exact: Callable | None = None) -> DataFrame:
    """rows(vec_id, ...) to (query_id, vec_id, distance): each task's k rows of the least score for each query.

    score makes a matrix (queries, rows) of an Arrow batch. So k rows for each query and task are shuffled, not all pairs.
    With exact(batch, query numbers, row numbers), which gives the distances, score gives (squares, slack): a
    square is at most slack off, and only rows that may be among the best get their distance.
    """

    def search(batches):
        import pyarrow as pa

        best, step = Best(len(ids), k), max(16, min(2048, CELLS // max(1, len(ids))))
        for b in (b.slice(i, step) for b in batches for i in range(0, b.num_rows if len(ids) and k > 0 else 0, step)):
            at = b.column("vec_id").to_numpy()
            if exact:
                d, slack = score(b)
                query, row = np.nonzero(d <= best.limits(d, slack)[:, None])
                best.add(query, at[row], exact(b, query, row))
            else:
                d = score(b)
                query, row = np.nonzero(d <= best.limits(d)[:, None])
                best.add(query, at[row], d[query, row])
        query, row, d = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(row), pa.array(d)], names=["query_id", "vec_id", "distance"])

    return rows.mapInArrow(search, "query_id bigint, vec_id bigint, distance double")


def _union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", dim: int | None = None) -> DataFrame:
    """queries(query_id, embedding) against vectors(vec_id, embedding): (query_id, vec_id, distance, rank).

    Vectors of another length than dim (that of the first query, if none is given) are left out. Each task keeps the
    best k of its own rows for each query. A block of queries travels with the tasks; blocks are dealt over passes.
    """
    dim = dim or dimension(queries)
    vectors, queries = checked(vectors, dim)[0].select(F.col("vec_id").cast("bigint"), "embedding"), checked(queries, dim)[0]

    def near(ids, q):
        if metric != "l2":
            return tops(vectors, ids, lambda b: distances(metric, q, matrix(b.column("embedding"), dim)), k)
        norms = (q**2).sum(axis=1)

        def squares(b):
            x = matrix(b.column("embedding"), dim)
            own = (x**2).sum(axis=1)
            return norms[:, None] - 2 * (q @ x.T) + own, 1e-12 * (norms + own.max())

        def exact(b, query, row):
            x, out = matrix(b.column("embedding"), dim), np.empty(len(query))
            for i in range(0, len(query), 8192):
                out[i : i + 8192] = ((x[row[i : i + 8192]] - q[query[i : i + 8192]]) ** 2).sum(axis=1)
            return np.sqrt(out)

        return tops(vectors, ids, squares, k, exact)

    found = (near(*block) for block in query_blocks(queries, dim))
    return ranked(_union(found), k)


def reranked(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, distance) -> DataFrame:
    """found(query_id, vec_id) with exact distances, to the best k of each query."""
    q = queries.select("query_id", F.col("embedding").alias("q"))
    both = found.select("query_id", "vec_id").join(vectors.select("vec_id", "embedding"), "vec_id").join(q, "query_id")
    return ranked(both.select("query_id", "vec_id", distance(F.col("q"), F.col("embedding")).alias("distance")), k)


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of each query's exact neighbours that were found."""
    hit = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id").withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return hit.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def levels(vectors: DataFrame, most: int = 16, m: int = 16) -> DataFrame:
    """(vec_id, level): geometric layers of a navigable graph, drawn from a hash of the id."""
    u = (fnv32(F.col("vec_id").cast("string")) + 0.5) / float(1 << 32)
    return vectors.select("vec_id", F.least(F.lit(most), F.floor(-F.log(u) / F.log(F.lit(float(m))))).cast("int").alias("level"))


def centroids(vectors: DataFrame, lists: int, train_rows: int = 20_000, rounds: int = 8, dim: int = 64) -> np.ndarray:
    """k-means on at most train_rows vectors, first by a hash of the id (a documented bound)."""
    some = checked(vectors, dim)[0].orderBy(F.xxhash64("vec_id"), "vec_id").limit(train_rows).select("embedding").toArrow()
    x = np.array(some.column("embedding").to_pylist(), float).reshape(-1, dim)
    c = x[:lists].copy()
    for _ in range(rounds):
        near = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).argmin(axis=1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(axis=0)
    return c


def ivf(codes: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, c: np.ndarray, probes: int, book: dict[int, np.ndarray], distance, rerank: int = 200) -> DataFrame:
    """Approximate kNN by inverted lists and compressed vectors.

    codes(vec_id, list, codes) is the index: each vector's nearest list, and its code in every part. A query looks into
    `probes` lists, adds up distances to codes from its own table, and gets exact distances of the `rerank` closest: so
    vectors themselves are read for `rerank` rows a query. book: the centroids of each part, by number.
    """
    dim = c.shape[1]
    width = dim // len(book)
    asked = checked(queries, dim)[0]

    def found(ids, q):
        table = np.stack([((q[:, None, m * width : (m + 1) * width] - points) ** 2).sum(axis=2) for m, points in sorted(book.items())], axis=1) if len(q) else np.zeros((0, len(book), 1))
        near = np.argsort((c**2).sum(1) - 2 * q @ c.T, axis=1)[:, :probes]
        open_lists = np.zeros((len(q), len(c)), bool)
        open_lists[np.arange(len(q))[:, None], near] = True

        def score(b):
            code = matrix(b.column("codes"), len(book)).astype(np.int64)
            d = table[:, 0, code[:, 0]]
            for m in range(1, len(book)):
                d += table[:, m, code[:, m]]
            return np.where(open_lists[:, b.column("list").to_numpy()], d, np.inf)

        return tops(codes, ids, score, rerank)

    best = ranked(_union(found(*block) for block in query_blocks(asked, dim)), rerank)
    return reranked(best, vectors, asked, k, distance)


def listed(vectors: DataFrame, c: np.ndarray) -> DataFrame:
    """vectors(vec_id, embedding) to (vec_id, list): the nearest of the centroids c."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = matrix(b.column("embedding"), c.shape[1])
            near = ((c**2).sum(1) - 2 * x @ c.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(near.astype(np.int32))], names=["vec_id", "list"])

    return checked(vectors, c.shape[1])[0].select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(run, "vec_id bigint, list int")


def sketches(vectors: DataFrame, id_col: str, bits: int = 256, dim: int = 64, seed: int = 7) -> DataFrame:
    """(id_col, sketch): signs of `bits` random projections, eight to a byte."""
    w = np.random.Generator(np.random.PCG64(seed)).standard_normal((dim, bits))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = matrix(b.column("embedding"), dim)
            packed = np.packbits(x @ w > 0, axis=1)
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array([r.tobytes() for r in packed], pa.binary())], names=[id_col, "sketch"])

    return checked(vectors, dim)[0].select(F.col(id_col).cast("bigint"), "embedding").mapInArrow(run, f"{id_col} bigint, sketch binary")


def lsh(index: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, distance, bits: int = 256, dim: int = 64, rerank: int = 200) -> DataFrame:
    """Approximate kNN by random hyperplanes: index is sketches(vectors, "vec_id").

    The `rerank` rows whose sketches differ least from a query's get exact distances. Sketches are compared in blocks
    inside tasks, so there are no buckets that could be hot, and no pairs.
    """
    asked = checked(queries, dim)[0]
    w = np.random.Generator(np.random.PCG64(7)).standard_normal((dim, bits))

    def found(ids, q):
        own = np.packbits(q @ w > 0, axis=1).view(np.uint64)

        def score(b):
            x = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(-1, bits // 8).view(np.uint64)
            d = np.zeros((len(own), len(x)), np.uint16)
            for i in range(bits // 64):
                d += np.bitwise_count(own[:, i, None] ^ x[:, i])
            return d.astype(float)

        return tops(index, ids, score, rerank)

    best = ranked(_union(found(*block) for block in query_blocks(asked, dim)), rerank)
    return reranked(best, vectors, asked, k, distance)


def cell_graph(cells: DataFrame, m: int, metric: str = "l2", block: int = 2048) -> DataFrame:
    """cells(vec_id, embedding, cell) to (query_id, vec_id, distance, rank): the m nearest of each node within its cell.

    A cell is cut into blocks by a hash, and each pair of blocks is one task's work, of which m rows for each node leave.
    """
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("_parts"))
    at = cells.join(sizes, "cell").withColumn("_part", F.pmod(F.xxhash64("vec_id"), F.col("_parts")))
    at = at.select(F.col("vec_id").cast("bigint"), "embedding", "cell", "_part", F.explode(F.expr("transform(sequence(0, _parts - 1), j -> struct(_part as x, j as y, 'a' as side))")).alias("p"))
    both = at.select("vec_id", "embedding", "cell", "p.x", "p.y", "p.side").unionByName(at.select("vec_id", "embedding", "cell", F.col("p.y").alias("x"), F.col("p.x").alias("y"), F.lit("b").alias("side")))

    def near(t):
        import pyarrow as pa

        side = np.array(t.column("side").to_pylist())
        ids, x = np.array(t.column("vec_id").to_pylist(), np.int64), np.array(t.column("embedding").to_pylist(), float)
        a, b = np.flatnonzero(side == "a"), np.flatnonzero(side == "b")
        d = distances(metric, x[a], x[b]) if len(a) and len(b) else np.zeros((len(a), len(b)))
        d[ids[a][:, None] == ids[b][None, :]] = np.inf
        order = np.lexsort((np.broadcast_to(ids[b], d.shape), d.round(9)), axis=-1)[:, :m]
        columns = [np.repeat(ids[a], order.shape[1]), ids[b][order].ravel(), np.take_along_axis(d, order, 1).ravel()]
        good = np.isfinite(columns[2])
        return pa.table({n: pa.array(c[good]) for n, c in zip(("query_id", "vec_id", "distance"), columns, strict=True)})

    return ranked(both.groupBy("cell", "x", "y").applyInArrow(near, "query_id bigint, vec_id bigint, distance double"), m)


@dataclass
class Graph:
    """A navigable graph in layers. links[i][l]: the neighbours of node i in layer l, at most m (2 * m in layer 0)."""

    x: np.ndarray
    metric: str = "l2"
    m: int = 16
    ef_build: int = 128
    links: list[list[list[int]]] = field(default_factory=list)
    entry: int = -1
    seen: int = 0
    between: list[list[float]] | None = None  # all distances between nodes, for building a small graph

    def far(self, q: np.ndarray | int, nodes: list[int]) -> list[float]:
        """Distances of a vector, or of a node while the graph is built, to nodes."""
        self.seen += len(nodes)
        if isinstance(q, int):
            if self.between is not None:
                own = self.between[q]
                return [own[j] for j in nodes]
            q = self.x[q]
        return distances(self.metric, q[None], self.x[nodes])[0].tolist()

    def walk(self, q: np.ndarray | int, start: list[tuple[float, int]], ef: int, layer: int) -> list[tuple[float, int]]:
        """The ef closest that a best-first search finds from `start`, closest first."""
        seen = {i for _, i in start}
        ahead, best = sorted(start), sorted((-d, i) for d, i in start)
        heapify(ahead)
        heapify(best)
        while ahead:
            d, i = heappop(ahead)
            if len(best) >= ef and d > -best[0][0]:
                break
            fresh = [j for j in self.links[i][layer] if j not in seen]
            seen.update(fresh)
            for e, j in zip(self.far(q, fresh), fresh, strict=True) if fresh else ():
                if len(best) < ef or e < -best[0][0]:
                    heappush(ahead, (e, j))
                    heappush(best, (-e, j))
                    if len(best) > ef:
                        heappop(best)
        return sorted((-d, i) for d, i in best)

    def descend(self, q: np.ndarray | int, layer: int) -> list[tuple[float, int]]:
        """From the entry down to above `layer`, always to the closest neighbour."""
        at = [(self.far(q, [self.entry])[0], self.entry)]
        for above in range(len(self.links[self.entry]) - 1, layer, -1):
            at = self.walk(q, at, 1, above)
        return at

    def insert(self, i: int, level: int) -> None:
        """Node i (the next one) joins layers 0 to level: linked to its m closest there, and they to it; links over the limit go."""
        self.links.append([[] for _ in range(level + 1)])
        if self.entry < 0:
            self.entry = i
            return
        top = len(self.links[self.entry]) - 1
        at = self.descend(i, min(level, top))
        for layer in range(min(level, top), -1, -1):
            at = self.walk(i, at, self.ef_build, layer)
            most = self.m if layer else 2 * self.m
            self.links[i][layer] = [j for _, j in at[:most]]
            for _, j in at[:most]:
                own = self.links[j][layer]
                own.append(i)
                if len(own) > most:
                    self.links[j][layer] = [n for _, n in sorted(zip(self.far(j, own), own, strict=True))[:most]]
        if level > top:
            self.entry = i

    def search(self, q: np.ndarray, k: int, ef: int = 64) -> list[tuple[float, int]]:
        return self.walk(q, self.descend(q, 0), max(ef, k), 0)[:k] if self.entry >= 0 and k > 0 else []


KNOWN = 1_500  # nodes of a graph whose distances are all worked out before it is built (80 MB)
HNSW = "shard int, vec_id bigint, embedding array<double>, place int, links array<array<bigint>>, entry boolean"


def hnsw(vectors: DataFrame, dim: int = 64, metric: str = "l2", m: int = 16, ef_build: int = 128, shard_rows: int = 20_000) -> DataFrame:
    """vectors(vec_id, embedding) to stored graphs: rows (shard, vec_id, embedding, place, links by layer, entry).

    Vectors are dealt to shards of about shard_rows by a hash, and each shard is one graph, built in one task by
    insertion in a hashed order; levels are drawn from a hash of the id. A search asks every shard.
    """
    good = checked(vectors, dim)[0]
    shards = max(1, -(-good.count() // shard_rows))
    drawn = good.join(levels(good, m=m), "vec_id").select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"), "level", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.xxhash64("vec_id", F.lit(1)).alias("turn"))

    def build(key, t):
        import pyarrow as pa

        rows = t.sort_by([("turn", "ascending"), ("vec_id", "ascending")])
        ids = rows.column("vec_id").to_pylist()
        g = Graph(np.array(rows.column("embedding").to_pylist(), float).reshape(-1, dim), metric, m, ef_build)
        if len(ids) <= KNOWN:
            g.between = distances(metric, g.x, g.x).tolist()
        for i, level in enumerate(rows.column("level").to_pylist()):
            g.insert(i, level)
        links = [[[ids[j] for j in layer] for layer in own] for own in g.links]
        return pa.table({"shard": pa.array([key[0].as_py()] * len(ids), pa.int32()), "vec_id": rows.column("vec_id"), "embedding": rows.column("embedding"), "place": pa.array(range(len(ids)), pa.int32()), "links": pa.array(links, pa.list_(pa.list_(pa.int64()))), "entry": pa.array([i == g.entry for i in range(len(ids))])})

    return drawn.groupBy("shard").applyInArrow(build, HNSW)


def hnsw_search(graphs: DataFrame, queries: DataFrame, k: int, dim: int = 64, metric: str = "l2", ef: int = 64) -> tuple[DataFrame, DataFrame]:
    """(found, work): the k closest by descent and beam search in every shard's graph; work(query_id, compared): rows compared."""
    asked = checked(queries, dim)[0]

    def found(qids, q):
        def run(key, t):
            import pyarrow as pa

            rows = t.sort_by("place")
            ids = rows.column("vec_id").to_pylist()
            at = {v: i for i, v in enumerate(ids)}
            g = Graph(np.array(rows.column("embedding").to_pylist(), float).reshape(-1, dim), metric)
            g.links = [[[at[j] for j in layer] for layer in own] for own in rows.column("links").to_pylist()]
            g.entry = rows.column("entry").to_pylist().index(True)
            out = []
            for i, v in zip(qids.tolist(), q, strict=True):
                g.seen = 0
                hits = g.search(v, k, ef)
                out += [(i, ids[j], d, g.seen if n == 0 else 0) for n, (d, j) in enumerate(hits)]
            return pa.table({"query_id": pa.array([r[0] for r in out], pa.int64()), "vec_id": pa.array([r[1] for r in out], pa.int64()), "distance": pa.array([r[2] for r in out], pa.float64()), "compared": pa.array([r[3] for r in out], pa.int64())})

        return graphs.groupBy("shard").applyInArrow(run, "query_id bigint, vec_id bigint, distance double, compared bigint")

    every = _union(found(*block) for block in query_blocks(asked, dim))
    return ranked(every.drop("compared"), k), every.groupBy("query_id").agg(F.sum("compared").alias("compared"))
