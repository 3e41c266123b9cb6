"""Product quantization. A codebook is (m, c, centroid): `centroids` points for each of `parts` sub-spaces."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.distance import l2
from quern.operators.vector import checked, matrix, query_blocks, ranked, tops


def sub_vectors(vectors: DataFrame, parts: int, dim: int) -> DataFrame:
    """vectors(vec_id, embedding) to (vec_id, m, sub)."""
    if dim % parts:
        raise ValueError("the dimension must be a multiple of the number of parts")
    width = dim // parts
    cut = F.array(*(F.transform(F.slice("embedding", m * width + 1, width), lambda x: x.cast("double")) for m in range(parts)))
    return vectors.where(F.size("embedding") == dim).select("vec_id", F.posexplode(cut).alias("m", "sub"))


def seeds(vectors: DataFrame, parts: int, dim: int, centroids: int = 256) -> DataFrame:
    """The codebook made of the vectors with the least ids; fewer vectors than centroids are an error."""
    first = vectors.orderBy("vec_id").limit(centroids)
    if first.count() < centroids:
        raise ValueError(f"training needs at least {centroids} vectors")
    c = F.row_number().over(Window.partitionBy("m").orderBy("vec_id")) - 1
    return sub_vectors(first, parts, dim).select("m", c.alias("c"), F.col("sub").alias("centroid"))


def assign(subs: DataFrame, codebook: DataFrame) -> DataFrame:
    """(vec_id, m, sub, c, d): the nearest centroid of each sub-vector, the first one on ties.

    A codebook is bounded (at most 256 centroids a part), so it travels with the tasks and numpy compares in blocks.
    """
    rows = codebook.orderBy("m", "c").toArrow().to_pylist()  # `centroids` rows a part
    books: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for m in {r["m"] for r in rows}:
        own = [r for r in rows if r["m"] == m]
        books[m] = np.array([r["c"] for r in own]), np.array([r["centroid"] for r in own], float)

    def run(batches):
        import pyarrow as pa

        for b in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            at, x = np.array(b.column("m").to_pylist()), np.array(b.column("sub").to_pylist(), float)
            c, d = np.zeros(len(at), int), np.zeros(len(at))
            for m, (numbers, points) in books.items():
                if len(own := np.flatnonzero(at == m)):
                    far = np.sqrt(((x[own][:, None, :] - points) ** 2).sum(axis=2))
                    near = far.round(9).argmin(axis=1)
                    c[own], d[own] = numbers[near], far[np.arange(len(own)), near]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("vec_id", "m", "sub")), pa.array(c, pa.int32()), pa.array(d, pa.float64())], names=["vec_id", "m", "sub", "c", "d"])

    return subs.select(F.col("vec_id").cast("bigint"), "m", "sub").mapInArrow(run, "vec_id bigint, m int, sub array<double>, c int, d double")


def lloyd_step(subs: DataFrame, codebook: DataFrame) -> DataFrame:
    """One round of k-means in every part; a centroid without members stays."""
    owned = assign(subs, codebook)
    means = owned.select("m", "c", F.posexplode("sub").alias("i", "x")).groupBy("m", "c", "i").agg(F.avg("x").alias("x"))
    means = means.groupBy("m", "c").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    return codebook.join(means, ["m", "c"], "left").select("m", "c", F.coalesce("mean", "centroid").alias("centroid"))


def train(vectors: DataFrame, parts: int = 8, dim: int = 64, centroids: int = 256, rounds: int = 25) -> DataFrame:
    """Rounds of lloyd_step until nothing moves. Between rounds the codebook, at most `centroids` rows a part, is in the driver."""
    subs = sub_vectors(vectors, parts, dim)
    book = seeds(vectors, parts, dim, centroids)
    rows = book.orderBy("m", "c").collect()
    for _ in range(rounds):
        after = lloyd_step(subs, book).orderBy("m", "c").collect()
        moved = after != rows
        rows, book = after, vectors.sparkSession.createDataFrame(after, "m int, c int, centroid array<double>")
        if not moved:
            break
    return book


def points(codebook: DataFrame) -> dict[int, np.ndarray]:
    """The centroids of each part, in the order of their numbers: at most `centroids` rows a part."""
    out: dict[int, list] = {}
    for r in codebook.orderBy("m", "c").collect():
        out.setdefault(r["m"], []).append(r["centroid"])
    return {m: np.array(p, float) for m, p in out.items()}


def encode(vectors: DataFrame, codebook: DataFrame, parts: int = 8, dim: int = 64) -> DataFrame:
    """(vec_id, codes): one centroid number for each part."""
    owned = assign(sub_vectors(vectors, parts, dim), codebook)
    return owned.groupBy("vec_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("m", "c"))), lambda s: s["c"]).alias("codes"))


def distance_table(queries: DataFrame, codebook: DataFrame, parts: int = 8, dim: int = 64) -> DataFrame:
    """queries(query_id, embedding) to (query_id, m, c, d)."""
    subs = sub_vectors(queries.withColumnRenamed("query_id", "vec_id"), parts, dim)
    return subs.join(F.broadcast(codebook), "m").select(F.col("vec_id").alias("query_id"), "m", "c", l2(F.col("sub"), F.col("centroid")).alias("d"))  # a codebook has at most `centroids` rows a part


def adc(queries: DataFrame, codebook: DataFrame, codes: DataFrame, k: int, parts: int = 8, dim: int = 64) -> DataFrame:
    """The k nearest by the sum over parts of unsquared distances: (query_id, vec_id, distance, rank).

    A block of queries' distance tables travels with the tasks, which look codes up and keep their best k.
    """
    book, width = points(codebook), dim // parts

    def found(ids, q):
        table = np.stack([np.sqrt(((q[:, None, m * width : (m + 1) * width] - book[m]) ** 2).sum(axis=2)) for m in range(parts)], axis=1)

        def score(b):
            code = matrix(b.column("codes"), parts).astype(np.int64)
            d = table[:, 0, code[:, 0]]
            for m in range(1, parts):
                d += table[:, m, code[:, m]]
            return d

        return tops(codes.select(F.col("vec_id").cast("bigint"), "codes"), ids, score, k)

    blocks = query_blocks(checked(queries, dim)[0], dim)
    return ranked(reduce(DataFrame.unionByName, (found(*block) for block in blocks)), k)
