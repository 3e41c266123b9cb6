"""Sharding by a minimax contiguous partition over ordered atomic groups.

Equal texts share a checksum, and so always stay together. Texts are gathered by it into at most `cells` atomic groups;
in their order, the smallest shard capacity for which a greedy walk over their sizes
needs no more than n shards is found by binary search, and the cuts are made there. Search and walk run as array
functions over one bounded row, so nothing that grows with the corpus is ever in one place.

Slots number a shard's documents without gaps: an atomic group starts where the ones before it in its shard end, and
large groups are split by a hash of doc_id, so that no task numbers more than a few times the mean group.

All work is in built-in column functions. Two passes: one over texts (size, hash), the others over that thin table.

Defined results: a null text counts 0 bytes and is grouped with the empty text. Repeated rows get slots of their own;
rows with a null doc_id are numbered like others. A very long text is an atomic group of its own size. Other input
columns are ignored unless kept; a kept column named like one that this operator makes comes back as `doc_` and its
name. An empty table gives an empty result. With fewer atomic groups than shards, the last shards are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import written

OVERHEAD = 8  # bytes that a document takes besides its text
MADE = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _thin(cells: int) -> dict[str, Column]:
    text = F.coalesce("text", F.lit(""))
    crc = F.crc32(F.encode(text, "UTF-8"))
    return {"size": F.octet_length(text).cast("long") + OVERHEAD, "text_crc32": crc, "cell": (crc % cells).cast("int")}


def cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """groups(cell, bytes), bounded: the smallest feasible capacity, and the first cell of each shard."""
    row = groups.agg(F.sort_array(F.collect_list(F.struct("cell", "bytes"))).alias("g"), F.max("bytes").alias("most"), F.sum("bytes").alias("total"))
    # a shard takes groups while they fit; `n` shards have been opened so far
    needed = "aggregate(g, struct(0L as load, 1 as n), (s, x) -> if(s.load + x.bytes > {cap}, struct(x.bytes as load, s.n + 1 as n), struct(s.load + x.bytes as load, s.n as n)), s -> s.n)"
    mid = "((b.lo + b.hi) div 2)"
    search = f"aggregate(sequence(1, 63), struct(most as lo, total as hi), (b, i) -> if(b.lo >= b.hi, b, if({needed.format(cap=mid)} <= {shards}, struct(b.lo as lo, {mid} as hi), struct({mid} + 1 as lo, b.hi as hi))), b -> b.hi)"
    walk = "aggregate(g, struct(0L as load, cast(array() as array<int>) as at), (s, x) -> if(size(s.at) = 0 or s.load + x.bytes > cap, struct(x.bytes as load, array_append(s.at, x.cell) as at), struct(s.load + x.bytes as load, s.at as at)), s -> s.at)"
    got = row.where("total is not null").select("g", F.expr(search).alias("cap")).select("cap", F.expr(walk).alias("at")).first()
    return (got["cap"], got["at"]) if got else (0, [])


def shard(docs: DataFrame, shards: int = 24, cells: int = 1 << 14, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text) to doc_id, the columns in `keep`, size, text_crc32, law, shard, slot and grown_shard.

    cells bounds the atomic groups. keep: input columns to carry to the shards, such as the text.
    """
    made = _thin(cells)
    thin = written(docs.select("doc_id", *(c.alias(k) for k, c in made.items())), "sizes")
    groups = written(thin.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).coalesce(1), "cells")
    _, first = cuts(groups, shards)
    at = F.array(*(F.lit(c) for c in first)).cast("array<int>")
    rows = groups.agg(F.sum("rows")).first()[0] or 0
    # at most `cells` groups, of which those above 4 times the mean are split: at most 1.25 * cells + 1 parts
    most = max(1, 4 * -(-rows // cells))
    groups = groups.select("cell", F.size(F.filter(at, lambda c: c <= F.col("cell"))).alias("shard"), F.ceil(F.col("rows") / most).alias("n_parts"))
    groups = groups.withColumn("shard", F.col("shard") - 1)

    scattered = F.pmod(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), F.lit(1 << 31)) * 48271 % 2147483647

    def split(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(groups), "cell").withColumn("part", scattered % F.col("n_parts")).drop("n_parts")

    before = Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = split(thin).groupBy("shard", "cell", "part").count().select("cell", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    full = split(docs.select("doc_id", F.struct(*keep).alias("_kept"), *(c.alias(k) for k, c in made.items())) if keep else thin)
    within = Window.partitionBy("cell", "part").orderBy("text_crc32", "size", "doc_id")
    numbered = full.withColumn("place", F.row_number().over(within)).join(F.broadcast(starts), ["cell", "part"])
    return numbered.select(
        "doc_id", *(F.col("_kept")[c].alias(f"doc_{c}" if c in MADE else c) for c in keep), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
