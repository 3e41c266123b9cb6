"""Versioned key-value log: rows (seq, op, key, value), op 1 puts and op 2 deletes. The greatest seq of a key is newest."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quern.functions.hashing import LOW32, fnv64

PUT, DELETE = 1, 2
NEVER = (1 << 63) - 1
BOTTOM = 6  # deepest level; only a merge into it drops tombstones


def newest(log: DataFrame) -> DataFrame:
    """The newest version of each key, tombstones too. One shuffle, of one row for each key and task at most."""
    return log.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by(F.struct("op", "value"), "seq").alias("v")).select("key", "seq", "v.op", "v.value")


def live(log: DataFrame) -> DataFrame:
    return newest(log).where(F.col("op") == PUT).select("key", "seq", "value")


def tombstones(log: DataFrame) -> DataFrame:
    return newest(log).where(F.col("op") == DELETE).select("key", "seq")


def get(log: DataFrame, key: str) -> DataFrame:
    """(key, found, seq, op, value, raw): one row; the filter on key reaches the scan. raw: the value in base 64."""
    best = log.where(F.col("key") == key).agg(F.max("seq").alias("seq"), F.max_by("op", "seq").alias("op"), F.max_by("value", "seq").alias("value"))
    found = F.coalesce(F.col("op") == PUT, F.lit(False))
    return best.select(F.lit(key).alias("key"), found.alias("found"), "seq", "op", F.when(found, F.col("value")).alias("value"), F.when(found, F.base64(F.col("value").cast("binary"))).alias("raw"))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, found, value) for each row of keys(key)."""
    return keys.join(live(log), "key", "left").select("key", F.col("seq").isNotNull().alias("found"), "value")


def scan(log: DataFrame, low: str | None = None, high: str | None = None, prefix: str | None = None) -> DataFrame:
    """Live rows in key order: low <= key < high, and keys that begin with prefix."""
    for bound in ([F.col("key") >= low] if low is not None else []) + ([F.col("key") < high] if high is not None else []) + ([F.col("key").startswith(prefix)] if prefix is not None else []):
        log = log.where(bound)
    return live(log).orderBy("key")


def seek(log: DataFrame, key: str) -> DataFrame:
    """The first live row at or after key."""
    return scan(log, low=key).limit(1)


def versions(log: DataFrame, span: int = 1 << 16) -> DataFrame:
    """Every version with its number within the key, newest first.

    A key's versions are counted in spans of seq, so the versions of a key that holds a third of all rows are numbered
    by many tasks.
    """
    log = log.withColumn("_span", F.floor(F.col("seq") / span))
    later = Window.partitionBy("key").orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each span
    counts = log.groupBy("key", "_span").agg(F.count("*").alias("_n")).select("key", "_span", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("key", "_span").orderBy(F.desc("seq")))
    return log.withColumn("_i", inside).join(counts, ["key", "_span"]).withColumn("version", F.col("_base") + F.col("_i")).drop("_span", "_i", "_base")


def as_of(log: DataFrame, seq: Column | int) -> DataFrame:
    """Live rows as they were at seq."""
    return live(log.where(F.col("seq") <= seq))


def counts(log: DataFrame) -> DataFrame:
    """(versions, distinct_keys, live_keys)."""
    sizes = log.groupBy("key").agg(F.count("*").alias("n"), F.max_by("op", "seq").alias("op"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("versions"), F.count("*").alias("distinct_keys"), F.count(F.when(F.col("op") == PUT, 1)).alias("live_keys"))


def running_total(df: DataFrame, by: str, value: Column, block: int = 4096) -> DataFrame:
    """Adds `total`, the running sum of value in the order of the whole number `by`.

    It is summed within blocks of `by`, over the blocks of a group of `block` blocks, and over groups: so only one row
    for each block * block rows is ever in one task.
    """
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({"_v": value, "_block": F.floor(F.col(by) / block)})
    blocks = df.groupBy("_block").agg(F.sum("_v").alias("_s")).withColumn("_group", F.floor(F.col("_block") / block))
    groups = blocks.groupBy("_group").agg(F.sum("_s").alias("_s")).select("_group", F.coalesce(F.sum("_s").over(before("_group")), F.lit(0)).alias("_far"))
    near = F.coalesce(F.sum("_s").over(before("_group", "_block")), F.lit(0))
    sums = blocks.withColumn("_near", near).join(groups, "_group").select("_block", (F.col("_far") + F.col("_near")).alias("_base"))
    inside = Window.partitionBy("_block").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.join(sums, "_block").withColumn("total", F.col("_base") + F.sum("_v").over(inside)).drop("_v", "_block", "_base")


def assigned(writes: DataFrame, last_seq: int) -> DataFrame:
    """writes(n, op, key, value) with seq: last_seq + 1 and on, in the order of the distinct whole numbers n."""
    return running_total(writes, "n", F.lit(1).cast("bigint")).select((F.col("total") + last_seq).alias("seq"), "op", "key", F.when(F.col("op") == PUT, F.col("value")).alias("value"))


def last_seq(log: DataFrame) -> int:
    return log.agg(F.max("seq")).first()[0] or 0


def append(path: str, writes: DataFrame) -> DataFrame:
    """Puts (op 1) and deletes (op 2) of writes(n, op, key, value) go to the log at path in one commit; returns the whole log.

    One writer at a time: its numbers follow the greatest seq that the log holds.
    """
    spark = writes.sparkSession
    kinds = "seq bigint, op int, key string, value string"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    last = last_seq(spark.read.schema(kinds).parquet(path)) if there else 0
    plain = assigned(writes, last).select(F.col("seq").cast("bigint"), F.col("op").cast("int"), F.col("key").cast("string"), F.col("value").cast("string"))
    plain.write.mode("append").parquet(path)
    return spark.read.schema(kinds).parquet(path)


def entry_bytes(node: int = 64) -> Column:
    """What an entry takes in memory: key and value in steps of eight bytes, and a node."""
    aligned = lambda c: F.floor((F.octet_length(F.coalesce(c, F.lit(""))) + 7) / 8) * 8
    return (aligned(F.col("key")) + aligned(F.col("value")) + node).cast("bigint")


def generations(log: DataFrame, capacity: int, node: int = 64) -> DataFrame:
    """Adds generation: which memtable of `capacity` bytes an entry falls into (8-byte aligned key and value plus a node)."""
    size = entry_bytes(node)
    log = running_total(log.withColumn("bytes", size), "seq", size)
    return log.withColumn("generation", F.floor((F.col("total") - 1) / capacity).cast("bigint")).drop("total")


def flushed(log: DataFrame, capacity: int) -> DataFrame:
    """Metadata of the tables that memtable flushes write: one for each generation; the first id is 2."""
    g = generations(log, capacity)
    return g.groupBy("generation").agg(F.count("*").alias("entries"), F.min("key").alias("smallest"), F.max("key").alias("largest"), F.sum("bytes").alias("size")).select((F.col("generation") + 2).alias("id"), F.lit(0).alias("level"), "smallest", "largest", "entries", "size")


def write_sorted(log: DataFrame, path: str, files: int) -> None:
    """The log as key-ordered Parquet: row-group statistics and a Bloom filter then prune point and range reads."""
    log.repartitionByRange(files, "key").sortWithinPartitions("key", F.desc("seq")).write.option("parquet.bloom.filter.enabled#key", "true").parquet(path)


def needs_compaction(meta: DataFrame, files: int = 4, base: int = 10 << 20) -> DataFrame:
    """(level, files, bytes, limit_hit) by level: level 0 at `files` tables, level l of 1 to 5 over base * 10 ** (l - 1) bytes."""
    level = meta.groupBy("level").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    hit = F.when(F.col("level") == 0, F.col("files") >= files).when(F.col("level") < BOTTOM, F.col("bytes") > base * F.pow(F.lit(10.0), F.col("level") - 1)).otherwise(False)
    return level.withColumn("limit_hit", hit)


def _within(points: DataFrame, spans: DataFrame, pivots: int = 10_000, block: int = 256) -> DataFrame:
    """(point, span): points(point, at) and spans(span, low, high) with low <= at <= high.

    Some of the points, at most about `pivots`, picked by a hash, cut keys into cells. A point is in one cell, a span in all that it meets,
    each of which holds a point: so there are no more rows of spans than there are pairs, beside one a span. A cell's
    points are dealt over pieces of about `block`, so that no task has more pairs of a span than that.
    """
    step = -(-points.select("at").distinct().count() // pivots) or 1
    starts = sorted(r["at"].encode() for r in points.where(F.col("at").isNotNull() & (F.pmod(F.xxhash64("at"), F.lit(step)) == 0)).select("at").distinct().collect())

    def located(df: DataFrame, **columns: str) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            for b in batches:
                cells = [pa.array([bisect_right(starts, k.encode()) for k in b.column(c).to_pylist()], pa.int64()) for c in columns.values()]
                yield pa.RecordBatch.from_arrays([*b.columns, *cells], names=[*b.schema.names, *columns])

        schema = StructType([*df.schema.fields, *(StructField(c, LongType()) for c in columns)])
        return df.where(" and ".join(f"{c} is not null" for c in columns.values())).mapInArrow(run, schema)

    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given as a number, as few bytes here make many pairs
    own = located(points.select("point", "at"), cell="at")
    sizes = own.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    own = own.join(sizes, "cell").select("point", "at", "cell", F.pmod(F.xxhash64("point"), F.col("parts")).alias("part"))
    met = located(spans.select("span", "low", "high"), first="low", last="high").where("first <= last")
    met = met.select("span", "low", "high", F.explode(F.sequence("first", "last")).alias("cell")).join(sizes, "cell")
    met = met.select("span", "low", "high", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).repartition(tasks, "cell", "part")
    return met.join(own.repartition(tasks, "cell", "part"), ["cell", "part"]).where("low <= at and at <= high").select("point", "span")


def overlaps(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """Pairs of tables (id, other) whose key ranges meet: upper's against the level below. Metadata rows only.

    Two ranges meet where the lower one begins inside of the upper one, or the upper one inside of the lower one and after its start.
    """
    point = lambda df: df.select(F.col("id").alias("point"), F.col("smallest").alias("at"))
    span = lambda df: df.select(F.struct("id", "smallest").alias("span"), F.col("smallest").alias("low"), F.col("largest").alias("high"))
    inside = _within(point(lower), span(upper)).select(F.col("span.id").alias("id"), F.col("point").alias("other"))
    after = _within(upper.select(F.struct("id", "smallest").alias("point"), F.col("smallest").alias("at")), span(lower)).where("point.smallest > span.smallest")
    return inside.unionByName(after.select(F.col("point.id").alias("id"), F.col("span.id").alias("other")))


def level_to_compact(meta: DataFrame, files: int = 4, base: int = 10 << 20) -> DataFrame:
    """(needed, level), one row: the lowest level over its limit; level 0 with needed false if there is none."""
    hit = needs_compaction(meta, files, base).where("limit_hit").agg(F.min("level").alias("level"))
    return hit.select(F.col("level").isNotNull().alias("needed"), F.coalesce("level", F.lit(0)).cast("int").alias("level"))


def compact(log: DataFrame, target: int) -> DataFrame:
    """The merge of all versions into level `target`."""
    merged = newest(log)
    return merged.where(F.col("op") != DELETE) if target >= BOTTOM else merged


def compaction_inputs(meta: DataFrame, level: int) -> DataFrame:
    """The rows of meta that a compaction of `level` reads: its tables, and those of the next level in their whole key range."""
    span = meta.where(F.col("level") == level).agg(F.min("smallest").alias("_low"), F.max("largest").alias("_high"))  # one row
    near = (F.col("level") == level) | ((F.col("level") == level + 1) & (F.col("largest") >= F.col("_low")) & (F.col("smallest") <= F.col("_high")))
    return meta.join(F.broadcast(span), F.lit(True)).where(F.col("_low").isNotNull() & near).drop("_low", "_high")


def compact_level(meta: DataFrame, entries: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """meta(id, level, smallest, largest, entries, size) and entries(id, seq, op, key, value) after one compaction.

    The inputs' newest versions become one table of the next level with the next id; the inputs go, the other tables
    stay. Nothing changes at the deepest level, or where the level has no table.
    """
    inputs = compaction_inputs(meta, level).select("id")
    if level >= BOTTOM or not inputs.limit(1).count():
        return meta, entries
    new_id = meta.agg(F.max("id")).first()[0] + 1
    made = compact(entries.join(inputs, "id", "left_semi"), level + 1).select(F.lit(new_id).cast("bigint").alias("id"), "seq", "op", "key", "value")
    sums = [F.min("key").alias("smallest"), F.max("key").alias("largest"), F.count("*").alias("entries"), F.sum(entry_bytes()).alias("size")]
    row = made.groupBy("id").agg(*sums).select("id", F.lit(level + 1).alias("level"), "smallest", "largest", "entries", "size")
    return meta.join(inputs, "id", "left_anti").select(*row.columns).unionByName(row), entries.join(inputs, "id", "left_anti").select(*made.columns).unionByName(made)


def bloom_positions(keys: DataFrame, n_keys: int, bits_per_key: int = 10) -> DataFrame:
    """keys(key) to (key, bit): the bits of each key in a filter for n_keys keys."""
    bits = -(-max(64, n_keys * bits_per_key) // 8) * 8
    hashes = min(30, max(1, int(bits_per_key * 0.69)))
    h = keys.select("key", fnv64(F.col("key")).alias("h")).select("key", F.col("h.lo").alias("lo"), F.col("h.hi").alias("hi"))
    at = F.posexplode(F.array_repeat(F.struct("lo", "hi"), hashes)).alias("i", "h")
    return h.select("key", at).select("key", (((F.col("h.lo") + F.col("i") * F.col("h.hi")).bitwiseAND(F.lit(LOW32))) % bits).alias("bit"))


def may_contain(stored: DataFrame, probes: DataFrame, n_keys: int) -> DataFrame:
    """probes(key) to (key, may_contain) against the filter of stored(key)."""
    on = bloom_positions(stored, n_keys).select("bit").distinct().withColumn("on", F.lit(True))
    return bloom_positions(probes, n_keys).join(on, "bit", "left").groupBy("key").agg(F.bool_and(F.coalesce("on", F.lit(False))).alias("may_contain"))
