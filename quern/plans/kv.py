"""Key-value queries. The log is `events`: one version of a user's key for each event, deleted by errors."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import kv
from quern.plans.registry import query, shared_dir, stored, table
from quern.sources import table_file, wal

KV = """kv AS (SELECT event_id AS seq, 'user:' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op, props AS value FROM events)"""
NEWEST = f"WITH {KV}, newest AS (SELECT key, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM kv GROUP BY key)"
CAPACITY = 16384


def log(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"), F.when(F.col("event_type") == "error", 2).otherwise(1).alias("op"), F.col("props").alias("value"))


def big_log(spark, d):
    """A version of an order's key for each of its lines, deleted by returned ones; seq counts within the order."""
    x = table(spark, d, "lineitem")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return x.select(F.col("l_orderkey").cast("string").alias("key"), seq.alias("seq"), F.when(F.col("l_returnflag") == "R", 2).otherwise(1).alias("op"), F.col("l_extendedprice").alias("value"))


@query(f"{NEWEST} SELECT key, seq, value FROM newest WHERE op = 1")
def kv_latest(spark, d):
    return kv.live(log(spark, d))


BIG = "big AS (SELECT row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, CAST(l_orderkey AS VARCHAR) AS key, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS op, l_extendedprice AS value FROM lineitem)"


@query(f"WITH {BIG} SELECT * FROM (SELECT key, max(seq) AS seq, arg_max(value, seq) AS value, arg_max(op, seq) AS op FROM big GROUP BY key) WHERE op = 1")
def kv_latest_large(spark, d):
    return kv.newest(big_log(spark, d)).where("op = 1")


@query(f"WITH {KV} SELECT 'user:000007' AS key, coalesce(arg_max(op, seq) = 1, false) AS found, max(seq) AS seq, arg_max(op, seq) AS op, CASE WHEN arg_max(op, seq) = 1 THEN arg_max(value, seq) END AS value, CASE WHEN arg_max(op, seq) = 1 THEN to_base64(encode(arg_max(value, seq))) END AS raw FROM kv WHERE key = 'user:000007'")
def kv_point_get(spark, d):
    return kv.get(log(spark, d), "user:000007")


@query(f"{NEWEST} SELECT k.key, n.key IS NOT NULL AS found, n.value FROM (SELECT 'user:' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS key FROM customer) k LEFT JOIN (SELECT * FROM newest WHERE op = 1) n USING (key)")
def kv_multi_get(spark, d):
    keys = table(spark, d, "customer").select(F.concat(F.lit("user:"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("key"))
    return kv.multi_get(log(spark, d), keys)


@query(f"{NEWEST} SELECT key, seq FROM newest WHERE op = 2")
def kv_tombstones(spark, d):
    return kv.tombstones(log(spark, d))


@query(f"{NEWEST} SELECT key, seq, value FROM newest WHERE op = 1 AND key >= 'user:000020' AND key < 'user:000090'")
def kv_range_scan(spark, d):
    return kv.scan(log(spark, d), "user:000020", "user:000090")


@query(f"{NEWEST} SELECT key, seq, value FROM newest WHERE op = 1 AND starts_with(key, 'user:00001')")
def kv_prefix_scan(spark, d):
    return kv.scan(log(spark, d), prefix="user:00001")


@query(f"{NEWEST} SELECT key, seq, value FROM newest WHERE op = 1 AND key >= 'user:000042' ORDER BY key LIMIT 1")
def kv_seek(spark, d):
    return kv.seek(log(spark, d), "user:000042")


@query(f"WITH {KV} SELECT key, seq, op, value, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS version FROM kv")
def kv_versions(spark, d):
    return kv.versions(log(spark, d)).select("key", "seq", "op", "value", "version")


@query(f"WITH {KV} SELECT key, seq, value FROM (SELECT key, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM kv WHERE seq <= 400 GROUP BY key) WHERE op = 1")
def kv_as_of_seq(spark, d):
    return kv.as_of(log(spark, d), 400)


@query(f"{NEWEST} SELECT (SELECT count(*) FROM kv) AS versions, count(*) AS distinct_keys, count(*) FILTER (op = 1) AS live_keys FROM newest")
def kv_counts(spark, d):
    return kv.counts(log(spark, d))


GENERATIONS = f"""WITH {KV}, sized AS (SELECT *, (octet_length(encode(key)) + 7) // 8 * 8 + (octet_length(encode(coalesce(value, ''))) + 7) // 8 * 8 + 64 AS bytes FROM kv),
gen AS (SELECT *, CAST((sum(bytes) OVER (ORDER BY seq) - 1) // {CAPACITY} AS BIGINT) AS generation FROM sized),
meta AS (SELECT generation + 2 AS id, CAST(0 AS INTEGER) AS level, min(key) AS smallest, max(key) AS largest, count(*) AS entries, CAST(sum(bytes) AS BIGINT) AS size FROM gen GROUP BY generation)"""


@query(f"{GENERATIONS} SELECT seq, key, CAST(bytes AS BIGINT) AS bytes, generation FROM gen")
def memtable_rotation(spark, d):
    return kv.generations(log(spark, d), CAPACITY).select("seq", "key", "bytes", "generation")


@query(f"{GENERATIONS} SELECT * FROM meta")
def sst_metadata(spark, d):
    return kv.flushed(log(spark, d), CAPACITY)


@query(f"{GENERATIONS} SELECT level, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CASE WHEN level = 0 THEN count(*) >= 4 WHEN level < 6 THEN sum(size) > 10485760 * pow(10.0, level - 1) ELSE false END AS limit_hit FROM (SELECT CAST(least(id - 2, 3) AS INTEGER) AS level, size FROM meta) GROUP BY level")
def compaction_trigger(spark, d):
    meta = kv.flushed(log(spark, d), CAPACITY)
    return kv.needs_compaction(meta.select(F.least(F.col("id") - 2, F.lit(3)).cast("int").alias("level"), "size"))


@query(f"{GENERATIONS} SELECT u.id, l.id AS other FROM meta u JOIN meta l ON u.id % 2 = 0 AND l.id % 2 = 1 AND l.largest >= u.smallest AND l.smallest <= u.largest")
def compaction_overlap(spark, d):
    """Even tables stand for one level, odd ones for the level below."""
    meta = stored(kv.flushed(log(spark, d), CAPACITY), "tables")
    return kv.overlaps(meta.where("id % 2 = 0"), meta.where("id % 2 = 1"))


@query(f"{NEWEST} SELECT key, seq, op, value FROM newest")
def compaction_merge(spark, d):
    return kv.compact(log(spark, d), 1)


@query(f"{NEWEST} SELECT key, seq, op, value FROM newest WHERE op <> 2")
def compaction_bottom_level(spark, d):
    return kv.compact(log(spark, d), kv.BOTTOM)


FNV64 = "list_reduce(list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substr(key, CAST(i AS BIGINT), 1)) AS HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616, CAST(14695981039346656037 AS HUGEINT))"
POSITIONS = f"SELECT key, CAST(((h % 4294967296) + i * (h // 4294967296)) % 4294967296 % n.bits AS BIGINT) AS bit FROM (SELECT key, {FNV64} AS h FROM {{keys}}), (SELECT unnest(range(6)) AS i), n"


@query(f"""WITH {KV}, stored AS (SELECT DISTINCT key FROM kv), probes AS (SELECT 'user:' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS key FROM customer),
n AS (SELECT (greatest(64, count(*) * 10) + 7) // 8 * 8 AS bits FROM stored),
filled AS (SELECT DISTINCT bit FROM ({POSITIONS.format(keys="stored")}))
SELECT key, bool_and(f.bit IS NOT NULL) AS may_contain FROM ({POSITIONS.format(keys="probes")}) p LEFT JOIN filled f USING (bit) GROUP BY key""")
def bloom_probe(spark, d):
    stored = log(spark, d).select("key").distinct()
    probes = table(spark, d, "customer").select(F.concat(F.lit("user:"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("key"))
    return kv.may_contain(stored, probes, stored.count())


@query(f"{GENERATIONS}, lv AS (SELECT CAST(least(id - 2, 3) AS INTEGER) AS level, size FROM meta), hit AS (SELECT level FROM lv GROUP BY level HAVING CASE WHEN level = 0 THEN count(*) >= 1 ELSE sum(size) > 20000 * pow(10.0, level - 1) END) SELECT count(*) > 0 AS needed, CAST(coalesce(min(level) FILTER (level > 0), 0) AS INTEGER) AS level FROM hit WHERE level > 0")
def compaction_level(spark, d):
    """The one level to compact, among levels 1 to 3 with a small limit."""
    meta = kv.flushed(log(spark, d), CAPACITY).select(F.least(F.col("id") - 2, F.lit(3)).cast("int").alias("level"), "size")
    return kv.level_to_compact(meta.where("level > 0"), base=20000)


# Odd tables stand at level 0, the others at level 1, of which the last third keeps out of the way.
LEVELLED = f"{GENERATIONS}, tables AS (SELECT *, CASE WHEN id % 2 = 1 AND id < 9 THEN 0 WHEN id % 2 = 0 THEN 1 ELSE 2 END AS lv FROM meta), span AS (SELECT min(smallest) AS low, max(largest) AS high FROM tables WHERE lv = 0), ins AS (SELECT id FROM tables, span WHERE low IS NOT NULL AND (lv = 0 OR lv = 1 AND largest >= low AND smallest <= high)), made AS (SELECT key, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM gen WHERE generation + 2 IN (SELECT id FROM ins) GROUP BY key)"


def levelled(spark, d):
    entries = kv.generations(log(spark, d), CAPACITY).select((F.col("generation") + 2).alias("id"), "seq", "op", "key", "value")
    level = F.when((F.col("id") % 2 == 1) & (F.col("id") < 9), 0).when(F.col("id") % 2 == 0, 1).otherwise(2)
    return kv.flushed(log(spark, d), CAPACITY).withColumn("level", level), entries


@query(f"{LEVELLED} SELECT id, CAST(lv AS INTEGER) AS level, smallest, largest, entries, size FROM tables WHERE id NOT IN (SELECT id FROM ins) UNION ALL SELECT (SELECT max(id) + 1 FROM meta), 1, min(key), max(key), count(*), CAST(sum((octet_length(encode(key)) + 7) // 8 * 8 + (octet_length(encode(coalesce(value, ''))) + 7) // 8 * 8 + 64) AS BIGINT) FROM made HAVING count(*) > 0")
def compaction_catalog(spark, d):
    """The tables after a compaction of level 0."""
    return kv.compact_level(*levelled(spark, d), 0)[0]


@query(f"{LEVELLED} SELECT generation + 2 AS id, seq, op, key, value FROM gen WHERE generation + 2 NOT IN (SELECT id FROM ins) UNION ALL SELECT (SELECT max(id) + 1 FROM meta), seq, op, key, value FROM made")
def compaction_unit(spark, d):
    """The entries of all tables after a compaction of level 0."""
    return kv.compact_level(*levelled(spark, d), 0)[1]


@query(f"WITH {KV}, two AS (SELECT n + k * (SELECT count(*) FROM kv) AS seq, op, key, CASE WHEN op = 1 THEN value END AS value FROM (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM kv), (SELECT unnest([0, 1]) AS k)) SELECT seq, op, key, value FROM two")
def kv_append(spark, d):
    """Two commits of the same writes to a new log: numbers go on where the log ends."""
    path = f"{shared_dir(spark)}/quern-log-{uuid.uuid4().hex}"
    writes = log(spark, d).withColumnRenamed("seq", "n")
    kv.append(path, writes)
    return kv.append(path, writes)


def as_text(df):
    return df.withColumns({c: F.col(c).cast("string") for c in ("key", "value")})


@query(f"WITH {KV} SELECT seq, op, key, coalesce(value, '') AS value, 25 + octet_length(encode(key)) + octet_length(encode(coalesce(value, ''))) AS record_bytes FROM kv")
def wal_roundtrip(spark, d):
    back = as_text(wal.decoded(wal.encoded(log(spark, d))))
    return back.select("seq", "op", "key", "value", (F.lit(25) + F.octet_length("key") + F.octet_length("value")).cast("long").alias("record_bytes"))


@query(f"WITH {KV} SELECT seq, op, key, coalesce(value, '') AS value FROM kv")
def wal_padded(spark, d):
    """Log files of a thousand records, in batches of 1 to 60 that are each filled up to whole pages."""
    batch = F.floor(F.col("seq") / (1 + F.floor(F.col("seq") / 1000) % 60))
    return as_text(wal.decoded(wal.batches(log(spark, d), batch, F.floor(F.col("seq") / 1000)), "data"))


@query("SELECT count(*) AS records, max(event_id) AS max_seq FROM events")
def wal_recover_stats(spark, d):
    return wal.decoded(wal.encoded(log(spark, d))).agg(F.count("*").alias("records"), F.max("seq").alias("max_seq"))


def table_files(spark, d):
    return table_file.images(kv.generations(log(spark, d), CAPACITY).withColumn("id", F.col("generation") + 2))


@query(f"{GENERATIONS} SELECT generation + 2 AS id, seq, op, key, coalesce(value, '') AS value FROM gen")
def sst_scan(spark, d):
    """Every entry of the tables that flushes write, from the files' bytes."""
    return as_text(table_file.scanned(table_files(spark, d)))


@query(f"{GENERATIONS} SELECT generation + 2 AS id, max(seq) AS seq, arg_max(op, seq) AS op, coalesce(arg_max(coalesce(value, ''), seq), '') AS value FROM gen WHERE key = 'user:000007' GROUP BY generation")
def sst_get(spark, d):
    """The newest entry of one key in each table that holds it, from the files' bytes."""
    return table_file.looked_up(table_files(spark, d), b"user:000007").withColumn("value", F.col("value").cast("string"))
