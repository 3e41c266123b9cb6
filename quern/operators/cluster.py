"""Cluster metadata as tables: key ranges, node liveness, and the rules of a replicated log."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quern.operators.kv import running_total


def holds(key: Column, start: Column, end: Column) -> Column:
    """start <= key < end, where an empty end is open."""
    return (key >= start) & ((end == "") | (key < end))


def initial_range() -> list[tuple[int, str, str]]:
    """(id, start_key, end_key) of a new cluster: one range that holds every key."""
    return [(1, "", "")]


def route(keys: DataFrame, ranges: DataFrame, pivots: int = 100_000) -> DataFrame:
    """keys(key) with range_id (null: no range holds it). ranges(id, start_key, end_key) don't overlap.

    Every n-th start is a pivot, so that there are at most `pivots`; they travel with the tasks. The range that holds a
    key begins at or after the key's last pivot and before the next one, so keys and ranges meet by equality of pivots,
    with n ranges each.
    """
    step = max(1, -(-ranges.count() // pivots))
    numbered = running_total(ranges.select("start_key").distinct().orderBy("start_key").withColumn("_n", F.monotonically_increasing_id()), "_n", F.lit(1)) if step > 1 else ranges.select("start_key").distinct().withColumn("total", F.lit(0))
    starts = sorted(r["start_key"].encode() for r in numbered.where(F.col("total") % step == 0).select("start_key").collect())  # `pivots` at most

    def located(df: DataFrame, column: str) -> DataFrame:
        schema = StructType([*df.schema.fields, StructField("_pivot", LongType())])

        def run(batches):
            import pyarrow as pa

            for b in batches:
                at = [None if k is None else bisect_right(starts, k.encode()) for k in b.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=[*b.schema.names, "_pivot"])

        return df.mapInArrow(run, schema)

    own = located(ranges.select("id", "start_key", "end_key"), "start_key").withColumnsRenamed({"_pivot": "_at", "id": "range_id"})
    both = located(keys, "key").join(own, (F.col("_pivot") == F.col("_at")) & holds(F.col("key"), F.col("start_key"), F.col("end_key")), "left")
    return both.select(*keys.columns, "range_id")


def split(ranges: DataFrame, range_id: int, key: str, new_id: int) -> DataFrame:
    """Cuts one range at key, which must be inside and not its start; the left part keeps the id."""
    own = ranges.where(F.col("id") == range_id)
    if not own.where(holds(F.lit(key), F.col("start_key"), F.col("end_key")) & (F.col("start_key") != key)).count():
        raise ValueError("the key must be inside of the range and not its start")
    parts = F.array(F.struct(F.lit(range_id).cast("bigint").alias("id"), "start_key", F.lit(key).alias("end_key")), F.struct(F.lit(new_id).cast("bigint").alias("id"), F.lit(key).alias("start_key"), "end_key"))
    return ranges.where(F.col("id") != range_id).select("id", "start_key", "end_key").unionByName(own.select(F.explode(parts).alias("p")).select("p.*"))


def liveness(beats: DataFrame, registered: DataFrame, now: Column, ttl_seconds: float = 5.0) -> DataFrame:
    """beats(node, ts) of registered(node) to (node, last_seen, state); beats of unknown nodes are ignored."""
    last = registered.select("node").join(beats, "node", "left").groupBy("node").agg(F.max("ts").alias("last_seen"))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))) / 1e6
    return last.select("node", "last_seen", F.when(age <= ttl_seconds, "Online").otherwise("Offline").alias("state"))


def next_ids(df: DataFrame, order: str, base: int) -> DataFrame:
    """Adds id: base + 1, base + 2, ... in the order of the distinct whole numbers `order`."""
    return running_total(df, order, F.lit(1).cast("bigint")).withColumn("id", F.col("total") + base).drop("total")


def proposed(log: DataFrame, commands: DataFrame, term: int, leads: bool = True) -> DataFrame:
    """log(idx, term, data) with commands(n, data) behind its last entry, in the order of n, under the leader's term."""
    if not leads:
        raise ValueError("only the leader takes commands")
    last = log.agg(F.max("idx")).first()[0] or 0
    new = next_ids(commands, "n", last).select(F.col("id").alias("idx"), F.lit(term).cast("bigint").alias("term"), "data")
    return log.select("idx", "term", "data").unionByName(new)


def proposed_for_keys(logs: DataFrame, terms: DataFrame, ranges: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """logs(range_id, idx) and terms(range_id, term) of the groups that run here; commands(n, key, data).

    Returns (entries, refused): entries (range_id, idx, term, n, key, data) to append to each key's group, and commands
    whose key is in no range, or whose group doesn't run here.
    """
    routed = route(commands, ranges).join(terms, "range_id", "left")
    refused = routed.where("term is null").select("n", "key", "data")
    last = logs.groupBy("range_id").agg(F.max("idx").alias("last"))
    at = F.row_number().over(Window.partitionBy("range_id").orderBy("n"))  # what one group's leader takes in one batch
    new = routed.where("term is not null").withColumn("_i", at).join(last, "range_id", "left")
    return new.select("range_id", (F.coalesce("last", F.lit(0)) + F.col("_i")).alias("idx"), "term", "n", "key", "data"), refused


def commit_index(log: DataFrame, match: DataFrame, term: int, committed: int, peers: int) -> DataFrame:
    """log(idx, term), match(peer, match_index) to (commit_index, commit_index_majority).

    The first needs more than (peers + 1) / 2 copies, where peers counts the leader; the second a plain majority. The
    leader's own copy counts in both. Peers are few: their positions are one broadcast array.
    """
    at = F.broadcast(match.groupBy().agg(F.collect_list("match_index").alias("at")))
    copies = log.where((F.col("term") == term) & (F.col("idx") > committed)).join(at, F.lit(True)).select("idx", (F.size(F.filter("at", lambda m: m >= F.col("idx"))) + 1).alias("n"))
    best = lambda ok: F.coalesce(F.max(F.when(ok, F.col("idx"))), F.lit(committed)).cast("bigint")
    return copies.agg(best(F.col("n") > (peers + 1) // 2).alias("commit_index"), best(F.col("n") > peers / 2).alias("commit_index_majority"))


def grants(requests: DataFrame, term: int, voted_for: int | None, last_term: int, last_index: int) -> DataFrame:
    """requests(candidate, term, last_log_term, last_log_index) with granted.

    A vote needs a term not behind ours, no vote for another in this term, and a log at least as far.
    """
    free = F.lit(voted_for is None) | (F.col("candidate") == F.lit(voted_for)) | (F.col("term") > term)
    far = (F.col("last_log_term") > last_term) | ((F.col("last_log_term") == last_term) & (F.col("last_log_index") >= last_index))
    return requests.withColumn("granted", (F.col("term") >= term) & F.coalesce(free, F.lit(False)) & far)


def elected(votes: DataFrame, peers: int) -> DataFrame:
    """votes(term, candidate) to (term, candidate, n_votes, wins): more than (peers + 1) / 2 votes win."""
    return votes.groupBy("term", "candidate").agg(F.count("*").alias("n_votes")).withColumn("wins", F.col("n_votes") > (peers + 1) // 2)


def appended(log: DataFrame, sent: DataFrame) -> DataFrame:
    """log and sent (idx, term, data): the log after the first conflict is cut and the sent entries are added."""
    clash = log.select("idx", F.col("term").alias("t")).join(sent, "idx").where("t <> term").agg(F.min("idx").alias("cut"))
    kept = log.join(F.broadcast(clash), F.lit(True)).where("cut is null or idx < cut").drop("cut")
    return kept.unionByName(sent.join(kept.select("idx"), "idx", "left_anti"))


def suffixes(log: DataFrame, next_index: DataFrame) -> DataFrame:
    """next_index(peer, next_index) to (peer, idx, term): what each peer still has to get. Peers are few."""
    return log.join(F.broadcast(next_index), F.col("idx") >= F.col("next_index")).select("peer", "idx", "term")


def to_apply(log: DataFrame, applied: int, committed: int) -> DataFrame:
    return log.where((F.col("idx") > applied) & (F.col("idx") <= committed)).orderBy("idx")
