import random

import pytest

from quern.operators import kv
from quern.sources import table_file, wal

LOG = "seq long, op int, key string, value string"


def replay(rows):
    state = {}
    for seq, op, key, value in sorted(rows):
        state[key] = (seq, op, value)
    return state


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(i, rng.choice((1, 1, 1, 2)), f"k{rng.randrange(40):03d}", rng.choice(["", "v", "long value", f"v{i}"])) for i in range(600)]


def test_newest_is_a_replay(spark, rows):
    got = {r["key"]: (r["seq"], r["op"], r["value"]) for r in kv.newest(spark.createDataFrame(rows, LOG).repartition(5)).collect()}
    assert got == replay(rows)


def test_compaction_twice_is_once_and_keeps_tombstones_above_the_bottom(spark, rows):
    log = spark.createDataFrame(rows, LOG)
    once = kv.compact(log, 3)
    assert sorted(kv.compact(once.select("seq", "op", "key", "value"), 3).collect()) == sorted(once.collect())
    assert {r["op"] for r in once.collect()} == {1, 2}
    assert {r["op"] for r in kv.compact(log, kv.BOTTOM).collect()} == {1}


def test_put_delete_put_and_missing(spark):
    log = spark.createDataFrame([(1, 1, "a", "x"), (2, 2, "a", None), (3, 1, "a", ""), (4, 2, "b", None), (5, 1, "c", "z"), (6, 2, "c", None)], LOG)
    assert kv.get(log, "a").first().asDict() == {"key": "a", "found": True, "seq": 3, "op": 1, "value": "", "raw": ""}
    assert not kv.get(log, "c").first()["found"]
    assert not kv.get(log, "nowhere").first()["found"]
    assert [r["key"] for r in kv.scan(log).collect()] == ["a"]
    assert [r["key"] for r in kv.as_of(log, 5).collect()] and {r["key"] for r in kv.as_of(log, 5).collect()} == {"a", "c"}
    assert kv.counts(log).first().asDict() == {"versions": 6, "distinct_keys": 3, "live_keys": 1}


def test_running_total_over_blocks(spark):
    got = kv.running_total(spark.range(1000).withColumnRenamed("id", "seq"), "seq", __import__("pyspark.sql.functions", fromlist=["col"]).col("seq"), block=64)
    assert {r["seq"]: r["total"] for r in got.collect()} == {i: i * (i + 1) // 2 for i in range(1000)}


def test_bloom_has_no_false_negatives_and_equals_the_file_format(spark):
    keys = [f"key_{i:05d}" for i in range(300)]
    stored = spark.createDataFrame([(k,) for k in keys], "key string")
    probes = spark.createDataFrame([(k,) for k in keys + [f"other{i}" for i in range(300)]], "key string")
    got = {r["key"]: r["may_contain"] for r in kv.may_contain(stored, probes, 300).collect()}
    block = table_file.bloom([k.encode() for k in keys])
    assert got == {k: table_file.may_contain(block, k.encode()) for k in got}
    assert all(got[k] for k in keys) and sum(got.values()) < 330


def test_wal_round_trip_padding_and_damage():
    records = [(i, 1 + i % 2, f"wal_key_{i:05d}".encode(), b"v" * (i % 7)) for i in range(1, 200)]
    data = b"".join(wal.encode(*r) for r in records)
    padded = data + bytes(-len(data) % wal.PAGE) + wal.encode(999, 1, b"k", b"v")
    assert list(wal.decode(padded)) == [*records, (999, 1, b"k", b"v")]
    assert list(wal.decode(data[:-3])) == records[:-1]
    with pytest.raises(ValueError, match="checksum"):
        list(wal.decode(data[:40] + b"\xff" + data[41:]))


def test_wal_any_padding_and_any_bytes():
    last = (2, 2, b"\xff\x00key", b"")
    for short in range(wal.PAGE):
        first = (1, 1, b"\x80", b"\x00" * ((wal.PAGE - short - 26) % wal.PAGE))
        data = wal.padded(wal.encode(*first))
        assert -len(wal.encode(*first)) % wal.PAGE == short
        if short < 40 or short % 97 == 0:
            assert list(wal.decode(data + wal.encode(*last))) == [first, last], short
    zero_first = next(r for i in range(5000) if wal.encode(*(r := (i, 1, b"k", b"v")))[0] == 0)
    fill = (9, 1, b"", b"x" * (wal.PAGE - 26))  # leaves one byte of the page, where a record begins whose first byte is zero
    assert list(wal.decode(wal.encode(*fill) + wal.encode(*zero_first) + wal.encode(*last))) == [fill, zero_first, last]


def test_table_files_are_recognised():
    made = table_file.table([(b"\xff\x01", b"\x00", 1, 1)])
    assert list(table_file.all_entries(made)) == [(b"\xff\x01", b"\x00", 1, 1)]
    with pytest.raises(ValueError, match="table file"):
        list(table_file.all_entries(made[:-1] + b"\x00"))


def test_binary_keys_in_files(spark, tmp_path):
    rows = [(i + 1, 1, bytes([255, i]), bytes([i, 254])) for i in range(50)]
    log = spark.createDataFrame(rows, "seq long, op int, key binary, value binary")
    assert sorted((r["seq"], bytes(r["key"]), bytes(r["value"])) for r in wal.decoded(wal.encoded(log)).collect()) == [(s, k, v) for s, _, k, v in rows]
    (tmp_path / "7.sst").write_bytes(table_file.table([(k, v, s, o) for s, o, k, v in rows]))
    assert sorted(bytes(r["key"]) for r in table_file.read(spark, str(tmp_path / "*.sst")).collect()) == [r[2] for r in rows]


def test_append_numbers_go_on(spark, tmp_path):
    writes = spark.createDataFrame([(10, 1, "a", "x"), (20, 2, "a", "gone"), (15, 1, "b", "")], "n long, op int, key string, value string")
    path = str(tmp_path / "log")
    assert kv.append(path, writes).count() == 3
    got = sorted(map(tuple, kv.append(path, writes).collect()))
    assert got == [(1, 1, "a", "x"), (2, 1, "b", ""), (3, 2, "a", None), (4, 1, "a", "x"), (5, 1, "b", ""), (6, 2, "a", None)]


def test_versions_across_spans(spark, rows):
    log = spark.createDataFrame(rows, LOG)
    for r in kv.versions(log, span=7).collect():
        assert r["version"] == sum(x[2] == r["key"] and x[0] >= r["seq"] for x in rows)


def test_compaction_of_a_level_that_has_none(spark):
    meta = spark.createDataFrame([(2, 1, "a", "b", 1, 80)], "id long, level int, smallest string, largest string, entries long, size long")
    entries = spark.createDataFrame([(2, 1, 1, "a", "x")], "id long, seq long, op int, key string, value string")
    for level in (0, kv.BOTTOM):
        assert kv.compact_level(meta, entries, level) == (meta, entries)


def test_log_and_table_files(spark, tmp_path):
    rows = [(f"key_{i:05d}".encode(), f"val_data_block_{i:05d}".encode(), i + 1, 1) for i in range(500)]
    made = table_file.table(rows)
    assert list(table_file.all_entries(made)) == rows
    assert table_file.get(made, b"key_00321") == (rows[321][1], 322, 1)
    assert table_file.get(made, b"non_existent_key_99999") is None
    (tmp_path / "000002.sst").write_bytes(made)
    assert table_file.read(spark, str(tmp_path / "*.sst")).count() == 500
    (tmp_path / "1.wal").write_bytes(b"".join(wal.encode(s, o, k, v) for k, v, s, o in rows))
    got = wal.read(spark, str(tmp_path / "*.wal"))
    assert got.count() == 500 and got.agg({"seq": "max"}).first()[0] == 500


def test_sorted_files_prune(spark, rows, tmp_path):
    kv.write_sorted(spark.createDataFrame(rows, LOG), str(tmp_path / "t"), 3)
    assert kv.get(spark.read.parquet(str(tmp_path / "t")), "k001").first()["key"] == "k001"
