"""The binary write-ahead log: records of crc, seq, type, key length, value length, flags (25 bytes), key and value.

Numbers are little-endian; the checksum is CRC-32C over all that follows it. Between records, zeros pad to 4 KB, from 1
byte up. Keys and values are bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.hashing import crc32c

HEAD = struct.Struct("<IQBIII")
PAGE = 4096


def encode(seq: int, op: int, key: bytes, value: bytes) -> bytes:
    rest = HEAD.pack(0, seq, op, len(key), len(value), 0)[4:] + key + value
    return struct.pack("<I", crc32c(rest)) + rest


def padded(records: bytes) -> bytes:
    """records, filled up with zeros to whole pages."""
    return records + bytes(-len(records) % PAGE)


def decode(data: bytes) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(seq, op, key, value) of each record; ends at an incomplete one, raises at a wrong checksum.

    Zeros up to the end of a page are padding. Fewer than a record's head may also begin a record whose checksum begins
    with zeros; it is one if that checksum holds.
    """
    at = 0
    while at < len(data):
        rest = min(len(data), (at // PAGE + 1) * PAGE) - at
        zeros = not any(data[at : at + min(rest, HEAD.size)])
        record = None if zeros and rest >= HEAD.size else _record(data, at)
        if record and record[0]:
            yield record[1]
            at = record[2]
        elif zeros:
            at += rest
        elif record:
            raise ValueError(f"wrong checksum at {at}")
        else:
            return


def _record(data: bytes, at: int) -> tuple[bool, tuple[int, int, bytes, bytes], int] | None:
    """(checksum holds, record, its end), or None if it is incomplete."""
    if at + HEAD.size > len(data):
        return None
    crc, seq, op, n, m, _ = HEAD.unpack_from(data, at)
    end = at + HEAD.size + n + m
    if end > len(data):
        return None
    return crc32c(data[at + 4 : end]) == crc, (seq, op, data[at + HEAD.size : end - m], data[end - m : end]), end


def encoded(log: DataFrame) -> DataFrame:
    """log(seq, op, key, value) to (seq, record)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("seq", "op", "key", "value")), strict=True)
            made = [encode(s, o, k or b"", v or b"") for s, o, k, v in rows]
            yield pa.RecordBatch.from_arrays([b.column("seq"), pa.array(made, pa.binary())], names=["seq", "record"])

    return log.select(F.col("seq").cast("bigint"), F.col("op").cast("int"), F.col("key").cast("binary"), F.col("value").cast("binary")).mapInArrow(run, "seq bigint, record binary")


def batches(log: DataFrame, batch: Column, segment: Column) -> DataFrame:
    """log(seq, op, key, value) to (segment, data): the files of a log whose batches of records are each filled up to whole pages."""

    def run(key, table):
        import pyarrow as pa

        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("batch", "seq", "op", "key", "value")), strict=True), key=lambda r: r[:2])
        data = b"".join(padded(b"".join(encode(s, o, k or b"", v or b"") for _, s, o, k, v in own)) for _, own in groupby(rows, key=lambda r: r[0]))
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([data], pa.binary())})

    plain = log.select(segment.cast("bigint").alias("segment"), batch.cast("bigint").alias("batch"), F.col("seq").cast("bigint"), F.col("op").cast("int"), F.col("key").cast("binary"), F.col("value").cast("binary"))
    return plain.groupBy("segment").applyInArrow(run, "segment bigint, data binary")


LOG = "seq bigint, op int, key binary, value binary"


def decoded(records: DataFrame, column: str = "record") -> DataFrame:
    """Binary logs, whole or single records, to (seq, op, key, value)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [r for data in b.column(column).to_pylist() for r in decode(data)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())], names=["seq", "op", "key", "value"])

    return records.select(column).mapInArrow(run, LOG)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Log files under path; each file is read by one task, in file order."""
    return decoded(spark.read.format("binaryFile").load(path).select(F.col("content").alias("record")))
