"""Hash functions that Spark lacks: FNV-1a in 32 and 64 bits as expressions, CRC-32C in Python."""

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published algorithms.
FNV32_START, FNV32_PRIME = 2166136261, 16777619
FNV64_START = 14695981039346656037
CASTAGNOLI = 0x82F63B78
LOW32 = (1 << 32) - 1


def _bytes(text: Column) -> Column:
    """UTF-8 bytes as an array of numbers."""
    digits = F.hex(F.encode(text, "UTF-8"))
    return F.transform(F.filter(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1)), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("bigint"))


def fnv32(text: Column) -> Column:
    return F.aggregate(_bytes(text), F.lit(FNV32_START).cast("bigint"), lambda h, b: h.bitwiseXOR(b) * FNV32_PRIME % (1 << 32))


def fnv64(text: Column) -> Column:
    """struct<lo,hi> of the 32-bit halves. The prime is 2 ** 40 + 435, so halves never overflow a BIGINT."""
    start = F.struct(F.lit(FNV64_START & LOW32).cast("bigint").alias("lo"), F.lit(FNV64_START >> 32).cast("bigint").alias("hi"))

    def step(h: Column, b: Column) -> Column:
        low = h["lo"].bitwiseXOR(b)
        t = low * 435
        return F.struct((t % (1 << 32)).alias("lo"), ((h["hi"] * 435 + F.shiftright(t, 32) + low * 256) % (1 << 32)).alias("hi"))

    return F.aggregate(_bytes(text), start, step)


@cache
def _table() -> tuple[int, ...]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (CASTAGNOLI if n & 1 else 0)
        out.append(n)
    return tuple(out)


def crc32c(data: bytes) -> int:
    table, c = _table(), LOW32
    for b in data:
        c = table[(c ^ b) & 255] ^ c >> 8
    return c ^ LOW32


def fnv32_of(data: bytes) -> int:
    h = FNV32_START
    for b in data:
        h = (h ^ b) * FNV32_PRIME & LOW32
    return h
