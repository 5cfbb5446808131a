"""A stable hash of values and a mergeable distinct-count sketch over it, as Spark expressions.

The hash is 64-bit FNV-1a over a type tag and the value's bytes. The sketch has
16,384 registers: the low 14 bits of the hash choose one, the position of the
first set bit of the rest is its value. Sketches are rows (register, rho), so
adding, merging and estimating are aggregations that Spark combines before it
shuffles. Sequential integers spread poorly under this hash; approx_distinct() is
the better choice where compatibility is not asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the hash and of the type tags.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3
TAGS = {"int": 0, "double": 1, "string": 2, "bool": 3, "data": 4, "null": 5}
BITS = 14
REGISTERS = 1 << BITS
_LOW = (1 << 32) - 1


def fnv1a(data: bytes, h: int = OFFSET) -> int:
    """The hash in plain Python: for seeds and tests."""
    for b in data:
        h = ((h ^ b) * PRIME) & (2**64 - 1)
    return h


def _seed(kind: str) -> int:
    return fnv1a(TAGS[kind].to_bytes(8, "little"))


def _fold(data: Column, kind: str) -> Column:
    """The hash of an array of byte values as bigint, in two halves of 32 bits so no product overflows."""
    seed, low = _seed(kind), F.lit(_LOW)

    def step(a: Column, b: Column) -> Column:
        x = a["lo"].bitwiseXOR(b)
        product = x * 435  # the prime is 2**40 + 435
        high = a["hi"] * 435 + F.shiftrightunsigned(product, 32) + F.shiftleft(x, 8)
        return F.struct(high.bitwiseAND(low).alias("hi"), product.bitwiseAND(low).alias("lo"))

    start = F.struct(F.lit(seed >> 32).cast("bigint").alias("hi"), F.lit(seed & _LOW).cast("bigint").alias("lo"))
    return F.aggregate(data, start, step, lambda a: F.shiftleft(a["hi"], 32).bitwiseOR(a["lo"]))


def _fold_eight(n: Column, kind: str) -> Column:
    """The hash of a bigint's eight bytes, least first: the fold written out, so that it is compiled with the query."""
    seed, low, known = _seed(kind), F.lit(_LOW), F.coalesce(n, F.lit(0).cast("bigint"))  # without nulls the code is a third as long
    hi, lo = F.lit(seed >> 32).cast("bigint"), F.lit(seed & _LOW).cast("bigint")
    for k in range(8):
        x = lo.bitwiseXOR(F.shiftrightunsigned(known, 8 * k).bitwiseAND(F.lit(255)))
        product = x * 435
        hi = (hi * 435 + F.shiftrightunsigned(product, 32) + F.shiftleft(x, 8)).bitwiseAND(low)
        lo = product.bitwiseAND(low)
    # null stays null; a conditional would keep Spark from sharing the steps' common parts
    return F.shiftleft(hi, 32).bitwiseOR(lo).bitwiseOR(n.bitwiseAND(F.lit(0)))


def hash_int(c: Column) -> Column:
    """The stable hash of an integer."""
    return _fold_eight(c.cast("bigint"), "int")


def hash_bytes(c: Column, kind: str = "data") -> Column:
    """The stable hash of bytes."""
    digits = F.hex(c)
    size = F.octet_length(c)
    at = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    return _fold(F.transform(at, lambda k: F.conv(F.substring(digits, k * 2 + 1, F.lit(2)), 16, 10).cast("bigint")), kind)


def hash_string(c: Column) -> Column:
    """The stable hash of a text's UTF-8 bytes."""
    return hash_bytes(F.encode(c, "UTF-8"), "string")


def hash_double(c: Column) -> Column:
    """The stable hash of a double, by the eight bytes of its IEEE form (Spark has no such view of a double; Java's is called)."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), c.cast("double"))
    return F.when(c.isNotNull(), _fold_eight(bits.cast("bigint"), "double"))


def hash_bool(c: Column) -> Column:
    """The stable hash of a boolean: 0 or 1 in eight bytes."""
    return _fold_eight(c.cast("bigint"), "bool")


def hash_hex(h: Column) -> Column:
    """A hash as 16 hex digits."""
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def registers(df: DataFrame, h: Column, group: list[str] | None = None) -> DataFrame:
    """(group..., reg, rho): the sketch of the hashes in df; null hashes do not count.

    The fewer bits the rest of a hash has, the greater is rho: the least rest of a register is
    kept while rows are read, and rho is made of it once.
    """
    keys = group or []
    parts = df.select(*keys, h.bitwiseAND(F.lit(REGISTERS - 1)).alias("reg"), F.shiftrightunsigned(h, BITS).alias("rest"))
    least = parts.groupBy(*keys, "reg").agg(F.min("rest").alias("rest")).where(F.col("rest").isNotNull())
    width = F.when(F.col("rest") == 0, 0).otherwise(F.length(F.bin("rest")))
    return least.select(*keys, F.col("reg").cast("int").alias("reg"), (F.lit(51) - width).cast("int").alias("rho"))


def merge(*sketches: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The sketch of everything that any of the sketches has seen."""
    out = sketches[0]
    for other in sketches[1:]:
        out = out.unionByName(other)
    return out.groupBy(*(group or []), "reg").agg(F.max("rho").alias("rho"))


def cardinality(sketch: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group..., estimate): the number of distinct values in each sketch."""
    m = float(REGISTERS)
    sums = sketch.groupBy(*(group or [])).agg(F.count("*").alias("present"), F.sum(F.pow(F.lit(2.0), -F.col("rho"))).alias("z"))
    zeros = F.lit(m) - F.col("present")
    raw = F.lit(0.7213 / (1 + 1.079 / m) * m * m) / (F.coalesce("z", F.lit(0.0)) + zeros)
    big = F.lit(-(2.0**32)) * F.log(F.lit(1.0) - F.least(raw, F.lit(2.0**32 - 1)) / F.lit(2.0**32))
    fitted = F.when((raw <= 2.5 * m) & (zeros > 0), F.lit(m) * F.log(F.lit(m) / zeros)).when(raw > 2.0**32 / 30, big).otherwise(raw)
    return sums.select(*(group or []), F.round(fitted).cast("bigint").alias("estimate"))


def is_empty(sketch: DataFrame) -> bool:
    """Whether the sketch has seen nothing."""
    return sketch.isEmpty()


def reset(sketch: DataFrame) -> DataFrame:
    """A sketch that has seen nothing."""
    return sketch.limit(0)


def size_in_bytes() -> int:
    """What a sketch takes when every register has its byte."""
    return REGISTERS


def relative_error() -> float:
    """The sketch's standard error."""
    return 1.04 / REGISTERS**0.5


def packed(sketch: DataFrame) -> DataFrame:
    """One row, the sketch as text: register:rho pairs in order, for storage."""
    return sketch.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reg", "rho"))), lambda s: F.concat_ws(":", s["reg"], s["rho"])), ",").alias("sketch"))


def unpacked(stored: DataFrame) -> DataFrame:
    """(reg, rho) of a stored sketch."""
    pair = stored.select(F.explode(F.split("sketch", ",")).alias("p")).where("p <> ''")
    return pair.select(F.split_part("p", F.lit(":"), F.lit(1)).cast("int").alias("reg"), F.split_part("p", F.lit(":"), F.lit(2)).cast("int").alias("rho"))


def approx_distinct(df: DataFrame, column: str, group: list[str] | None = None) -> DataFrame:
    """(group..., estimate) by Spark's own sketch: the recommended way."""
    return df.groupBy(*(group or [])).agg(F.approx_count_distinct(column, 0.0081).alias("estimate"))
