"""Values of mixed types: coercion, total order, display, enumerations, ranges, sortable ids."""

from __future__ import annotations

import os
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import EnumSpec

#: A value of any type, as a struct: at most one of its fields is set.
VALUE_TYPE = "struct<bool:boolean,int:bigint,num:double,str:string,bin:binary>"
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def value(bool=None, int=None, num=None, str=None, bin=None) -> Column:
    """A mixed value from columns, of which one is set in each row."""
    given = {"bool": (bool, "boolean"), "int": (int, "bigint"), "num": (num, "double"), "str": (str, "string"), "bin": (bin, "binary")}
    return F.struct(*[(F.lit(None) if c is None else c).cast(t).alias(n) for n, (c, t) in given.items()])


def order_key(v: Column) -> Column:
    """A struct that sorts values: null, false, true, numbers by size, strings, bytes."""
    rank = F.when(v["bool"].isNotNull(), 1).when(v["int"].isNotNull() | v["num"].isNotNull(), 2).when(v["str"].isNotNull(), 4).when(v["bin"].isNotNull(), 5).otherwise(0)
    return F.struct(rank.alias("rank"), v["bool"].alias("bool"), F.coalesce(v["num"], v["int"].cast("double")).alias("num"), v["int"].alias("int"), v["str"].alias("str"), v["bin"].alias("bin"))


def as_double(v: Column) -> Column:
    """Numbers and text that is one, as double; everything else is null."""
    return F.coalesce(v["num"], v["int"].cast("double"), v["str"].try_cast("double"))


def as_int(v: Column) -> Column:
    """Integers, and doubles without a fraction, as bigint; everything else is null."""
    return F.coalesce(v["int"], F.when(v["num"] == F.floor(v["num"]), v["num"].try_cast("bigint")))


def display(v: Column) -> Column:
    """A value as text; bytes in hex, null as 'null'."""
    return F.coalesce(v["bool"].cast("string"), v["int"].cast("string"), v["num"].cast("string"), F.concat(F.lit('"'), v["str"], F.lit('"')), F.concat(F.lit("0x"), F.hex(v["bin"])), F.lit("null"))


def valid_enum(c: Column, spec: EnumSpec) -> Column:
    """Whether a text is one of the cases; null is not."""
    return F.coalesce(c.isin(*spec.cases), F.lit(False))


def in_range(c: Column, low, high) -> Column:
    """Half-open: low is inside, high is not."""
    return (c >= low) & (c < high)


def ulid(millis: int | None = None, entropy: bytes | None = None) -> str:
    """A sortable id: 48 bits of milliseconds, 80 of randomness, in base 32."""
    n = ((time.time_ns() // 1_000_000 if millis is None else millis) << 80) | int.from_bytes(os.urandom(10) if entropy is None else entropy, "big")
    return "".join(ALPHABET[(n >> (5 * k)) & 31] for k in range(25, -1, -1))


def ulid_bytes(text: str) -> bytes:
    """The 16 bytes of an id; ValueError if it is none."""
    if len(text) != 26 or any(c not in ALPHABET for c in text.upper()) or text[0] > "7":
        raise ValueError(f"not a sortable id: {text!r}")
    n = 0
    for c in text.upper():
        n = n * 32 + ALPHABET.index(c)
    return n.to_bytes(16, "big")


def ulid_millis(c: Column) -> Column:
    """The milliseconds in a sortable id: its first ten characters, read in base 32."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: F.instr(F.lit(ALPHABET), F.substring(F.upper(c), k, F.lit(1))) - 1)
    return F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, d: a * 32 + d)


def ulid_text(millis: Column, low80: Column) -> Column:
    """A sortable id from milliseconds and 20 hex digits of randomness, without a Python function."""
    head = [F.substring(F.lit(ALPHABET), (F.shiftright(millis, 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for k in range(9, -1, -1)]
    halves = [F.conv(F.substring(low80, 1 + 10 * h, 10), 16, 10).cast("bigint") for h in (0, 1)]
    tail = [F.substring(F.lit(ALPHABET), (F.shiftright(half, 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for half in halves for k in range(7, -1, -1)]
    return F.concat(*head, *tail)
