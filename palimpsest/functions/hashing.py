"""Hash and codec expressions, all native columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = (1 << 32) - 1
#: Fixed multiplier of the word hash; right results need this value.
WORD_MULTIPLIER = 0x9C6C8F5B
NGRAM = 10


def times32(k: Column, factor: int) -> Column:
    """k * factor mod 2**32; halves keep each product below 2**63, as ANSI mode asks for."""
    low = k.bitwiseAND(0xFFFF) * factor
    high = F.shiftleft((F.shiftright(k, 16) * factor).bitwiseAND(0xFFFF), 16)
    return (low + high).bitwiseAND(MASK)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _word_steps():
    yield lambda k: k.bitwiseXOR(F.shiftright(k, 15))
    yield lambda k: (F.lit(MASK) - k + F.shiftleft(k, 6)).bitwiseAND(MASK)
    yield lambda k: k.bitwiseXOR(F.shiftright(k, 4))
    yield lambda k: times32(k, WORD_MULTIPLIER)
    yield lambda k: F.shiftright(k.bitwiseXOR(F.shiftright(k, 16)), 24)


def word_hash(k: Column) -> Column:
    """One byte per 32-bit word id; for whole tables see with_word_hash."""
    for step in _word_steps():
        k = _let(k, step)
    return k


def with_word_hash(rows: DataFrame, wid: str = "wid", out: str = "b") -> DataFrame:
    """Adds the word hash, a projection per step: each step names its input twice, and nesting would double the plan each time."""
    rows = rows.withColumn(out, F.col(wid))
    for step in _word_steps():
        rows = rows.withColumn(out, step(F.col(out)))
    return rows


def nested_weights(n: int = NGRAM) -> list[list[int]]:
    """Weights of the four nested running sums of n bytes, from the binomials that nesting adds up to."""
    rows = [[1] * n]
    for _ in range(3):
        last = rows[-1]
        rows.append([sum(last[k:]) for k in range(n)])
    return rows


def ngram_hash(byte_at) -> Column:
    """Four nested sums mod 256 of the n bytes byte_at(0), byte_at(1), ...; the deepest sum on top."""
    sums = [reduce(lambda a, b: a + b, (byte_at(k) * w for k, w in enumerate(row))).bitwiseAND(255) for row in nested_weights()]
    return reduce(lambda a, b: a + b, (s * (1 << (8 * k)) for k, s in enumerate(sums)))


def varbyte_size(n: Column) -> Column:
    """Bytes of the 7-bit variable-length code of a non-negative number."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(n)) / 7)).cast("int")


def varbyte_encode(n: Column, flag_high: bool = True) -> Column:
    """Bytes (array<int>) of the variable-length code.

    flag_high: least significant group first, high bit set while more follow;
    otherwise most significant group first, the low bit set on the last one's
    predecessors.  Any number up to 2**63 - 1 round-trips.
    """
    n = n.cast("long")
    groups = F.transform(F.sequence(F.lit(0), varbyte_size(n) - 1), lambda i: F.expr("0") + F.call_function("shiftright", n, i * 7).bitwiseAND(127))
    last = F.size(groups) - 1
    if flag_high:
        return F.transform(groups, lambda g, i: (g + F.when(i < last, 128).otherwise(0)).cast("int"))
    return F.transform(F.reverse(groups), lambda g, i: (g * 2 + F.when(i < last, 1).otherwise(0)).cast("int"))


def varbyte_decode(code: Column, flag_high: bool = True) -> Column:
    """The number of one variable-length code."""
    zero = F.lit(0).cast("long")
    if flag_high:
        return F.aggregate(F.reverse(code), zero, lambda acc, b: acc * 128 + b.bitwiseAND(127))
    return F.aggregate(code, zero, lambda acc, b: acc * 128 + F.shiftright(b, 1))


def write_bits(values: Column, width: int) -> Column:
    """Array of numbers below 2**width as one string of bits, most significant first."""
    return F.array_join(F.transform(values, lambda v: F.lpad(F.bin(v), width, "0")), "")


def read_bits(bits: Column, width: int) -> Column:
    """The numbers of write_bits."""
    count = F.floor(F.length(bits) / width).cast("int")
    return F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.conv(F.substr(bits, i * width + 1, F.lit(width)), 2, 10).cast("long"))
