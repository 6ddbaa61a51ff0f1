"""Fingerprints as arrays of 64-bit words: from flags or on-bits, and out as text. Bit i is bit i % 64 of word i // 64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from retort.functions.expr import let


def words_from_flags(flags: Column, n_bits: int) -> Column:
    """Words of an array of booleans of n_bits entries."""
    lit = lambda k: F.transform(F.slice(flags, 64 * k + 1, 64), lambda x, i: F.when(x, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    word = lambda k: F.aggregate(lit(k), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    return F.array(*(word(k) for k in range(-(-n_bits // 64))))


def words_from_bits(on: Column, n_bits: int) -> Column:
    """Words of an array of the numbers of set bits."""
    zero = F.array_repeat(F.lit(0).cast("long"), -(-n_bits // 64))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))
    word = lambda xs, k: F.aggregate(F.filter(xs, lambda x: F.call_function("shiftright", x, F.lit(6)) == k), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(bit(x)))
    return let(F.array_distinct(on), lambda xs: F.transform(zero, lambda z, k: word(xs, k)))


def on_bits(words: Column) -> Column:
    """Sorted numbers of set bits."""
    each = F.transform(words, lambda w, k: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", w, i) == 1), lambda i: k * 64 + i))
    return F.flatten(each)


def to_hex(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.lower(F.lpad(F.hex(w), 16, "0"))), "")


def to_bitstring(words: Column) -> Column:
    """Bit 0 first."""
    return F.array_join(F.transform(words, lambda w: F.reverse(F.lpad(F.bin(w), 64, "0"))), "")


def to_base64(words: Column) -> Column:
    """Of the words' bytes, most significant first, word by word."""
    return F.regexp_replace(F.base64(F.unhex(to_hex(words))), r"\s", "")


def to_columns(words: Column, n_bits: int) -> list[Column]:
    """bit_0, bit_1, ... as integers."""
    return [F.call_function("getbit", words[k // 64], F.lit(k % 64)).cast("int").alias(f"bit_{k}") for k in range(n_bits)]
