"""Arithmetic, bits and arrays as Column functions; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log2_safe(c: Column | str) -> Column:
    """Binary logarithm; NaN for zero and below."""
    c = _col(c)
    return F.when(c > 0, F.log2(c)).when(c.isNotNull(), F.lit(float("nan")))


def antilog2(c: Column | str) -> Column:
    return F.pow(F.lit(2.0), _col(c))


def antilog10(c: Column | str) -> Column:
    return F.pow(F.lit(10.0), _col(c))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of whole numbers, by Euclid's steps; gcd(0, 0) is 0."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    # A pair of 64-bit numbers needs at most 92 steps.
    step = F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b"))))
    return step["a"]


def lcm(a: Column, b: Column) -> Column:
    """Least common multiple; 0 if either is 0."""
    return F.coalesce(F.try_divide(F.abs(a).cast("long"), gcd(a, b)).cast("long") * F.abs(b).cast("long"), F.when(a.isNotNull() & b.isNotNull(), F.lit(0).cast("long")))


def digits_before_point(c: Column | str) -> Column:
    """Digits of the whole part."""
    return F.length(F.floor(F.abs(_col(c))).cast("string"))


def factorial(c: Column | str) -> Column:
    """n! for 0 to 20, null beyond."""
    return F.factorial(_col(c))


def normal_cdf(c: Column | str) -> Column:
    """Cumulative normal probability by a fifth-degree polynomial; 0 below -6, 1 above 6."""
    x = _col(c)
    # The approximation's density factor, scale and coefficients.
    density, scale, b = 0.3989423, 0.2316419, (0.31938153, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + F.abs(x) * scale)
    poly = F.lit(0.0)
    for k in reversed(b):
        poly = (poly + k) * t
    tail = density * F.exp(-x * x / 2) * poly
    return F.when(x > 6, 1.0).when(x < -6, 0.0).when(x < 0, tail).otherwise(1 - tail)


def cantor_pair(a: Column, b: Column) -> Column:
    """One number for a pair of natural numbers."""
    return (a + b) * (a + b + 1) / 2 + b


def array_total(c: Column | str) -> Column:
    return F.aggregate(_col(c), F.lit(0.0), lambda a, x: a + x)


def index_of(c: Column | str, value: Column) -> Column:
    """0-based index of a value in an array, -1 if it isn't there."""
    return (F.array_position(_col(c), value) - 1).cast("int")


def sort_index(c: Column | str) -> Column:
    """0-based positions of an array's elements in ascending order, ties by position."""
    tagged = F.transform(_col(c), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.array_sort(tagged), lambda s: s["i"])


def joined(*arrays: Column | str) -> Column:
    """Arrays one after the other."""
    return F.concat(*[_col(a) for a in arrays])


def without_place(c: Column | str, i: int) -> Column:
    """An array without the element at a 0-based index; unchanged if there is none."""
    return F.filter(_col(c), lambda _, k: k != i)


def without_values(c: Column | str, values: Column | str) -> Column:
    """An array without all elements that another array holds; null elements stay."""
    return F.filter(_col(c), lambda x: x.isNull() | ~F.coalesce(F.array_contains(_col(values), x), F.lit(False)))


def permutations(c: Column | str, size: int) -> Column:
    """All ordered choices of `size` elements by place, in order of their places, as arrays; their number grows like n^size."""
    c = _col(c)
    places = F.transform(c, lambda _, i: i)
    grown = F.transform(places, lambda i: F.array(i))
    for _ in range(size - 1):
        grown = F.flatten(F.transform(grown, lambda p: F.transform(F.filter(places, lambda i: ~F.array_contains(p, i)), lambda i: F.concat(p, F.array(i)))))
    return F.transform(grown, lambda p: F.transform(p, lambda i: F.get(c, i)))


def to_bytes(c: Column | str, size: int, *, little: bool = False) -> Column:
    """A whole number as so many bytes (1 to 8), two's complement, the greatest first unless `little`; null where it doesn't fit."""
    c = _col(c).cast("long")
    text = F.right(F.lpad(F.hex(c), 16, "0"), F.lit(2 * size))
    pairs = F.regexp_extract_all(text, F.lit("(..)"), F.lit(1))
    whole = F.unhex(F.array_join(F.reverse(pairs) if little else pairs, ""))
    fits = F.lit(True) if size == 8 else c.between(-(1 << (8 * size - 1)), (1 << (8 * size)) - 1)
    return F.when(fits, whole)


def from_bytes(b: Column | str, *, little: bool = False, signed: bool = True) -> Column:
    """The number of up to 8 bytes (7 if unsigned and beyond 2^63)."""
    pairs = F.regexp_extract_all(F.hex(_col(b)), F.lit("(..)"), F.lit(1))
    text = F.array_join(F.reverse(pairs) if little else pairs, "")
    fill = F.when(F.lit(signed) & F.substring(text, 1, 1).isin(*"89ABCDEF"), F.lit("F")).otherwise(F.lit("0"))
    return F.when(F.length(text) > 0, F.conv(F.concat(F.repeat(fill, 16 - F.length(text)), text), 16, -10).cast("long"))


def to_hex(c: Column | str) -> Column:
    return F.hex(_col(c))


def to_binary_text(c: Column | str) -> Column:
    return F.bin(_col(c))


def bit_set_algebra(a: Column, b: Column) -> Column:
    """Struct with and, or, xor, difference and the number of common bits."""
    both = a.bitwiseAND(b)
    return F.struct(both.alias("both"), a.bitwiseOR(b).alias("either"), a.bitwiseXOR(b).alias("one"), a.bitwiseAND(F.bitwise_not(b)).alias("only_a"), F.bit_count(both).alias("n_both"))


def checksums(c: Column | str) -> Column:
    """Struct crc32 and md5 of a string."""
    return F.struct(F.crc32(_col(c)).alias("crc32"), F.md5(_col(c)).alias("md5"))
