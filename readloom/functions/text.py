"""Strings, numbers as text, dates, versions and natural order as Column functions; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roman numeral letters.
ROMAN = {"m": 1000, "d": 500, "c": 100, "l": 50, "x": 10, "v": 5, "i": 1}
_ROMAN_TAIL = "(?i)^(.*\\s|)(M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3}))$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pad_left(c: Column | str, length: int, fill: str = " ") -> Column:
    """Filled on the left to `length`; longer strings stay whole."""
    c = _col(c)
    return F.when(F.length(c) >= length, c).otherwise(F.lpad(c, length, fill))


def nth_index(c: Column | str, sought: str, n: int) -> Column:
    """0-based index of the nth (from 1) occurrence of a character, -1 if there are fewer."""
    c = _col(c)
    before = F.substring_index(c, sought, n)
    return F.when(F.length(c) - F.length(F.replace(c, F.lit(sought), F.lit(""))) < n * len(sought), -1).otherwise(F.length(before))


def is_numeric(c: Column | str) -> Column:
    """Whether the whole string is a floating-point number, blanks around it allowed."""
    return _col(c).try_cast("double").isNotNull()


def count_matched(c: Column | str, pattern: str) -> Column:
    """Characters that the pattern matches in all."""
    c = _col(c)
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def lines_on_spaces(c: Column | str, most: int) -> Column:
    """Lines of at most `most` characters, broken at spaces; longer words stand alone in theirs."""
    return F.transform(F.regexp_extract_all(_col(c), F.lit(f"(\\S.{{0,{most - 1}}}(?=\\s|$)|\\S+)"), F.lit(1)), lambda s: F.rtrim(s))


def wrapped(c: Column | str, width: int) -> Column:
    """Pieces of exactly `width` characters, the last one shorter."""
    return F.regexp_extract_all(_col(c), F.lit(f"(?s)(.{{1,{width}}})"), F.lit(1))


def insert_every(c: Column | str, n: int, what: str) -> Column:
    """`what` put after every n characters, not at the end."""
    return F.regexp_replace(_col(c), f"(?s)(.{{{n}}})(?=.)", f"$1{what}")


def replaced_at(c: Column | str, index: int, what: str) -> Column:
    """The characters from a 0-based index on replaced by as many of `what`."""
    return F.overlay(_col(c), F.lit(what), F.lit(index + 1))


def is_printable(c: Column | str) -> Column:
    """Whether all characters are printable ASCII."""
    return _col(c).rlike("^[ -~]*$")


def shortened(c: Column | str, most: int) -> Column:
    """Cut to `most` characters, the last three of them dots where something was cut."""
    c = _col(c)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, max(0, most - 3)), F.lit("...")))


def ordinal(n: Column | str) -> Column:
    """1st, 2nd, 3rd, 4th, ... 11th."""
    n = _col(n)
    d, h = F.abs(n) % 10, F.abs(n) % 100
    end = F.when(h.between(11, 13), "th").when(d == 1, "st").when(d == 2, "nd").when(d == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def thousands(n: Column | str, fraction: int = 0) -> Column:
    """A number with commas between thousands and so many digits after the point, 0.5 rounded to even."""
    return F.format_number(_col(n), fraction)


def in_parentheses(n: Column | str) -> Column:
    """A whole number, a negative one in parentheses."""
    n = _col(n)
    return F.when(n < 0, F.concat(F.lit("("), n.cast("string"), F.lit(")"))).otherwise(n.cast("string"))


def range_summary(values: Column | str) -> Column:
    """An array of whole numbers as '1-3, 5': sorted, runs joined, repeats once."""
    v = F.array_sort(F.array_distinct(F.filter(_col(values), lambda x: x.isNotNull())))
    starts = F.filter(v, lambda x: ~F.array_contains(v, x - 1))
    ends = F.filter(v, lambda x: ~F.array_contains(v, x + 1))
    texts = F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), b.cast("string"))))
    return F.array_join(texts, ", ")


def duration_text(seconds: Column | str) -> Column:
    """Seconds as HH:MM:SS, hours as many as there are."""
    s = _col(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def date_text(ts: Column | str) -> Column:
    """A timestamp as yyyy/MM/dd HH:mm:ss."""
    return F.date_format(_col(ts), "yyyy/MM/dd HH:mm:ss")


def version_key(c: Column | str) -> Column:
    """A dotted version as an array of numbers that compares part by part; missing parts are older."""
    return F.transform(F.regexp_extract_all(_col(c), F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("long"))


def roman_value(c: Column | str) -> Column:
    """A Roman numeral as a number; null for anything else."""
    c = F.lower(_col(c))
    table = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    values = F.transform(F.split(c, ""), lambda x: F.element_at(table, x))
    rest = F.concat(F.slice(values, F.lit(2), F.size(values)), F.array(F.lit(0)))
    total = F.aggregate(F.zip_with(values, rest, lambda a, b: F.when(a < b, -a).otherwise(a)), F.lit(0), lambda a, x: a + x)
    return F.when(c.rlike("^(?=.)m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"), total)


def natural_key(c: Column | str, *, roman: bool = False) -> Column:
    """A string whose plain order is the natural one.

    Case is ignored, digit runs compare as numbers and come before other characters, and of two strings that
    begin alike the shorter comes first. Each digit run becomes chr(1), the length of the number without leading
    zeros in three digits (numbers of 1000 digits and more all as 999), and the number. With `roman`, a Roman numeral at the end counts as its number.
    """
    c = _col(c)
    if roman:
        tail = F.regexp_extract(c, _ROMAN_TAIL, 2)
        c = F.when(F.length(tail) > 0, F.concat(F.regexp_extract(c, _ROMAN_TAIL, 1), roman_value(tail).cast("string"))).otherwise(c)
    pieces = F.regexp_extract_all(F.lower(c), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def key(p: Column) -> Column:
        n = F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.when(p.rlike("^[0-9]"), F.concat(F.lit("\x01"), F.lpad(F.least(F.length(n), F.lit(999)).cast("string"), 3, "0"), n)).otherwise(p)

    return F.array_join(F.transform(pieces, key), "")


def coordinate(c: Column | str) -> Column:
    """'chr1:1-100' or 'chr1:1:100' as struct container, start, stop with start <= stop; null for anything else."""
    c = _col(c)
    pattern = "^([^:]+):([0-9]{1,18})[:-]([0-9]{1,18})$"
    part = [F.regexp_extract(c, pattern, i) for i in (1, 2, 3)]
    a, b = part[1].try_cast("long"), part[2].try_cast("long")
    return F.when(c.rlike(pattern), F.struct(part[0].alias("container"), F.least(a, b).alias("start"), F.greatest(a, b).alias("stop")))


def coordinate_text(container: Column, start: Column, stop: Column) -> Column:
    return F.concat(container, F.lit(":"), start.cast("string"), F.lit("-"), stop.cast("string"))


def annotations(c: Column | str, *, quoted: bool = False) -> Column:
    """'k=v k=v' as a map, bare keys with null values; of a repeated key the last value stays.

    With `quoted`, blanks within double quotes don't part values, and the quotes around a value go.
    """
    if quoted:
        pieces = F.regexp_extract_all(_col(c), F.lit('((?:[^ \\t"]|"[^"]*"?)+)'), F.lit(1))
    else:
        pieces = F.filter(F.split(F.translate(_col(c), "\t", " "), " +"), lambda p: p != "")
    value = lambda p: F.substring(p, F.instr(p, "=") + 1, F.length(p))
    plain = (lambda v: F.regexp_replace(v, '"', "")) if quoted else (lambda v: v)
    pairs = F.transform(pieces, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(p.contains("="), plain(value(p))).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.transform(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"]), p["k"]))
    return F.map_from_entries(last)
