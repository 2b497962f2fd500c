"""Alignment strings as Column functions over two gapped sequences; '-' is a gap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.functions.sequence import both_plain, chars, codes_match, let


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def operations(ref: Column | str, qry: Column | str) -> Column:
    """One letter a column: '=' match, 'I' gap in the reference, 'D' gap in the query, 'X' mismatch."""
    per = F.zip_with(chars(ref), chars(qry), lambda r, q: F.when(r == q, "=").when(both_plain(r, q), "X").when(codes_match(r, q), "=").when(r == "-", "I").when(q == "-", "D").otherwise("X"))
    return F.array_join(per, "")


def _runs(ops: Column) -> Column:
    return F.regexp_extract_all(ops, F.lit("((.)\\2*)"), F.lit(1))


def summarized(ops: Column | str) -> Column:
    """Run lengths: '===XX' becomes '3=2X'."""
    return F.array_join(F.transform(_runs(_col(ops)), lambda r: F.concat(F.length(r).cast("string"), F.substring(r, 1, 1))), "")


def expanded(cigar: Column | str) -> Column:
    """The reverse of `summarized`; clips too are expanded in full."""
    parts = F.regexp_extract_all(_col(cigar), F.lit("([0-9]+[^0-9])"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.repeat(F.right(p, F.lit(1)), F.regexp_extract(p, "^[0-9]+", 0).cast("int"))), "")


def standard(ops: Column | str) -> Column:
    """Matches and mismatches both as 'M', summarized."""
    return summarized(F.translate(_col(ops), "=X", "MM"))


def reference_length(ops: Column | str) -> Column:
    """Columns that take up the reference."""
    return F.length(F.regexp_replace(_col(ops), "[^=XMDN]", ""))


def edit_distance_of_operations(ops: Column | str) -> Column:
    """Insertions and mismatches; deletions don't count."""
    return F.length(F.regexp_replace(_col(ops), "[^IX]", ""))


def edit_distance_of_pair(ref: Column | str, qry: Column | str) -> Column:
    """Columns in which the two differ in any way."""
    return F.size(F.filter(F.zip_with(chars(ref), chars(qry), lambda r, q: r != q), lambda d: d))


def mismatch_details(ref: Column | str, ops: Column | str) -> Column:
    """The MD string: counts of matches, reference bases at mismatches, '^' and the deleted bases, 0 between."""
    ref, ops = _col(ref), _col(ops)
    at = F.zip_with(chars(ref), chars(ops), lambda r, o: F.when(o == "=", "=").when(o == "X", F.concat(F.lit("X"), r)).when(o == "D", F.concat(F.lit("D"), r)).otherwise("|"))
    differs = "X.|(?:D.)+"

    def matches(run: Column) -> Column:
        return F.replace(run, F.lit("|"), F.lit(""))

    def told(t: Column) -> Column:
        return F.when(t.startswith("X"), F.substring(t, 2, 1)).otherwise(F.concat(F.lit("^"), F.regexp_replace(t, "D(.)", "$1")))

    def joined(flat: Column) -> Column:
        # A run of matches, empty ones too, stands before each mismatch or deletion and after the last one.
        runs, tokens = F.split(flat, differs), F.regexp_extract_all(flat, F.lit(f"({differs})"), F.lit(1))
        return F.array_join(F.zip_with(runs, tokens, lambda r, t: F.concat(F.length(matches(r)).cast("string"), F.coalesce(told(t), F.lit("")))), "")

    return let({"flat": F.array_join(at, "")}, lambda v: F.when(matches(v["flat"]) != "", joined(v["flat"])).when(v["flat"].isNotNull(), F.lit("")))


def pair_metrics(ref: Column | str, qry: Column | str) -> Column:
    """Struct matches, mismatches, insertions, deletions, insertion_gaps, deletion_gaps, inner_gaps, first, last.

    first and last: 0-based columns of the query's first and last base; inner_gaps: gap columns between the
    first and last base of both sequences.
    """
    ref, qry = _col(ref), _col(qry)
    ops = operations(ref, qry)

    def count(o: str) -> Column:
        return F.length(ops) - F.length(F.replace(ops, F.lit(o), F.lit("")))

    def lead(s: Column) -> Column:
        return F.length(F.regexp_extract(s, "^-*", 0))

    def tail(s: Column) -> Column:
        return F.length(F.regexp_extract(s, "-*$", 0))

    inner = F.substring(ops, F.greatest(lead(ref), lead(qry)) + 1, F.greatest(F.lit(0), F.length(ops) - F.greatest(lead(ref), lead(qry)) - F.greatest(tail(ref), tail(qry))))
    return F.struct(
        count("=").alias("matches"), count("X").alias("mismatches"), count("I").alias("insertions"), count("D").alias("deletions"),
        F.regexp_count(ops, F.lit("I+")).alias("insertion_gaps"), F.regexp_count(ops, F.lit("D+")).alias("deletion_gaps"),
        F.length(F.regexp_replace(inner, "[^ID]", "")).alias("inner_gaps"), lead(qry).alias("first"), (F.length(qry) - tail(qry) - 1).alias("last"),
    )


def consistent(ops: Column | str, read: Column | str) -> Column:
    """Whether the operations cover exactly the read: their number without deletions is its length."""
    return F.length(F.replace(_col(ops), F.lit("D"), F.lit(""))) == F.length(_col(read))
