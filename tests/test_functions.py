"""Column functions against golden values and plain Python."""

from __future__ import annotations

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from readloom.functions import cigar as C
from readloom.functions import numbers as N
from readloom.functions import sequence as S
from readloom.functions import text as X


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


L = F.lit


def test_sequences(spark):
    got = one(spark, S.complement(L("ACGTRYKMBVDHSWNU")), S.reverse_complement(L("AACG")), S.sub_sequence(L("ACGTA"), 1, 3), S.sub_sequence(L("ACGTA"), 3, 99), S.gc_percent(L("ACGTN")), S.kmer_number(L("ACGT")), S.kmer_number(L("ANGT")), S.quality_total(L("!I")))
    assert got == ("TGCAYRMKVBHDSWNA", "CGTT", "CGT", "TA", 60.0, 27, None, 40)
    assert one(spark, S.base_counts(L("ACGTN")))[0] == (2, 1, 1, 1)
    assert one(spark, S.melting_wallace(L("ACGT")), S.melting_gc(L("GGCC")))[0] == 12
    assert one(spark, S.mismatches(L("ACGN"), L("AGGT")), S.mismatches(L("A-"), L("AA"))) == (1, 1)
    assert one(spark, S.approximate_matches(L("AACCAACC"), L("AAC"), 0), S.approximate_matches(L("AANCC"), L("AAC"), 0), S.approximate_matches(L("A"), L("AAC"), 0)) == ([1, 5], [1, 2], [])
    assert one(spark, S.melting_neighbour(L("A")), S.gc_percent(L("")), S.reverse_complement(L(None).cast("string"))) == (None, None, None)


@pytest.mark.parametrize("source", list(S.NEIGHBOURS))
def test_nearest_neighbour(spark, source):
    t, seq = S.NEIGHBOURS[source], "ACGGTTCATG"
    flip = str.maketrans("ACGT", "TGCA")
    h = s = 0.0
    for i in range(len(seq) - 1):
        d = seq[i : i + 2]
        x = t.get(d) or t[d.translate(flip)[::-1]]
        h, s = h + x[0], s + x[1]
    for k in ("start", "any_gc", "end_at", "end_gc"):
        h, s = h + t[k][0], s + t[k][1]
    want = 1000 * h / (s + 0.368 * 9 * math.log(0.05) + 1.9872 * math.log(6.25e-9)) - 273.15
    assert one(spark, S.melting_neighbour(L(seq), source=source))[0] == pytest.approx(want)


#: Two mates with their starts, and the merger expected of them.
MERGES = [
    ("AACCGGTT", "TTGGAACC", "HHHHHHHH", "HHHHHHHH", 10, 16, "AACCGGTTGGAACC", "H" * 14),
    ("AACCGGTT", "TTGGAACC", "HHHHHHHH", "HHHHHHHH", 10, 20, "AACCGGTTNNTTGGAACC", "HHHHHHHH!!HHHHHHHH"),
    ("AACCGGTC", "TTGGAACC", "HHHHHHHH", "GGHHHHHH", 10, 16, "AACCGGTCGGAACC", "H" * 14),
    ("AACCGGTC", "TTGGAACC", "HHHHHHHH", "HHHHHHHH", 1, 9, "AACCGGTCTTGGAACC", "H" * 16),
    ("TAACCGGTCC", "ACC", "HHHHHHHHHH", "III", 1, 3, "TAACCGGTCC", "HHIIIHHHHH"),
    ("ACGT", "ACGT", "HHHH", "IIII", 25, 26, "AACGT", "HIIII"),
]


@pytest.mark.parametrize("case", MERGES)
def test_merge_pair(spark, case):
    u, d, uq, dq, us, ds, seq, qual = case
    args = [L(u), L(d), L(uq), L(dq), L(us), L(ds)]
    assert tuple(one(spark, S.merge_pair(L(False), *args))[0]) == (seq, qual)
    back = seq.translate(str.maketrans("ACGTN", "TGCAN"))[::-1]
    assert tuple(one(spark, S.merge_pair(L(True), *args))[0]) == (back, qual[::-1])


def test_trims(spark):
    seq, qual = "ACGTACGTACGTACGTACGT", "I" * 20
    assert [len(x) for x in one(spark, S.fixed_trim(L(seq), L(qual), 5, 14))[0]] == [10, 10]
    assert len(one(spark, S.fixed_trim(L(seq), L(qual), 5, 14, False))[0].seq) == 15
    assert tuple(one(spark, S.quality_trim(L("ACGTA"), L("!!I!!"), 20, 20))[0]) == ("G", "I")
    assert tuple(one(spark, S.quality_trim(L("AC"), L("!!"), 20, 20))[0]) == ("", "")
    with pytest.raises(Exception, match="cannot trim"):
        one(spark, S.fixed_trim(L("AC"), L("II"), 5, 9))


def test_cigars(spark):
    ref, qry = "ACGTAC-GT", "ACCTACA-T"
    ops = C.operations(L(ref), L(qry))
    assert one(spark, ops, C.summarized(ops), C.standard(ops), C.reference_length(ops), C.edit_distance_of_operations(ops), C.edit_distance_of_pair(L(ref), L(qry)), C.expanded(L("3=2S1D"))) == (
        "==X===ID=", "2=1X3=1I1D1=", "6M1I1D1M", 8, 2, 3, "===SSD",
    )
    assert tuple(one(spark, C.pair_metrics(L("--ACGT-A"), L("TTA-GTCA")))[0]) == (4, 0, 3, 1, 2, 1, 2, 0, 7)
    assert one(spark, C.summarized(L("")), C.mismatch_details(L(""), L("")), C.consistent(L("==I"), L("ACG"))) == ("", "", True)


@pytest.mark.parametrize(("ops", "ref", "md"), [
    ("==========I=====X=====", "AAAAAAAAAA-CCCCCACCCCC", "15A5"), ("==========X=====X=====", "AAAAAAAAAAACCCCCGCCCCC", "10A5G5"), ("==========X=====DDX=====", "AAAAAAAAAAGCCCCCACACCCCC", "10G5^AC0A5"),
    ("X=", "AC", "0A1"), ("=XX", "ACG", "1C0G0"), ("D=", "AC", "0^A1"), ("", "", ""),
])
def test_mismatch_details(spark, ops, ref, md):
    from readloom.operators.alignment import _details

    assert one(spark, C.mismatch_details(L(ref), L(ops)))[0] == md
    assert _details(ref, ops) == md


def test_mismatch_details_of_long_reads(spark):
    """Random operations, empty runs and null too; the time is in proportion to the length (before: minutes for these)."""
    from readloom.operators.alignment import _details

    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("ACGTD", k=n)), "".join(rng.choices("=XDI", (9, 9, 1, 1), k=n))) for i, n in enumerate([*range(60), *[4000] * 20])] + [(80, None, "="), (81, "A", None)]
    df = spark.createDataFrame(rows, "i int, ref string, ops string")
    began = time.monotonic()
    got = {r.i: r.md for r in df.select("i", C.mismatch_details("ref", "ops").alias("md")).collect()}
    assert time.monotonic() - began < 30
    assert got == {i: None if ref is None or ops is None else _details(ref, ops) for i, ref, ops in rows}


def test_text(spark):
    got = one(
        spark, X.pad_left(L("ab"), 4, "0"), X.pad_left(L("abcde"), 4), X.nth_index(L("a.b.c"), ".", 2), X.nth_index(L("a.b"), ".", 2), X.is_numeric(L("1e3")), X.is_numeric(L("x")), X.count_matched(L("banana"), "an"),
        X.lines_on_spaces(L("aa bb cc dd"), 5), X.wrapped(L("abcde"), 2), X.insert_every(L("abcdef"), 2, "-"), X.replaced_at(L("abcdef"), 2, "XY"), X.shortened(L("abcdefgh"), 5), X.ordinal(L(11)), X.ordinal(L(22)),
        X.range_summary(F.array(*map(L, (5, 1, 2, 3, 2)))), X.duration_text(L(3661)), X.roman_value(L("XIV")), X.roman_value(L("AB")), X.is_printable(L("a b")), X.is_printable(L("a\tb")),
    )
    assert got == ("00ab", "abcde", 3, -1, True, False, 4, ["aa bb", "cc dd"], ["ab", "cd", "e"], "ab-cd-ef", "abXYef", "ab...", "11th", "22nd", "1-3, 5", "01:01:01", 14, None, True, False)
    assert one(spark, X.coordinate(L("chr1:100-1")), X.coordinate(L("chr1:1:100")), X.coordinate(L("chr1")))[0:3] == (("chr1", 1, 100), ("chr1", 1, 100), None)
    assert one(spark, X.annotations(L("a=1 b\tc=x=y a=2")))[0] == {"b": None, "c": "x=y", "a": "2"}
    assert one(spark, X.version_key(L("1.10")) > X.version_key(L("1.9")), X.version_key(L("1.9.1")) > X.version_key(L("1.9"))) == (True, True)


def test_natural_order(spark):
    want = ["chr1", "chr2", "chr10", "chr10a", "chrM", "chrX", "x 007", "x 8", "x 1000000000000", "x " + "9" * 99, "x 1" + "0" * 120]
    mixed = want[:]
    random.Random(1).shuffle(mixed)
    df = spark.createDataFrame([(w,) for w in mixed], "s string")
    assert [r.s for r in df.orderBy(X.natural_key("s")).collect()] == want
    r = spark.createDataFrame([("part IX",), ("part IV",), ("part 5",)], "s string")
    assert [x.s for x in r.orderBy(X.natural_key("s", roman=True)).collect()] == ["part IV", "part 5", "part IX"]


def test_numbers(spark):
    got = one(spark, N.gcd(L(12), L(18)), N.gcd(L(0), L(0)), N.lcm(L(4), L(6)), N.lcm(L(0), L(6)), N.cantor_pair(L(3), L(4)), N.factorial(L(5)), N.index_of(F.array(L(1), L(2)), L(2)), N.sort_index(F.array(L(3), L(1), L(3))), N.digits_before_point(L(-123.4)))
    assert got == (6, 0, 12, 0, 32.0, 120, 1, [1, 0, 2], 3)
    assert one(spark, N.normal_cdf(L(0.0)), N.normal_cdf(L(1.96)), N.normal_cdf(L(-7.0)), N.normal_cdf(L(7.0))) == pytest.approx((0.5, 0.975, 0, 1), abs=1e-4)
    assert math.isnan(one(spark, N.log2_safe(L(0.0)))[0])
    assert one(spark, N.log2_safe(L(8.0)), N.antilog2(L(3.0)), N.antilog10(L(2.0)), N.to_hex(L(255)), N.to_binary_text(L(5))) == (3.0, 8.0, 100.0, "FF", "101")
    assert one(spark, N.checksums(L("123456789")))[0][0] == 3421780262
    from readloom.operators.checks import crc16

    assert one(spark, crc16(L("123456789")), crc16(L(None).cast("string"))) == (0x29B1, None)


def test_helpers(spark):
    a, e = F.array(L(3), L(1), L(3)), F.array().cast("array<int>")
    assert one(spark, N.joined(a, e), N.without_place(a, 1), N.without_place(a, 9), N.without_values(a, F.array(L(3))), N.without_values(e, a)) == ([3, 1, 3], [3, 3], [3, 1, 3], [1], [])
    assert one(spark, N.permutations(F.array(L(1), L(2), L(3)), 2), N.permutations(a, 1), N.permutations(e, 2)) == ([[1, 2], [1, 3], [2, 1], [2, 3], [3, 1], [3, 2]], [[3], [1], [3]], [])
    got = one(spark, N.to_bytes(L(258), 2), N.to_bytes(L(258), 2, little=True), N.to_bytes(L(-2), 2), N.to_bytes(L(70000), 2), N.from_bytes(N.to_bytes(L(-2), 2)), N.from_bytes(N.to_bytes(L(-2), 2), signed=False), N.from_bytes(N.to_bytes(L(-(2**63)), 8, little=True), little=True))
    assert [bytes(x) if isinstance(x, bytearray) else x for x in got] == [b"\x01\x02", b"\x02\x01", b"\xff\xfe", None, -2, 65534, -(2**63)]
    assert one(spark, X.thousands(L(1234567)), X.thousands(L(0.125), 2), X.in_parentheses(L(-5)), X.in_parentheses(L(5))) == ("1,234,567", "0.12", "(-5)", "5")
    assert one(spark, S.approximate_matches(L("AACAAGAAT"), L("AAN"), 0, first=2), S.first_match(L("CCC"), L("A"), 0), S.first_match(L("CAC"), L("A"), 0), S.has_match(L("CAC"), L("G"), 0), S.has_match(L("CAC"), L("R"), 0)) == ([1, 4], None, 2, False, True)
    assert one(spark, S.contains_within(L("hello"), L("yell"), 1), S.contains_within(L("hello"), L("yeti"), 1), S.contains_within(L("a"), L(""), 0), S.contains_within(L("A"), L("N"), 0), S.contains_within(L(None).cast("string"), L("a"), 0)) == (True, False, True, False, None)
    assert one(spark, X.annotations(L('a="x  y" b=1 c "d e"=2'), quoted=True))[0] == {"a": "x  y", "b": "1", "c": None, '"d e"': "2"}
    assert one(spark, S.gc_percent(L("acgt")), S.base_counts(L("acgt")))[0] == 50.0
