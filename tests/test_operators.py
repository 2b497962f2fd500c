"""Joins, intervals, statistics, k-mers, alignment and duplicate removal against brute force."""

from __future__ import annotations

import random
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.operators import checks, dedup, intervals, joins, kmers, words
from readloom.operators import statistics as st
from readloom.operators.alignment import PRIMER, Scoring, _BITS, align_all, extend, extend_to_primers, flip, global_alignments, letter_alignments, primer_end


@pytest.mark.parametrize("how", ["contained", "overlap"])
@pytest.mark.parametrize("width", [None, 3, 50])
def test_range_join(spark, how, width):
    rng = random.Random(7)

    def some(n, longest):
        out = []
        for i in range(n):
            a = rng.randrange(120)
            b = a + rng.randrange(longest)
            out.append((i, rng.choice("xy"), *rng.choice([(a, b), (b, a)]), rng.choice("+-")))
        return [*out, (n, "x", None, 5, "+"), (n + 1, None, 1, 5, "+")]

    rows, windows = some(80, 6), some(60, 30)
    schema = "id int, container string, start int, stop int, strand string"
    got = joins.range_join(spark.createDataFrame(rows, schema), spark.createDataFrame(windows, schema), strand="strand", how=how, bin_width=width)
    want = Counter()
    for i, c, a, b, s in rows:
        for j, d, x, y, t in windows:
            if None not in (a, b, x, y, c) and c == d and s == t:
                a1, b1, x1, y1 = min(a, b), max(a, b), min(x, y), max(x, y)
                if (x1 <= a1 and b1 <= y1) if how == "contained" else max(a1, x1) <= min(b1, y1):
                    want[i, j] += 1
    assert Counter((r.id, r.w_id) for r in got.collect()) == want


@pytest.mark.parametrize("tile", [5, 1 << 18])
def test_coverage(spark, tile):
    rng = random.Random(tile)
    rows = [(rng.choice("ab"), rng.randrange(60), rng.randrange(60)) for _ in range(80)] + [("a", None, 3)]
    df = spark.createDataFrame(rows, "k string, s int, e int")
    depths = intervals.coverage_depth(df, ["k"], F.col("s"), F.col("e"), tile=tile)
    depth, cuts = defaultdict(int), defaultdict(set)
    for k, a, b in rows:
        if a is not None:
            a, b = min(a, b), max(a, b)
            cuts[k] |= {a, b + 1}
            for p in range(a, b + 1):
                depth[k, p] += 1
    want = {(k, a, b, depth[k, a]) for k, c in cuts.items() for a, b in zip(sorted(c)[:-1], sorted(c)[1:], strict=True) if depth[k, a]}
    assert {tuple(r) for r in depths.collect()} == want
    roi = {r.k: r for r in intervals.roi_coverage(depths, ["k"], 10, 30).collect()}
    for k, r in roi.items():
        inside = [depth[k, p] for p in range(10, 31) if depth[k, p]]
        outside = [n for (x, p), n in depth.items() if x == k and not 10 <= p <= 30 and n]
        assert (r.unique_in, r.redundant_in, r.unique_out, r.redundant_out) == (len(inside), sum(inside) - len(inside), len(outside), sum(outside) - len(outside))


@pytest.mark.parametrize("tile", [4, 1 << 18])
@pytest.mark.parametrize("previous", [False, True])
def test_neighbours(spark, tile, previous):
    rng = random.Random(tile + previous)
    rows = []
    for _ in range(150):
        a = rng.randrange(80)
        rows.append((rng.choice(["chr1", "chr2", "chr10"]), a, a + rng.choice([1, 2, 3, 30])))
    df = spark.createDataFrame(rows, "c string, s long, e long")
    order = ["chr1", "chr2", "chr10"]
    for wrap in (False, True):
        got = {(r.c, r.s, r.e): (r.to_container, r.to_start, r.to_stop) for r in intervals.neighbours(df, "c", "s", "e", previous=previous, wrap=wrap, tile=tile).collect()}
        assert set(got) == set(rows)
        for c, s, e in rows:
            if previous:
                near = [x for x in rows if x[0] == c and x[1] < s and x[2] < e]
            else:
                near = [x for x in rows if x[0] == c and x[1] > s and x[2] > e]
            if near:
                want = max(near) if previous else min(near)
            elif wrap:
                other = order[(order.index(c) + (-1 if previous else 1)) % 3]
                ends = [x for x in rows if x[0] == other]
                want = max(ends) if previous else min(ends)
            else:
                want = None
            assert got[c, s, e] == (want or ((c if not wrap and not near else None), None, None)) or (want is None and got[c, s, e][1] is None)


def test_small_joins(spark):
    aln = spark.createDataFrame([("a", 1, 5, "CG", "x"), ("a", 1, 3, "CGT", "y"), ("b", 2, 1, "T", "z"), (None, 1, 1, "T", "z")], "name string, mate int, start int, seq string, extra string")
    reads = spark.createDataFrame([("a", 1, 10, "ACGT", "IIII"), ("c", 1, 11, "A", "I")], "name string, mate int, read_index long, seq string, qual string")
    assert [tuple(r) for r in joins.merge_raw_reads(aln, reads).select("name", "start", "mapped_length", "read_index", "seq").collect()] == [("a", 3, 3, 10, "ACGT")]
    hits = spark.createDataFrame([(1, 1, "p"), (1, 2, "p"), (1, 1, "q"), (2, 1, "p"), (2, 1, "p")], "read_index int, mate int, probe_id string")
    assert [tuple(r) for r in joins.mate_probe_intersection(hits).collect()] == [(1, "p")]
    scored = spark.createDataFrame([(1, "p", 5, 1), (1, "q", 5, 2), (2, "p", 5, 1), (2, "q", 5, 1), (3, "p", 1, 0)], "read_index int, probe_id string, matches int, edits int")
    assert {(r.read_index, r.probe_id) for r in joins.best_candidates(scored).collect()} == {(1, "p"), (3, "p")}
    one = spark.createDataFrame([("n", 1, 1), ("n", 1, 2), ("m", 1, 1), ("o", 2, 1)], "name string, primary_id int, secondary_id int")
    two = spark.createDataFrame([("n", 1, 2), ("m", 1, 2), ("m", 1, 3), ("o", 2, 1)], "name string, primary_id int, secondary_id int")
    assert {(r.name, r.pairings, r.status) for r in joins.pair_assignments(one, two).collect()} == {("n", 1, "single"), ("m", 2, "multiple"), ("o", 0, "none")}
    d = spark.createDataFrame([("x", 1), ("y", 2)], "container string, size int")
    g = spark.createDataFrame([("A", "x", 1), ("A", "y", 2), ("A", "z", 3), ("B", "x", 1), ("B", "y", 9)], "genome string, container string, size int")
    assert [r.genome for r in joins.identify_genomes(d, g).collect()] == ["A"]
    assert {(r.container, r.status) for r in joins.genome_mismatches(d, g.where("genome = 'B'")).collect()} == {("x", "equal"), ("y", "*")}


def test_quantiles(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 2, 4, 4)] + [("b", 7), ("c", None)], "k string, v int")
    got = {r.k: r for r in st.quantiles(df, ["k"], F.col("v"), 3).collect()}
    assert (got["a"].q1, got["a"].q2) == (2.0, 4.0) and got["b"].q1 is None and "c" not in got
    assert {r.k: (r.least, r.median, r.greatest) for r in st.five_numbers(df, ["k"], F.col("v")).collect()} == {"a": (1, 2.0, 4), "b": (7, 7.0, 7)}
    rng = random.Random(1)
    values = [rng.randrange(50) for _ in range(101)]
    q = st.quantiles(spark.createDataFrame([(v,) for v in values], "v int"), [], F.col("v"), 4).first()
    s = sorted(values)
    assert (q.q1, q.q2, q.q3) == (s[25], s[50], s[75])


def test_statistics(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 6)] + [("b", 3.0)] * 4 + [("c", None)], "k string, v double")
    r = {x.k: x for x in st.running_stats(df, ["k"], F.col("v")).collect()}
    assert r["a"].geometric_mean == pytest.approx(2.60517, abs=1e-5) and r["a"].var_samp == 2.5 and r["c"].n == 0
    values = [1.0, 2.0, 3.0, 4.0, 100.0, 5.0, 2.5]
    got = st.biweight_mean(spark.createDataFrame([(v,) for v in values], "v double"), [], F.col("v")).first()
    med = statistics.median(values)
    mad = statistics.median(abs(v - med) for v in values)
    w = [max(0, 1 - ((v - med) / (5 * mad)) ** 2) ** 2 if abs(v - med) < 5 * mad else 0 for v in values]
    assert got.biweight == pytest.approx(np.average(values, weights=w))
    assert {x.k: x.biweight for x in st.biweight_mean(df, ["k"], F.col("v")).collect()}["b"] == 3.0
    rng = np.random.default_rng(1)
    x, z = rng.random(200), rng.random(200)
    y = 2 + 3 * x - z + rng.random(200) / 10
    d = spark.createDataFrame([tuple(map(float, t)) for t in zip(y, x, z, strict=True)], "y double, x double, z double")
    fit = st.multiple_regression(d, F.col("y"), [F.col("x"), F.col("z")])
    assert fit["coefficients"] == pytest.approx(np.linalg.lstsq(np.c_[np.ones(200), x, z], y, rcond=None)[0].tolist()) and 0.98 < fit["r2"] < 1
    line = st.linear_regression(d, [], F.col("y"), F.col("x")).first()
    assert (line.slope, line.intercept) == pytest.approx(tuple(np.polyfit(x, y, 1))) and line.r**2 == pytest.approx(line.r2)


def test_tallies_and_compositions(spark):
    df = spark.createDataFrame([("a", 4)] * 3 + [("a", 5)] * 3 + [("a", 6), ("b", None)], "k string, v int")
    assert {(r.value, r.n, r.is_mode) for r in st.tally(df, ["k"], F.col("v")).collect()} == {(4, 3, True), (5, 3, True), (6, 1, False)}
    assert st.tally(df, [], F.col("v")).count() == 3
    seqs = spark.createDataFrame([("ACGN",), ("AC",), (None,)], "s string")
    assert {r.code: r.share for r in st.composition(seqs, [], F.col("s")).collect()} == {"A": 0.333, "C": 0.333, "G": 0.167, "N": 0.167}
    assert {r.code: r.n for r in st.composition(seqs, [], F.col("s"), F.lit(2)).collect()} == {"A": 4, "C": 4, "G": 2, "N": 2}
    assert [(r.pos, r.n, r.a, r.g) for r in st.composition_by_position(seqs, [], F.col("s")).orderBy("pos").collect()] == [(0, 2, 1.0, 0.0), (1, 2, 0.0, 0.0), (2, 1, 0.0, 1.0), (3, 1, 0.0, 0.0)]


def test_kmers(spark):
    refs = spark.createDataFrame([("r1", "ACGTACGGTTCAAGCT"), ("r2", "GGGGGGGGGGGGGGGG"), ("r3", "ACG")], "reference_id string, seq string")
    asks = spark.createDataFrame([("q1", "ACGTACGGTTCAAGCT"), ("q2", "TTTTTT")], "query_id string, seq string")
    got = kmers.candidates(asks, refs, k=5, least_ratio=0.25, include_last=True).collect()
    assert [(r.query_id, r.reference_id, r.hits) for r in got] == [("q1", "r1", 12)]
    assert kmers.candidates(asks, refs, k=5).first().hits == 11
    assert kmers.candidates(asks, refs, k=5, most_references=0).count() == 0
    assert {(r.kmer, r.n) for r in kmers.repeated(spark.createDataFrame([("a", "ACACA")], "i string, s string"), "i", "s", 3).collect()} == {("ACA", 2)}
    rng = random.Random(2)
    g = "".join(rng.choices("ACGT", k=400))
    genome = spark.createDataFrame([("c", 1, g[:230]), ("c", 201, g[200:])], "container string, start long, seq string")
    qs = [("a", g[50:80]), ("b", flip(g[210:235])[::-1]), ("c", "A" * 5), ("d", "N" * 20)]
    hit = kmers.exact_search(genome, spark.createDataFrame(qs, "query_id string, seq string"))
    assert {tuple(r) for r in hit.collect()} == {("a", "c", 51, "+"), ("b", "c", 211, "-")}


def _plain(r, q, s):
    """The same recurrence, cell by cell."""
    n, m = len(r), len(q)
    sc, by = {(0, 0): 0.0}, {(0, 0): 0}
    for j in range(1, n + 1):
        sc[0, j], by[0, j] = (s.gap_open - (j - 1) if s.start_gaps else 0.0), 1
    for i in range(1, m + 1):
        sc[i, 0], by[i, 0] = (s.gap_open - (i - 1) if s.start_gaps else 0.0), 2
        for j in range(1, n + 1):
            up = sc[i - 1, j] + (0 if j == n and not s.end_gaps else s.gap_extend if by[i - 1, j] == 2 else s.gap_open)
            left = sc[i, j - 1] + (0 if i == m and not s.end_gaps else s.gap_extend if by[i, j - 1] == 1 else s.gap_open)
            both = sc[i - 1, j - 1] + (s.match if _BITS[ord(q[i - 1])] & _BITS[ord(r[j - 1])] else s.mismatch)
            sc[i, j] = max(up, left, both)
            by[i, j] = 1 if sc[i, j] == left else 2 if sc[i, j] == up else 3
    i, j, a, b = m, n, "", ""
    while i or j:
        k = by[i, j]
        a, b = a + ("-" if k == 2 else r[j - 1]), b + ("-" if k == 1 else q[i - 1])
        i, j = i - (k != 1), j - (k != 2)
    return a[::-1], b[::-1], sc[m, n]


@pytest.mark.parametrize("scoring", [Scoring(), PRIMER, Scoring(end_gaps=True), Scoring(2, -1, -3, -2, True, True)])
def test_alignment(scoring):
    rng = random.Random(3)
    pairs = [("".join(rng.choices("ACGTN", k=rng.randrange(1, 15))), "".join(rng.choices("ACGT", k=rng.randrange(1, 15)))) for _ in range(300)]
    assert align_all(pairs, scoring) == [_plain(r, q, scoring) for r, q in pairs]


def test_alignments_of_a_table(spark):
    df = spark.createDataFrame([("ACGT", "ACG", 1), ("ACGT", "ACG", 2), (None, "A", 3), ("", "", 4)], "r string, q string, ref int")
    got = {(r.ref, r.qry): (r.ref_aligned, r.qry_aligned, r.normalized_score) for r in global_alignments(df, "r", "q").collect()}
    assert got == {("ACGT", "ACG"): ("ACGT", "ACG-", 0.75), ("", ""): ("", "", None)}
    assert global_alignments(df.limit(0), "r", "q").collect() == []


def _probe(rng, strand):
    ext, target, lig = ("".join(rng.choices("ACGT", k=n)) for n in (24, 120, 22))
    if strand == "+":
        place = (100, 123, 244, 265)
    else:
        place = (300, 323, 158, 179)
    return {"probe_id": f"P{strand}", "strand": strand, "ext_sequence": ext, "lig_sequence": lig, "target_sequence": target, "ext_start": place[0], "ext_stop": place[1], "lig_start": place[2], "lig_stop": place[3]}


@pytest.mark.parametrize("strand", "+-")
def test_extension(spark, strand):
    rng = random.Random(11)
    p = _probe(rng, strand)
    probes = spark.createDataFrame([tuple(p.values())], "probe_id string, strand string, ext_sequence string, lig_sequence string, target_sequence string, ext_start int, ext_stop int, lig_start int, lig_stop int")
    r1 = "GATTACAGAT" + p["ext_sequence"] + p["target_sequence"][:60]
    whole = p["ext_sequence"] + p["target_sequence"] + p["lig_sequence"]
    r2 = flip(whole)[::-1][:90]
    pairs = spark.createDataFrame([(1, p["probe_id"], r1, r2), (2, p["probe_id"], r1, "T" * 90), (3, "none", r1, r2), (4, p["probe_id"], None, r2), (5, p["probe_id"], r1, r2)], "id int, probe_id string, r1 string, r2 string")
    got = {r.id: r for r in extend_to_primers(pairs, probes).collect()}
    assert {i: r.extended for i, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: True}
    assert (got[1].one.first, got[1].one.last, got[1].one.cigar, got[1].one.md, got[1].one.edit_distance) == (34, 93, "60M", "60", 0)
    assert (got[1].two.first, got[1].two.cigar) == (22, "68M")
    if strand == "+":
        assert (got[1].one.start, got[1].two.start) == (124, 244 - 68)
    else:
        assert (got[1].one.start, got[1].two.start) == (300 - 60, 180)
    assert extend([("ACGTACGTAC", "GGGG", "ACGTACGTACGGGG", 5, False)]) == [None]
    assert primer_end("AACC-", "AACCT") is None


def test_dedup(spark):
    rows = [(1, "p", "u", 5), (2, "p", "u", 9), (3, "p", "u", 9), (4, "p", "v", None), (5, "q", "u", 1), (6, None, "u", 9), (7, "p", None, 1), (2, "p", "u", 9)]
    df = spark.createDataFrame(rows, "read_index long, probe_id string, uid string, score long")
    probes = spark.createDataFrame([("p",), ("q",), ("r",)], "probe_id string")
    assert {(r.probe_id, r.uid, r.best_index, r.n_pairs) for r in dedup.best_pairs(df).collect()} == {("p", "u", 2, 4), ("p", "v", 4, 1), ("q", "u", 5, 1)}
    assert sorted(r.read_index for r in dedup.reduce_duplicates(df).collect()) == [2, 2, 4, 5]
    assert sorted(r.read_index for r in dedup.reduce_duplicates(df, policy="mark").where("is_duplicate").collect()) == [1, 3]
    assert dedup.reduce_duplicates(df, policy="keep").count() == 6
    assert {tuple(r) for r in dedup.probe_stats(df, probes).collect()} == {("p", 2, 3, 5, 2.5, 4), ("q", 1, 0, 1, 1.0, 1), ("r", 0, 0, 0, 0.0, 0)}
    assert dedup.best_pairs(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="policy"):
        dedup.reduce_duplicates(df, policy="x")


def test_checks(spark):
    df = spark.createDataFrame([("GATTACACGTACGTACGTAA", "ACGTACGTACGT"), ("GATTACAGGGG", "ACGTACGTACGT")], "r string, p string")
    assert {r.r[-2:]: r.uid for r in checks.variable_uids(df, "r", "p").collect()} == {"AA": "GATTAC", "GG": None}
    L = F.lit
    at = [L(x) for x in (100, 120, 300, 320)]
    ok = spark.range(1).select(
        checks.fits_probe(L(100), L(40), L(50), L(1), L("+"), *at), checks.fits_probe(L(291), L(30), L(30), L(2), L("+"), *at), checks.fits_probe(L(101), L(40), L(50), L(1), L("+"), *at), checks.fits_probe(L(81), L(40), L(50), L(1), L("-"), *at)
    ).first()
    assert tuple(ok) == (True, True, False, True)
    with pytest.raises(Exception, match="not trimmed"):
        checks.verify_trimmed(spark.range(5), "id", 3).collect()
    assert checks.verify_trimmed(spark.range(5), "id", 4).count() == 5
    one = spark.createDataFrame([(0, "a", "f1"), (1, "b", "f1")], "read_index long, name string, path string")
    aln = spark.createDataFrame([(1,), (2,)], "mate int")
    assert all(r.ok for r in checks.input_report(one, one.withColumn("path", F.lit("f2")), aln).collect())
    assert {r.check for r in checks.input_report(one, one.limit(1), aln.limit(1)).collect() if not r.ok} >= {"files differ", "equally many records", "names agree", "alignments of both mates"}


def test_merged_words(spark):
    got = words.merge_words(["abc", "bcd", "ace"])
    for w in ("abc", "bcd", "ace"):
        it = iter(got)
        assert all(ch in it for ch in w)
    assert len(got) == 5 and words.merge_words([]) == "" and words.merged_pair("abcd", "bd") == "abcd"
    df = spark.createDataFrame([("k", "ab"), ("k", "bc"), ("j", None), ("l", "x")], "g string, word string")
    assert {tuple(r) for r in words.merged_words(df, "g", "word").collect()} == {("k", "abc"), ("l", "x")}


def test_merged_words_of_large_groups(spark):
    rnd = random.Random(3)
    many = sorted({"".join(rnd.choices("abc", k=rnd.randrange(1, 5))) for _ in range(60)})
    df = spark.createDataFrame([("big", w) for w in many] + [("small", "ab"), ("small", "b"), (None, "x")], "g string, word string")
    got = {r.g: r.merged for r in words.merged_words(df, "g", "word", most=8).collect()}

    def holds(text, word):
        it = iter(text)
        return all(c in it for c in word)

    assert set(got) == {"big", "small"} and got["small"] == "ab" and all(holds(got["big"], w) for w in many)


def test_letter_alignment(spark):
    rows = [(1, ["a", "rose", "is", "a", "rose"], ["a", "rose", "was", "rose"]), (2, [], ["x"]), (3, None, ["x"]), (4, ["x", "y", "z", "x", "y"], ["y", "z"])]
    df = spark.createDataFrame(rows, "id long, r array<string>, q array<string>")
    got = {r.id: r for r in letter_alignments(df, "id", "r", "q").collect()}
    assert set(got) == {1, 2, 4}
    for i, r, q in rows:
        if i in got:
            assert [x for x in got[i].ref_aligned if x is not None] == r and [x for x in got[i].qry_aligned if x is not None] == q and len(got[i].ref_aligned) == len(got[i].qry_aligned)
    assert got[4].qry_aligned == [None, "y", "z", None, None] and got[4].score == 2.0


def test_neighbours_of_thin_features(spark):
    """Far apart features, a few of them long: what tiles and wide tiles leave open is answered in the container."""
    rnd = random.Random(9)
    rows = [("c", a, a + rnd.choice([1, 2, 5000])) for a in sorted(rnd.sample(range(40_000), 300))]
    df = spark.createDataFrame(rows, "c string, s long, e long")
    got = {(r.s, r.e): (r.to_s, r.to_e) for r in intervals.neighbours(df, "c", "s", "e", wrap=False, tile=4).withColumnsRenamed({"to_start": "to_s", "to_stop": "to_e"}).collect()}
    for _, s, e in rows:
        later = [(x, y) for _, x, y in rows if x > s and y > e]
        assert got[s, e] == (min(later) if later else (None, None))


def test_quantiles_of_one_group_over_parts(spark):
    rnd = random.Random(2)
    values = [rnd.gauss(0, 1) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    q = st.five_numbers(df, [], F.col("v")).first()
    ordered = sorted(values)
    assert q.median == (ordered[1499] + ordered[1500]) / 2 and q.q1 == (ordered[749] + ordered[750]) / 2 and (q.least, q.greatest) == (ordered[0], ordered[-1])
    got = [r.v for r in st.places(df, ["v"]).orderBy("place").collect()]
    assert got == ordered


def test_range_join_of_very_different_lengths(spark):
    rnd = random.Random(6)

    def some(n):
        return [(i, rnd.choice("xy"), a, a + rnd.choice([0, 3, 70, 5000, 3_000_000])) for i, a in enumerate(rnd.choices(range(5_000_000), k=n))]

    rows, windows = some(300), some(60)
    schema = "i int, container string, start long, stop long"
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(windows, schema)
    for how in ("contained", "overlap"):
        want = {(r[0], w[0]) for r in rows for w in windows if r[1] == w[1] and ((w[2] <= r[2] and r[3] <= w[3]) if how == "contained" else max(r[2], w[2]) <= min(r[3], w[3]))}
        for size in (1 << 30, 0):
            got = [(r.i, r.w_i) for r in joins.range_join(a, b, how=how, broadcast_bytes=size).collect()]
            assert len(got) == len(want) and set(got) == want
    assert joins.range_join(a, b.limit(0)).collect() == []
