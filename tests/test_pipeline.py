"""The commands end to end on reads made from known probes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from readloom.operators.alignment import flip
from readloom.operators.dedup import trim_lengths
from readloom.plans import pipeline as P
from readloom.sources.alignments import read_sam

SCHEMA = "probe_id string, container_name string, strand string, ext_start int, ext_stop int, ext_sequence string, lig_start int, lig_stop int, lig_sequence string, target_start int, target_stop int, target_sequence string"


def _case(seed=5):
    rng = random.Random(seed)

    def dna(n):
        return "".join(rng.choices("ACGT", k=n))

    probes, fastq, sam = [], [], []
    for k, (at, strand) in enumerate([(1000, "+"), (5000, "-"), (9000, "+")]):
        ext, target, lig = dna(24), dna(110), dna(22)
        if strand == "+":
            probes.append((f"P{k}", "chr1", strand, at, at + 23, ext, at + 134, at + 155, lig, at + 24, at + 133, target))
        else:
            probes.append((f"P{k}", "chr1", strand, at + 132, at + 155, ext, at, at + 21, lig, at + 22, at + 131, target))
        whole = ext + target + lig
        for copy in range(6):
            uid = ["AAAAACCCCC", "GGGGGTTTTT"][copy % 2]
            name, q = f"r{k}{copy}", "?ABCDE"[copy]
            r1, r2 = uid + whole[:90], flip(whole)[::-1][:95]
            if k == 2 and copy == 5:
                r2 = "N" + r2[1:]
            fastq += [(name, 1, k * 10 + copy, r1, q * len(r1)), (name, 2, k * 10 + copy, r2, q * len(r2))]
            forward, back = (at, at + 61) if strand == "+" else (at + 66, at)
            n1, n2 = 90, 95
            s1, s2 = ("+", "-") if strand == "+" else ("-", "+")
            f1, f2 = (forward, at + 61) if strand == "+" else (at + 66, at)
            sam.append(f"{name}\t{67 + (16 if s1 == '-' else 32)}\tchr1\t{f1}\t60\t{n1}M\t=\t{f2}\t0\t{r1[10:]}\t{'I' * n1}")
            sam.append(f"{name}\t{131 + (16 if s2 == '-' else 32)}\tchr1\t{f2}\t60\t{n2}M\t=\t{f1}\t0\t{r2}\t{'I' * n2}")
    return probes, fastq, sam


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    probes, fastq, sam = _case()
    path = tmp_path_factory.mktemp("sam") / "a.sam"
    path.write_text("\n".join(sam) + "\n")
    return read_sam(spark, str(path)), spark.createDataFrame(fastq, "name string, mate int, read_index long, seq string, qual string"), spark.createDataFrame(probes, SCHEMA), probes


def test_dedup(tables):
    aln, reads, probes, plain = tables
    got = P.dedup(aln, reads, probes).collect()
    # Of each probe and barcode the copy of best quality; the pair with N is no candidate.
    assert {(r.probe_id, r.uid, r.read_index) for r in got} == {
        (f"P{k}", u, k * 10 + c) for k in range(3) for u, c in (("AAAAACCCCC", 4), ("GGGGGTTTTT", 3 if k == 2 else 5))
    }
    by = {p[0]: p for p in plain}
    for r in got:
        p = by[r.probe_id]
        assert r.extended and r.one.edit_distance == 0
        assert r.one.start == (p[4] + 1 if p[2] == "+" else p[3] - 66)


def test_dedup_policies_and_merging(tables):
    aln, reads, probes, plain = tables
    marked = P.dedup(aln, reads, probes, P.DedupOptions(policy="mark"))
    assert marked.count() == 17 and marked.where("is_duplicate").count() == 11
    merged = P.dedup(aln, reads, probes, P.DedupOptions(merge_pairs=True)).collect()
    by = {p[0]: p for p in plain}
    assert len(merged) == 6 and all(r.merged.seq in (by[r.probe_id][11], flip(by[r.probe_id][11])[::-1]) for r in merged)


def test_dedup_reports(spark, tables):
    """Counts without the pairs that can't be extended: here the best pair of one barcode, whose read one is no primer's."""
    aln, reads, probes, _ = tables
    broken = reads.withColumn("seq", F.when((F.col("read_index") == 4) & (F.col("mate") == 1), F.concat(F.lit("AAAAACCCCC"), F.repeat(F.lit("T"), 90))).otherwise(F.col("seq")))
    run = P.dedup_run(aln, broken, probes, prefix="s")
    assert {r.read_index for r in run.pairs.collect()} == {5, 13 + 1, 15, 24, 23}
    per = {r.probe_id: (r.unique_pairs, r.duplicate_pairs, r.total_pairs, r.max_pairs_per_uid) for r in run.probe_details.collect()}
    assert per == {"P0": (1, 4, 5, 3), "P1": (2, 4, 6, 3), "P2": (2, 3, 5, 3)}
    s = run.summary.first()
    assert (s.sample_prefix, s.pairs_with_both_reads_mapped, s.pairs_with_on_target_reads, s.pairs_with_off_target_reads, s.unique_read_pairs, s.duplicate_read_pairs_removed) == ("s", 18, 16, 2, 5, 11)
    assert run.uid_tallies.count() == 6
    marked = P.dedup_run(aln, broken, probes, P.DedupOptions(policy="mark"))
    assert {r.probe_id: (r.unique_pairs, r.duplicate_pairs) for r in marked.probe_details.collect()}["P0"] == (1, 4)
    with pytest.raises(ValueError, match="no alignment has a read"):
        P.dedup(aln, reads.withColumn("name", F.lit("other")), probes)


def test_ambiguous_probes(spark, tables):
    aln, reads, probes, _ = tables
    twin = probes.where("probe_id = 'P0'").withColumn("probe_id", F.lit("twin"))
    other = probes.where("probe_id = 'P0'").withColumn("probe_id", F.lit("other")).withColumn("ext_sequence", F.lit("T" * 24)).withColumn("target_sequence", F.reverse("target_sequence"))
    worse = P.dedup(aln, reads, probes.unionByName(other))
    assert {r.probe_id for r in worse.collect()} == {"P0", "P1", "P2"}
    tied = P.dedup(aln, reads, probes.unionByName(twin))
    assert {r.probe_id for r in tied.collect()} == {"P1", "P2"}


def test_trim(spark, tables):
    _, reads, probes, _ = tables
    lengths = trim_lengths(probes)
    assert tuple(lengths.first()) == (34, 132, 22, 134)
    one = P.trim(reads.where("mate = 1"), lengths, mate=1).first()
    assert len(one.seq) == len(one.qual) == 66
    a, b = reads.where("mate = 1").select("read_index", "name"), reads.where("mate = 2").select("read_index", "name")
    assert P.mismatched_names(a, b).count() == 0
    assert P.mismatched_names(a, b.where("read_index != 0")).count() == 1


def test_find_and_trim(spark):
    target = "ACGGTTCAAGCTTACC"
    rows = [(1, "TTTTT" + target + "GGGGG", None), (2, "TTTTTTTTTTTTTTTTTTTTTTTTTT", None), (3, "NACGT" + target, None), (4, "CC" + target[:7] + "T" + target[8:] + "AA", None), (5, flip(target)[::-1] + "CATCATCAT", None)]
    reads = spark.createDataFrame([(i, s, "I" * len(s)) for i, s, _ in rows], "read_index long, seq string, qual string")
    wanted = spark.createDataFrame([("t", "1", target)], "primary_id string, secondary_id string, seq string")
    got = {r.read_index: r for r in P.find_and_trim(reads, wanted).collect()}
    assert {i: r.status for i, r in got.items()} == {1: "single", 2: "none", 3: "skipped", 4: "single", 5: "single"}
    assert (got[1].before, got[1].found, got[1].after, got[1].seq, len(got[1].qual)) == ("TTTTT", target, "GGGGG", target + "GGGGG", 21)
    assert (got[4].before, got[5].orientation, got[5].after, got[2].seq) == ("CC", "RVS_CMP", "CATCATCAT", rows[1][1])
    s = P.find_summary(P.find_and_trim(reads, wanted)).first()
    assert (s.reads, s.single, s.none, s.skipped, s.pct_single) == (5, 3, 1, 1, 60.0)
    assert [tuple(r) for r in P.match_summary(P.find_and_trim(reads, wanted)).collect()] == [("t", "1", 3, 0, 3)]
    assert P.find_and_trim(reads.limit(0), wanted).collect() == []


@pytest.mark.parametrize("gaps", [False, True])
def test_find_and_trim_passes_over_nothing(spark, gaps):
    """A sequence with up to two changes at any place, or with a gap, among random letters is always aligned; few others are."""
    rnd = random.Random(7)
    target, long = "ACGGTTCAAGCT", "ACGGTTCAAGCTTACCGATCAGGT"
    flank = lambda: "".join(rnd.choices("ACGT", k=30))
    rows = []
    if gaps:
        o = P.FindOptions(mismatches=1, insertion_gaps=1, insertion_bases=2, deletion_gaps=1, deletion_bases=1, orientations=("FWD",))
        for i in range(3, 21):
            rows += [long[:i] + "TA"[: 1 + i % 2] + long[i:], long[:i] + long[i + 1 :]]
        sought = long
    else:
        o, sought = P.FindOptions(orientations=("FWD",)), target
        for i in range(12):
            for j in range(i, 12):
                s = list(target)
                for k in {i, j}:
                    s[k] = "ACGT"["ACGT".index(s[k]) - 1]
                rows.append("".join(s))
    df = spark.createDataFrame([(n, x, "I" * len(x)) for n, x in enumerate(flank() + s + flank() for s in rows)], "read_index long, seq string, qual string")
    wanted = spark.createDataFrame([("t", "1", sought)], "primary_id string, secondary_id string, seq string")
    work = P._near(df.select(F.col("seq").alias("text")), wanted.select(F.col("seq").alias("sought")), o)
    assert work.distinct().count() == len(rows)
    others = spark.createDataFrame([(flank() + flank(),) for _ in range(400)], "text string")
    assert P._near(others, wanted.select(F.col("seq").alias("sought")), o).count() < 40


def test_find_and_trim_outputs(spark):
    target = "ACGGTTCAAGCTTACC"
    seq = "TTTTT" + target[:7] + "T" + target[8:] + "GGGGG"
    reads = spark.createDataFrame([(1, seq, "I" * len(seq)), (2, "T" * 20, "I" * 20)], "read_index long, seq string, qual string")
    wanted = spark.createDataFrame([("t", "1", target)], "primary_id string, secondary_id string, seq string")
    o = P.FindOptions(keep_found=False, replace_found=True, notes={"before": "uid", "primary_id": "probe_id", "orientation": "orientation", "found": "found"})
    got = {r.read_index: r for r in P.find_and_trim(reads, wanted, o).collect()}
    assert (got[1].seq, got[1].qual) == (target + "GGGGG", "~" * 16 + "I" * 5)
    assert got[1].notes == f"uid=TTTTT found={target[:7]}T{target[8:]} probe_id=t orientation=FWD " and got[2].notes is None and got[2].seq == "T" * 20
    bounded = P.find_and_trim(reads, wanted, P.FindOptions(limit=10, least_ratio=0.5))
    assert {r.read_index: r.status for r in bounded.collect()} == {1: "single", 2: "none"}
    with pytest.raises(ValueError, match="notes"):
        P.find_and_trim(reads, wanted, P.FindOptions(notes={"x": "y"}))


def test_find_settings(spark):
    from readloom.sources.tables import read_settings

    text = """FIND:
  Allowed_Mismatch_Bases: 1
  Include_Reverse_Version_Of_Search_Sequence: false
TRIM:
  Remove_Pre_Text_In_Output: true
  Replace_Found_Text_With_Search_Sequence: true
  Add_Pre_Text_To_FastQ_Annotation_With_Following_Key: uid
  Leading_Quality_Trim_Threshold: 5
"""
    o = P.find_options(read_settings(text))
    assert (o.mismatches, o.orientations, o.keep_before, o.keep_after, o.keep_found, o.replace_found, o.notes, o.leading_quality) == (1, ("FWD", "RVS_CMP", "CMP"), False, True, False, True, {"before": "uid"}, 5)
    assert P.find_options({}) == P.FindOptions()
    rows = [(1, "single", "p", "AC"), (2, "multiple", "p", "AC"), (2, "multiple", "q", "GG"), (3, "none", None, "TT"), (4, "skipped", None, "N")]
    found = spark.createDataFrame(rows, "read_index long, status string, primary_id string, seq string").withColumn("qual", F.lit("I"))
    files = lambda **k: sorted((r.read_index, r.file) for r in P.routed(found, **k).collect())
    assert files() == [(1, "match"), (2, "multiple"), (2, "multiple"), (3, "no_match")]
    assert files(multiple="no_match", none="exclude") == [(1, "match"), (2, "no_match")] and files(multiple="exclude", none="match") == [(1, "match"), (3, "match")]
    with pytest.raises(ValueError, match="output"):
        P.routed(found, multiple="x")


def test_paired_files(spark):
    rows = [(f, i, n) for f, names in {"a": "xyz", "b": "xyz", "c": "xzy", "d": "x", "e": "q", "f": "q", "g": "q"}.items() for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "path string, read_index int, name string")
    assert [(r.one, r.two) for r in P.paired_files(df).collect()] == [("a", "b")]


def test_streams(spark, tmp_path):
    from readloom.streaming import files

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "in" / "skip.log").write_text("no\n")
    seen: list = []
    for _ in range(2):
        q = files.file_events(files.watch_folder(spark, str(tmp_path / "in"), pattern=r"\.txt$"), seen.append, str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
        (tmp_path / "in" / "b.txt").write_text("three\n")
    assert [[p.rsplit("/", 1)[1] for p in s] for s in seen if s] == [["a.txt"], ["b.txt"]]
