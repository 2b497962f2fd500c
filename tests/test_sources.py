"""File formats: reading, writing and round trips on small files written here."""

from __future__ import annotations

import gzip
import random
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from readloom.sources import alignments as A
from readloom.sources import lines as L
from readloom.sources import reads as R
from readloom.sources import tables as T


def _write(path, text, mode="w"):
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    return str(path)


def _lines_of(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_numbered_lines_over_splits(spark, tmp_path):
    text = "".join(f"line {i} {'x' * (i % 50)}\n" for i in range(5000))
    path = _write(tmp_path / "a.txt", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        got = L.numbered_lines(spark, path).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line_no for r in got] == list(range(5000)) and got[4321].line.startswith("line 4321 ")
    lines = L.numbered_lines(spark, path)
    assert [r.line_no for r in L.line_window(lines, 3, 5).orderBy("line_no").collect()] == [3, 4, 5]
    assert L.search(lines, "LINE 77 ").first().column == 0 and L.search(lines, "line", limit=3).count() == 3
    assert L.next_match(lines, "line 9", 100).first().line_no == 900
    assert L.same_text(lines, L.numbered_lines(spark, _write(tmp_path / "b.txt", text.replace("\n", "\r\n"))))
    assert not L.same_text(lines, lines.limit(10))


def test_fastq(spark, tmp_path):
    text = "@r1 1:N:0\nACGT\n+x\nIIII\n@r2/1\nAC\n+\nII\n"
    plain = _write(tmp_path / "a.fastq", text)
    zipped = _write(tmp_path / "a.fastq.gz", gzip.compress(text.encode()))
    for p in (plain, zipped):
        got = [(r.read_index, r.name, r.header, r.seq, r.qual_header, r.qual) for r in R.read_fastq(spark, p).orderBy("read_index").collect()]
        assert got == [(0, "r1", "r1 1:N:0", "ACGT", "x", "IIII"), (1, "r2", "r2/1", "AC", "", "II")]
    R.write_fastq(R.read_fastq(spark, plain), str(tmp_path / "out"))
    assert _lines_of(tmp_path / "out") == text
    for bad in ("@r\nAC\n+\nI\n", "r\nAC\n+\nII\n", "@r\n\n+\n\n", "@r\nAC\n+\n"):
        with pytest.raises(Exception, match="bad FASTQ"):
            R.read_fastq(spark, _write(tmp_path / "bad.fastq", bad)).collect()
        assert R.read_fastq(spark, str(tmp_path / "bad.fastq"), check=False).count() == 1


def test_fasta_and_genome(spark, tmp_path):
    rng = random.Random(1)
    seqs = {f"c{i}": "".join(rng.choices("ACGT", k=rng.randrange(1, 400))) for i in range(5)}
    text = "#note\n" + "".join(f">{k} d\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n" for k, s in seqs.items())
    got = R.read_fasta(spark, _write(tmp_path / "a.fa", text))
    assert {r.description.split()[0]: r.sequence for r in got.collect()} == seqs
    R.write_fasta(got, str(tmp_path / "fa"))
    assert R.read_fasta(spark, str(tmp_path / "fa")).count() == 5
    genome = R.pack_genome(got.select(F.split("description", " ")[0].alias("container"), F.col("sequence").alias("seq")), chunk=50)
    asks = [(i, f"c{i % 5}", a := rng.randrange(1, 100), a + rng.randrange(120), "+-"[i % 2]) for i in range(40)]
    out = R.slices(genome, spark.createDataFrame(asks, "range_id int, container string, start int, stop int, strand string"), chunk=50)
    flip = str.maketrans("ACGT", "TGCA")
    want = {i: s if d == "+" else s.translate(flip)[::-1] for i, c, a, b, d in asks if (s := seqs[c][a - 1 : b])}
    assert {r.range_id: r.sequence for r in out.collect() if r.sequence} == want


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_delimited(spark, tmp_path, encoding, end):
    text = end.join(["some note", "Header1, HEADER2, other", "a, b, c", "", "d, e, f", ""])
    path = _write(tmp_path / f"t{encoding}{len(end)}.csv", text.encode(encoding))
    got = T.read_delimited(spark, path, ["header2", "header1"], delimiter=",", extra=True)
    if encoding == "utf-8":
        assert got.columns == ["header2", "header1", "other"]
        assert sorted(map(tuple, got.collect())) == [("b", "a", "c"), ("e", "d", "f")]
    else:
        assert {("b", "a", "c"), ("e", "d", "f")} <= set(map(tuple, got.collect()))
    with pytest.raises(ValueError, match="no header row"):
        T.read_delimited(spark, path, ["nope"])


PROBE = {"probe_id": "p1", "chromosome": "chr1", "probe_strand": "+", "ext_start": 1, "ext_stop": 4, "ext_sequence": "ACGT", "lig_start": 9, "lig_stop": 12, "lig_sequence": "AAAA", "target_start": 5, "target_stop": 8, "target_sequence": "CCCC", "annotation": "x"}


def test_probes(spark, tmp_path):
    cols = ["rank_score", *reversed(PROBE)]
    head = "#extension_uid=10 ligation_uid=0\textra genome=hg19\n"
    path = _write(tmp_path / "p.txt", head + "\t".join(cols) + "\n" + "\t".join(["0.5", *(str(PROBE[c]) for c in reversed(PROBE))]) + "\n")
    assert T.read_probe_header(spark, path) == {"extension_uid": "10", "ligation_uid": "0", "extra": None, "genome": "hg19"}
    got = T.read_probes(spark, path)
    assert got.first().asDict() == PROBE
    T.write_probes(got, str(tmp_path / "out"), ext_uid=10, lig_uid=2)
    again = str(next((tmp_path / "out").glob("part-*")))
    assert T.read_probes(spark, again).first().asDict() == PROBE and T.read_probe_header(spark, again)["ligation_uid"] == "2"
    turned = T.reverse_complemented_probes(got).first()
    assert (turned.ext_sequence, turned.lig_sequence, turned.ext_start) == ("ACGT", "TTTT", 1)
    bad = _write(tmp_path / "bad.txt", "\t".join(PROBE) + "\n" + "\t".join("x" if c == "ext_stop" else str(v) for c, v in PROBE.items()) + "\n")
    with pytest.raises(Exception, match="bad ext_stop of probe p1: x"):
        T.read_probes(spark, bad).collect()


def test_small_files(spark, tmp_path):
    assert {tuple(r) for r in T.read_name_values(spark, _write(tmp_path / "n.txt", "a=1\nb = 2=3\nnothing\na=4\n")).collect()} == {("a", "4"), ("b", "2=3")}
    bed = 'track name="set 1" use=1\nchr1\t5\t2\tn\t7\t-\nbrowser x\nchr1\tx\t2\ntrack name=two\nchr2 1 2\n'
    got = {r.line_no: r for r in T.read_bed(spark, _write(tmp_path / "a.bed", bed)).collect()}
    assert (got[1].kind, got[1].score, got[3].reason, got[5].track["name"], got[2].kind) == ("entry", 7, "chrom_start", "two", "skipped")
    entries = T.read_bed(spark, str(tmp_path / "a.bed")).where("kind = 'entry'")
    assert {tuple(r) for r in T.bed_contexts(entries).collect()} == {("chr1", 2, 5, "-"), ("chr2", 1, 2, "+")}
    gff = "chr1\ts\texon\t1\t9\t.\t+\t0\tid=1\nshort\tline\n"
    assert [(r.container, r.start, r.stop, r.score, r.attributes) for r in T.read_gff(spark, _write(tmp_path / "a.gff", gff)).collect()] == [("chr1", 1, 9, None, "id=1")]
    assert T.file_digests(spark, str(tmp_path / "a.gff")).first().length == len(gff)
    assert T.read_settings("FIND:\n  k: 5 # words\n  ratio: 0.5\nTRIM:\n  on: true\nname: 'x'\n") == {"FIND": {"k": 5, "ratio": 0.5}, "TRIM": {"on": True}, "name": "x"}
    T.write_delimited(spark.createDataFrame([(1, None), (2, "b")], "a int, b string").coalesce(1), str(tmp_path / "rep"), pre_header="# top")
    assert _lines_of(tmp_path / "rep") == "# top\na\tb\n1\t\n2\tb\n"


SAM = [
    "@HD\tVN:1.6", "@SQ\tSN:chr1\tLN:1000", "@SQ\tSN:chr2\tLN:500", "@RG\tID:g1",
    "r1\t99\tchr1\t10\t60\t3S5M1D2M\t=\t50\t60\tACGTACGTAC\tIIIIIIIIII\tNM:i:1\tMD:Z:5^A2\tXA:Z:chr2,-7,10M,0;bad;\tRG:Z:g1",
    "r1\t147\tchr1\t50\t60\t4M\t=\t10\t-60\tACGT\tIIII\tNM:i:0", "r2\t4\t*\t0\t0\t*\t*\t0\t0\tNN\t*", "short\tline",
]


def test_sam_and_bam(spark, tmp_path):
    path = _write(tmp_path / "a.sam", "\n".join(SAM) + "\n")
    sam = A.read_sam(spark, path)
    got = {(r.name, r.mate): r for r in sam.collect()}
    one = got["r1", 1]
    assert (one.start, one.end, one.strand, one.nm, one.md, one.rg, one.mapped, got["r2", 1].mapped, got["r1", 2].strand) == (10, 17, "+", 1, "5^A2", "g1", True, False, "-")
    assert [tuple(x) for x in one.xa] == [("chr2", 7, "-", "10M", 0)]
    assert {tuple(r) for r in A.dictionary(A.read_header(spark, path)).collect()} == {("chr1", 1000), ("chr2", 500)}
    assert A.in_range(sam, "chr1", 17, 20).count() == 1 and A.in_range(sam, "chr1", 10, 16, contained=True).count() == 0
    sizes = [("chr1", 1000), ("chr2", 500)]
    A.write_sam(sam, str(tmp_path / "out"), A.header_lines(sizes))
    plain = [c for c in sam.columns if c != "tags"] + [F.array_sort(F.map_entries("tags")).alias("tags")]
    back = A.read_sam(spark, str(tmp_path / "out"))
    assert sorted(map(str, back.select(plain).collect())) == sorted(map(str, sam.select(plain).collect()))
    A.write_bam(sam, str(tmp_path / "a.bam"), sizes, A.header_lines(sizes))
    bam = A.read_bam(spark, str(tmp_path / "a.bam"))
    assert sorted(map(str, bam.select(plain).collect())) == sorted(map(str, sam.select(plain).collect()))
    members = list(A.gzip_blocks((tmp_path / "a.bam").read_bytes()))
    assert members[-1][2] == b"" and len(members) >= 3
    with pytest.raises(ValueError, match="cut off|gzip"):
        list(A.gzip_blocks((tmp_path / "a.bam").read_bytes()[:-5]))
    assert [r.name for r in A.sorted_by_name(sam, sam.where("name = 'r2'")).collect()] == ["r1", "r1"]


def _bam_of(spark, path, n, long=0):
    """A BAM file of n reads, `long` of which are longer than a split, and its reads."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        k = 200_000 if i < long else rng.randrange(1, 60)
        rows.append((f"r{i}", 65, f"chr{i % 3}", 1 + i % 500, 60, f"{k}M", "*", 0, 0, "".join(rng.choices("ACGTNRM=", k=k)), "".join(map(chr, rng.choices(range(33, 73), k=k))), {"NM": str(i % 7), "RG": "g\u00e9"}))
    df = spark.createDataFrame(rows, A._COLUMNS).withColumn("mate", F.lit(1))
    A.write_bam(df, path, [(f"chr{i}", 10_000) for i in range(3)], A.header_lines([(f"chr{i}", 10_000) for i in range(3)]))
    return sorted(map(str, df.drop("mate", "tags").collect()))


@pytest.mark.parametrize(("split", "long"), [("4k", 0), ("70k", 0), ("300k", 3), ("128m", 0)])
def test_bam_in_splits(spark, tmp_path, split, long):
    """A BAM file is read by as many tasks as it has splits, in whichever its records begin and end (before: by one)."""
    path = str(tmp_path / "a.bam")
    want = _bam_of(spark, path, 12_000, long)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        bam = A.read_bam(spark, path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(map(str, bam.select(*[c.split()[0] for c in A._COLUMNS.split(", ")][:11]).collect())) == want
    assert {tuple(r) for r in bam.select("nm", "rg").distinct().collect()} == {(i, "g\u00e9") for i in range(7)}
    tasks = bam.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= (1 if split == "128m" else 3) and "union" not in bam._jdf.queryExecution().toString().lower()  # not as a whole


def test_bam_otherwise_packed(spark, tmp_path):
    """Plain gzip members, the mark of a block within one by chance, files of both kinds together, and broken ones."""
    path = str(tmp_path / "a.bam")
    want = _bam_of(spark, path, 300)
    content = b"".join(c for _, _, c in A.gzip_blocks((tmp_path / "a.bam").read_bytes()))
    cols = [c.split()[0] for c in A._COLUMNS.split(", ")][:11]
    many = tmp_path / "many"
    many.mkdir()
    _write(many / "gzip b.bam", gzip.compress(content[:5000]) + gzip.compress(content[5000:]))
    _write(many / "c.bam", (tmp_path / "a.bam").read_bytes())
    stored = zlib.compressobj(0, zlib.DEFLATED, -15)
    n, text = struct.unpack_from("<i", content, 4)[0], b"@CO\t" + A._MARK + b"\n"
    marked = content[:4] + struct.pack("<i", n + len(text)) + content[8 : 8 + n] + text + content[8 + n :]
    body = stored.compress(marked[:60_000]) + stored.flush()
    member = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(marked[:60_000]), len(marked[:60_000]))
    assert member.count(A._MARK) == 2
    _write(many / "d.bam", member + A._bgzf(marked[60_000:]) + A._bgzf(b""))
    assert sorted(map(str, A.read_bam(spark, str(many)).select(*cols).collect())) == sorted(want * 3)
    good = (tmp_path / "a.bam").read_bytes()
    A.write_bam(spark.createDataFrame([], A._COLUMNS).withColumn("mate", F.lit(1)), str(tmp_path / "none.bam"), [("chr1", 9)], A.header_lines([("chr1", 9)]))
    assert A.read_bam(spark, str(tmp_path / "none.bam")).count() == 0 and A.read_bam(spark, [path, path]).count() == 2 * len(want)
    assert len(content) < 65_280
    for k, (bad, why) in enumerate([(good[:-40], "cut off"), (good[:200] + bytes([good[200] ^ 1]) + good[201:], "decompress"), (A._bgzf(content[:-7]) + A._bgzf(b""), "cut off"), (b"no BAM", "no gzip"), (A._bgzf(b"no BAM"), "not a BAM"), (A._bgzf(content + b"\0" * 40), "no BAM record")]):
        with pytest.raises(Exception, match=why):
            A.read_bam(spark, _write(tmp_path / f"bad{k}.bam", bad)).collect()


def test_consistency(spark):
    """Clips, an insertion and a deletion: read TT|ACG.G.TA|C over reference ACGTACCC."""
    rows = [
        ("2S3M1I2M2D1M", "TTACGGTAC", "5^CC1", 3, "ACGTACCC", []), ("2S3M1I2M2D1M", "TTACGGTAC", "5^CC1", 2, "ACGTACCC", ["nm"]), ("2S3M1I2M2D1M", "TTACGGTAC", "5^CG1", 3, "ACGTACCC", ["md_reference"]),
        ("2S3M1I2M2D1M", "TTACGGTAC", "6^CC1", 3, "ACGTACCC", ["md_length"]), ("2S3M1I2M2D1M", "TTACGGTAC", None, 3, "ACGTACCC", ["no_md"]), ("2S3M1I2M2D1M", "TTACGGTAC", "5^CC1", 3, "ACGNACCC", ["reference_n"]),
        ("4M", "ACGT", "2T1", 1, "ACTT", []), ("4M", "ACGT", "4", 0, "ACTT", ["md_reference"]), ("4M", "ACGTA", "4", 0, "ACGT", ["cigar_length"]), ("4M", "ACGT", "2T1", None, "ACTT", ["nm"]),
    ]
    df = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(rows)], "i int, cigar string, seq string, md string, nm int, under string")
    got = {r.i: r.issues for r in A.consistency(df, F.col("under")).collect()}
    assert got == {i: r[5] for i, r in enumerate(rows)}


def test_consistency_of_long_reads(spark):
    """Random operations within clips, right, with another NM, a base too many or another reference; the time is in proportion to the length (before: minutes for these)."""
    from readloom.operators.alignment import _details, _summary

    rng, rows = random.Random(5), []
    for i, n in enumerate([*range(1, 61), *[16_000] * 8]):
        ops = "".join(rng.choices("=XID", (200, 20, 1, 1), k=n)) + "="
        ref = ["-" if o == "I" else rng.choice("ACGT") for o in ops]
        read = "".join(r if o == "=" else {"A": "C", "C": "G", "G": "T", "T": "A", "-": "A"}[r] for r, o in zip(ref, ops, strict=True) if o != "D")
        under = "".join(ref).replace("-", "")
        if i % 4 == 3:
            under = {"A": "C", "C": "G", "G": "T", "T": "A"}[under[0]] + under[1:]
        cigar = "2H3S" + _summary(ops.replace("=", "M").replace("X", "M")) + "1S"
        issues = [[], ["nm"], ["cigar_length"], ["md_reference"]][i % 4]
        rows.append((i, cigar, "NNN" + read + "A" * (2 if i % 4 == 2 else 1), _details("".join(ref), ops), sum(o != "=" for o in ops) + (i % 4 == 1), under, issues))
    df = spark.createDataFrame(rows, "i int, cigar string, seq string, md string, nm int, under string, want array<string>")
    began = time.monotonic()
    got = A.consistency(df, F.col("under")).collect()
    assert time.monotonic() - began < 30
    assert len(got) == len(rows) and all(r.issues == r.want for r in got)


def test_changes_of_a_folder(spark, tmp_path):
    from readloom.streaming import files

    for n in "abc":
        (tmp_path / f"{n}.txt").write_text(n)
    before = spark.createDataFrame(files.listing(spark, str(tmp_path)).collect(), "path string, length long, modified timestamp")
    (tmp_path / "a.txt").unlink()
    (tmp_path / "b.txt").write_text("longer")
    (tmp_path / "d.txt").write_text("d")
    got = {r.path.rsplit("/", 1)[1]: r.event for r in files.changes(before, files.listing(spark, str(tmp_path), pattern="txt$")).collect()}
    assert got == {"a.txt": "removed", "b.txt": "modified", "d.txt": "created"}
