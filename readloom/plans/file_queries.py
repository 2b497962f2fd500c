"""Queries that write tables in the file formats, read them again, and compare; with the SQL of what must come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import cigar as C
from readloom.functions import sequence as S
from readloom.functions import text as X
from readloom.operators import intervals
from readloom.operators.checks import checked_files
from readloom.operators.checks import input_report as report
from readloom.operators.statistics import places
from readloom.plans.read_queries import table
from readloom.session import scratch, spread
from readloom.sources import alignments as A
from readloom.sources import lines as L
from readloom.sources import reads as R
from readloom.sources import tables as T
from readloom.streaming.files import changes, mapped_lines, watch_folder

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _reads(spark: SparkSession, sf: str) -> DataFrame:
    """One whole read a read_index, numbered without gaps."""
    one = table(spark, sf, "pairs").where("length(r1_seq) = length(r1_qual) and length(r1_seq) > 0").groupBy("read_index").agg(F.min("read_name").alias("header"), F.min(F.struct("r1_seq", "r1_qual")).alias("m"))
    return one.where("read_index is not null and header is not null").select("read_index", "header", F.lit("").alias("qual_header"), F.col("m.r1_seq").alias("seq"), F.col("m.r1_qual").alias("qual"))


_READS = """r as (select read_index, min(read_name) as header, min(struct_pack(s := r1_seq, q := r1_qual)) as m from pairs where length(r1_seq) = length(r1_qual) and length(r1_seq) > 0 group by 1),
x as (select read_index, header, m.s as seq, m.q as qual from r where read_index is not null and header is not null)"""


@query(f"with {_READS} select nullif(regexp_extract(header, '^[^ /]*'), '') as name, header, seq, qual from x")
def fastq_round_trip(spark, sf):
    """Read ones of pairs written as FASTQ and read again."""
    path = scratch(spark, "fastq")
    R.write_fastq(_reads(spark, sf), path)
    return R.read_fastq(spark, path).select("name", "header", "seq", "qual")


@query("select probe_id as description, target_sequence as sequence from probes")
def fasta_round_trip(spark, sf):
    """Targets written as FASTA in lines of 60 bases and read again."""
    path = scratch(spark, "fasta")
    p = table(spark, sf, "probes")
    R.write_fasta(p.select(F.col("probe_id").alias("description"), F.array_join(X.wrapped("target_sequence", 60), "\n").alias("sequence")), path)
    return R.read_fasta(spark, path).select("description", "sequence")


@query("""with g as (select probe_id, strand, ext_sequence || target_sequence || lig_sequence as s from probes), t as (select probe_id as range_id, strand, substr(s, 11, 60) as p from g)
select range_id, strand, case when strand = '-' then reverse(translate(p, 'ACGTN', 'TGCAN')) else p end as sequence from t""")
def genome_slices(spark, sf):
    """Bases 11 to 70 of each probe's whole sequence, from a genome packed in pieces of 32 bases."""
    p = table(spark, sf, "probes")
    genome = R.pack_genome(p.select(F.col("probe_id").alias("container"), F.concat("ext_sequence", "target_sequence", "lig_sequence").alias("seq")), chunk=32)
    ranges = p.select(F.col("probe_id").alias("range_id"), F.col("probe_id").alias("container"), F.lit(11).alias("start"), F.lit(70).alias("stop"), "strand")
    return R.slices(genome, ranges, chunk=32).select("range_id", "strand", "sequence")


def _probe_columns(p: DataFrame) -> DataFrame:
    return p.select("probe_id", F.col("container_name").alias("chromosome"), F.col("strand").alias("probe_strand"), *list(T.PROBE_COLUMNS)[3:])


@query("select probe_id, container_name as chromosome, strand as probe_strand, ext_start, ext_stop, ext_sequence, lig_start, lig_stop, lig_sequence, target_start, target_stop, target_sequence, coalesce(trim(annotation), '') as annotation from probes")
def probe_file_round_trip(spark, sf):
    """Probes written as a probe file with its header and read again; no annotation is an empty one."""
    path = scratch(spark, "probes")
    T.write_probes(_probe_columns(table(spark, sf, "probes")), path, ext_uid=10, lig_uid=0)
    return T.read_probes(spark, path)


@query("select c_custkey::varchar as c_custkey, c_name, c_mktsegment as extra from customer")
def delimited_scan(spark, sf):
    """Customers written with a line before the header, found again by header names of other case and order."""
    path = scratch(spark, "delimited")
    T.write_delimited(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("extra"), F.col("c_name").alias("C_NAME"), "c_custkey"), path, pre_header="# customers")
    return T.read_delimited(spark, path, ["c_custkey", "c_name"], extra=True)


@query("select 'order' || o_orderkey as name, max(o_orderpriority) as value from orders group by 1")
def name_values(spark, sf):
    """Orders' priorities as name=value lines."""
    path = scratch(spark, "values")
    table(spark, sf, "orders").select(F.concat(F.lit("order"), F.col("o_orderkey"), F.lit("="), F.col("o_orderpriority")).alias("value")).write.text(path)
    return T.read_name_values(spark, path)


_ENTRY = "lower(trim(container_name)) as container, least(chrom_start, chrom_end) as start, greatest(chrom_start, chrom_end) as stop, case when strand = '-' then '-' else '+' end as strand"


@query(f"select {_ENTRY} from features where chrom_start is not null and chrom_end is not null")
def bed_scan(spark, sf):
    """Features written as BED lines under a track line; entries read again as coordinates in order."""
    path = scratch(spark, "bed")
    f = table(spark, sf, "features").where("chrom_start is not null and chrom_end is not null")
    row = F.concat_ws("\t", F.lower(F.trim("container_name")), F.col("chrom_start").cast("string"), F.col("chrom_end").cast("string"), F.lit("n"), F.lit("."), F.coalesce("strand", F.lit(".")))
    f.select(row.alias("value")).write.text(path)
    return T.bed_contexts(T.read_bed(spark, path).where("kind = 'entry'"))


@query("select lower(trim(container_name)) as container, feature_name as feature, chrom_start as start, chrom_end as stop, score from features where chrom_start is not null and chrom_end is not null and feature_name is not null")
def gff_scan(spark, sf):
    """Features written as GFF; lines of other than nine columns are left out."""
    path = scratch(spark, "gff")
    f = table(spark, sf, "features").where("chrom_start is not null and chrom_end is not null and feature_name is not null")
    cells = [F.lower(F.trim("container_name")), F.lit("s"), F.col("feature_name"), F.col("chrom_start").cast("string"), F.col("chrom_end").cast("string"), F.coalesce(F.col("score").cast("string"), F.lit(".")), F.lit("+"), F.lit("0"), F.lit("a=1")]
    f.select(F.explode(F.array(F.concat_ws("\t", *cells), F.concat_ws("\t", *cells[:8]))).alias("value")).write.text(path)
    return T.read_gff(spark, path).select("container", "feature", "start", "stop", "score")


@query(f"with {_READS} select header as name, 1 as mate, 100 + read_index % 1000 as start, 99 + read_index % 1000 + length(seq) as \"end\", seq, qual, read_index::int % 7 as nm, '-' as strand from x")
def sam_round_trip(spark, sf):
    """Read ones as alignments, written as SAM in order of coordinate and read again."""
    path = scratch(spark, "sam")
    x = _reads(spark, sf)
    tags = F.create_map(F.lit("NM"), (F.col("read_index").cast("int") % 7).cast("string"))
    a = x.select(
        F.col("header").alias("name"), F.lit(1).alias("mate"), F.lit(81).alias("flag"), F.lit("chr1").alias("container"), (100 + F.col("read_index") % 1000).alias("start"), F.lit(60).alias("mapq"),
        F.concat(F.length("seq").cast("string"), F.lit("M")).alias("cigar"), F.lit("=").alias("mate_container"), F.lit(0).cast("long").alias("mate_start"), F.lit(0).cast("long").alias("insert_size"), "seq", "qual", tags.alias("tags"),
    )
    A.write_sam(a, path, A.header_lines([("chr1", 2000)]))
    return A.read_sam(spark, path).select("name", "mate", "start", "end", "seq", "qual", "nm", "strand")


@query("select row_number() over (partition by file_name order by line_id) - 1 as line_no, file_name as first_cell, line_id::varchar as second_cell from bed_lines")
def numbered_lines(spark, sf):
    """Lines of one text file per original file, numbered in file order over all splits."""
    path = scratch(spark, "lines")
    b = table(spark, sf, "bed_lines").select("file_name", F.concat_ws("\t", "file_name", F.col("line_id").cast("string")).alias("value"), "line_id")
    b.repartition("file_name").sortWithinPartitions("file_name", "line_id").select("file_name", "value").write.partitionBy("file_name").text(path)
    cells = F.split("line", "\t")
    return L.numbered_lines(spark, f"{path}/*").select("line_no", cells[0].alias("first_cell"), cells[1].alias("second_cell"))


# --- sorted positions, windows and alignment strings


@query("""with f as (select distinct lower(trim(container_name)) as container, chrom_start as start, chrom_end as stop from features where chrom_start is not null and chrom_end is not null and container_name is not null)
select *, row_number() over (order by case when regexp_matches(container, '[0-9]') then 0 else 1 end, try_cast(regexp_extract(container, '[0-9]+') as int), container, start, stop) as place,
 lag(start) over w as start_before, lead(start) over w as start_after from f window w as (partition by container order by start, stop)""")
def sorted_features(spark, sf):
    """Distinct features in natural container order, with the starts before and after in their container."""
    f = table(spark, sf, "features").select(F.lower(F.trim("container_name")).alias("c"), "chrom_start", "chrom_end").where("c is not null")
    return intervals.sorted_features(f, "c", "chrom_start", "chrom_end").select("container", "start", "stop", "place", "start_before", "start_after")


def _whole_mates(spark: SparkSession, sf: str) -> DataFrame:
    """Both mates as a and b, over their common length."""
    n = F.least(F.length("r1_seq"), F.length("r2_seq"))
    p = table(spark, sf, "pairs").where("r1_seq is not null and r2_seq is not null")
    return spread(p.select("read_index", "r1_seq", "r2_seq")).select("read_index", F.substring(F.col("r1_seq"), F.lit(1), n).alias("a"), F.substring(F.col("r2_seq"), F.lit(1), n).alias("b"))


_COMMON = "p as (select read_index, least(length(r1_seq), length(r2_seq)) as n, substr(r1_seq, 1, n) as a, substr(r2_seq, 1, n) as b from pairs where r1_seq is not null and r2_seq is not null)"


@query(f"""with {_COMMON}, g as (select read_index, n, translate(a, 'T', '-') as a, translate(b, 'G', '-') as b from p),
o as (select *, coalesce(list_aggregate(list_transform(range(1, n + 1), lambda i: (case when a[i] = b[i] or (a[i] <> '-' and b[i] <> '-' and (a[i] = 'N' or b[i] = 'N')) then '=' when a[i] = '-' then 'I' when b[i] = '-' then 'D' else 'X' end)), 'string_agg', ''), '') as ops from g)
select read_index, ops, length(regexp_replace(ops, '[^IX]', '', 'g')) as edits, len(list_filter(range(1, n + 1), lambda i: a[i] <> b[i]))::int as differing, length(regexp_replace(ops, '[^=]', '', 'g')) as matches,
 length(regexp_replace(ops, '[^=XD]', '', 'g')) as reference_length, n - length(replace(ops, 'D', '')) as deleted from o""")
def alignment_strings(spark, sf):
    """Operations, edit distances and lengths of two gapped sequences made from the mates, over all columns that both have."""
    p = _whole_mates(spark, sf).select("read_index", F.translate("a", "T", "-").alias("a"), F.translate("b", "G", "-").alias("b")).withColumn("ops", C.operations("a", "b"))
    m = C.pair_metrics("a", "b")
    return p.select("read_index", "ops", C.edit_distance_of_operations("ops").alias("edits"), C.edit_distance_of_pair("a", "b").alias("differing"), m["matches"].alias("matches"), C.reference_length("ops").alias("reference_length"), m["deletions"].alias("deleted"))


@query(f"""with {_COMMON} select read_index, len(list_filter(range(1, n + 1), lambda i: a[i] <> b[i] and a[i] <> 'N' and b[i] <> 'N'))::int as mismatches, contains(a, 'GAT') as has_gat, substr(a, 3, 4) as part, length(a || b) as size from p""")
def sequence_comparison(spark, sf):
    """Mismatches of the mates, by the sets their codes stand for, over all bases that both have, and parts of them."""
    p = _whole_mates(spark, sf)
    return p.select("read_index", S.mismatches("a", "b").alias("mismatches"), F.col("a").contains("GAT").alias("has_gat"), S.sub_sequence("a", 2, 5).alias("part"), F.length(F.concat("a", "b")).alias("size"))


@query(f"""with {_COMMON}, g as (select read_index, n, translate(a, 'N', 'A') as a, translate(b, 'N', 'A') as b from p where n > 0),
k as (select *, list_transform(range(1, n + 1), lambda i: a[i] = b[i]) as same from g)
select read_index, regexp_replace(regexp_replace(list_aggregate(list_transform(range(1, n + 1), lambda i: case when same[i] then '=' else '0' || a[i] end), 'string_agg', '') || '0', '=0', '=', 'g'), '=', '1', 'g') as marked from k""")
def mismatch_details(spark, sf):
    """MD strings of the mates laid side by side; runs of matches are written as so many 1s, as SQL has no run lengths."""
    p = _whole_mates(spark, sf).where("a != ''").select("read_index", F.translate("a", "N", "A").alias("a"), F.translate("b", "N", "A").alias("b"))
    md = C.mismatch_details("a", C.operations("a", "b"))
    ones = F.array_join(F.transform(F.regexp_extract_all(md, F.lit("([1-9][0-9]*|[^1-9]+)"), F.lit(1)), lambda t: F.when(t.between("1", "9~"), F.repeat(F.lit("1"), t.cast("int"))).otherwise(t)), "")
    return p.select("read_index", ones.alias("marked"))


@query("""with a as (select read_index, min(read_name) as name from pairs where read_index is not null group by 1), b as (select read_index, max(read_name) as name from pairs where read_index is not null and two_mapq is not null group by 1),
x as (select count(*) filter (where a.name is distinct from b.name) as differ from a full join b on a.read_index = b.read_index),
r as (select (select count(*) from a) as n1, (select count(*) from b) as n2, (select differ from x) as differ, (select count(one_mapq) from pairs) as m1, (select count(two_mapq) from pairs) as m2)
select unnest(['first file has records', 'second file has records', 'files differ', 'equally many records', 'names agree', 'alignments of both mates']) as "check", unnest([n1 > 0, n2 > 0, true, n1 = n2, differ = 0, m1 > 0 and m2 > 0]) as ok from r""")
def input_report(spark, sf):
    """The input checks of two files of reads, the second without those whose second mate has no mapping quality."""
    p = table(spark, sf, "pairs").where("read_index is not null")
    one = p.groupBy("read_index").agg(F.min("read_name").alias("name")).withColumn("path", F.lit("one"))
    two = p.where("two_mapq is not null").groupBy("read_index").agg(F.max("read_name").alias("name")).withColumn("path", F.lit("two"))
    mates = table(spark, sf, "pairs").select(F.explode(F.array(F.when(F.col("one_mapq").isNotNull(), 1), F.when(F.col("two_mapq").isNotNull(), 2))).alias("mate")).where("mate is not null")
    return report(one, two, mates)


@query("""select o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') as day, 'chr' || o_custkey || ':' || least(o_orderkey, 500) || '-' || greatest(o_orderkey, 500) as place, least(o_orderkey, 500) as start,
 (o_orderkey % 3999 + 1)::int as roman, [1, o_orderkey % 20, 3] > [1, 9] as newer from orders""")
def text_keys(spark, sf):
    """Dates, coordinates, Roman numerals up to 3999 and versions as text and back."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    c = X.coordinate(F.concat(F.lit("chr"), F.col("o_custkey").cast("string"), F.lit(":"), k.cast("string"), F.lit(":500")))
    n = (k % 3999 + 1).cast("int")
    digits = [["", *x.split()] for x in ("I II III IV V VI VII VIII IX", "X XX XXX XL L LX LXX LXXX XC", "C CC CCC CD D DC DCC DCCC CM", "M MM MMM")]
    numeral = F.concat(*[F.element_at(F.array(*[F.lit(d) for d in of]), (F.floor(n / 10**i) % 10 + 1).cast("int")) for i, of in reversed(list(enumerate(digits)))])
    newer = X.version_key(F.concat(F.lit("1."), (k % 20).cast("string"), F.lit(".3"))) > X.version_key(F.lit("1.9"))
    return o.select("o_orderkey", X.date_text("o_orderdate").alias("day"), X.coordinate_text(c["container"], c["start"], c["stop"]).alias("place"), c["start"].alias("start"), X.roman_value(numeral).alias("roman"), newer.alias("newer"))


# --- orders of sorted files, headers, digests and checks


def _alignments(spark: SparkSession, sf: str) -> DataFrame:
    """Read ones as alignments to one of three containers."""
    tags = F.create_map(F.lit("NM"), (F.col("read_index") % 7).cast("string"))
    return _reads(spark, sf).select(
        F.col("header").alias("name"), F.lit(1).alias("mate"), F.lit(65).alias("flag"), F.concat(F.lit("chr"), (F.col("read_index") % 3).cast("string")).alias("container"), (100 + F.col("read_index") % 1000).alias("start"),
        F.lit(60).alias("mapq"), F.concat(F.length("seq").cast("string"), F.lit("M")).alias("cigar"), F.lit("*").alias("mate_container"), F.lit(0).cast("long").alias("mate_start"), F.lit(0).cast("long").alias("insert_size"), "seq", "qual", tags.alias("tags"),
    )


_ALIGNED = f"with {_READS}, a as (select header as name, 'chr' || read_index % 3 as container, 100 + read_index % 1000 as start, 99 + read_index % 1000 + length(seq) as stop, seq, qual, read_index % 7 as nm from x)"
_SIZES = [(f"chr{i}", 5000) for i in range(3)]


def _in_file_order(spark: SparkSession, path: str) -> DataFrame:
    """The lines of part files, numbered from 1 on over all of them in order of their names."""
    lines = L.numbered_lines(spark, f"{path}/part-*")
    return places(lines, ["path", "line_no"]).select("place", "line")


@query(_ALIGNED + " select row_number() over (order by container, start, name) as place, container, start, name from a")
def sam_order(spark, sf):
    """Alignments in the order in which a coordinate-sorted file holds them."""
    path = scratch(spark, "sam-order")
    A.write_sam(_alignments(spark, sf), path, [])
    c = F.split("line", "\t")
    return _in_file_order(spark, path).select("place", c[2].alias("container"), c[3].cast("long").alias("start"), c[0].alias("name"))


@query(f"with {_READS} select row_number() over (order by read_index) as place, header, seq from x")
def fastq_order(spark, sf):
    """Reads in the order in which a FASTQ file sorted by read index holds them."""
    path = scratch(spark, "fastq-order")
    R.write_fastq(_reads(spark, sf), path)
    lines = _in_file_order(spark, path).withColumn("record", F.floor((F.col("place") - 1) / 4))
    rec = lines.groupBy("record").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("l"))
    return rec.select((F.col("record") + 1).alias("place"), F.substring(F.col("l.line")[0], 2, 1 << 30).alias("header"), F.col("l.line")[1].alias("seq"))


@query(_ALIGNED + ", k as (select * from a where name not in (select read_name from read2probe where read_name is not null)) select row_number() over (order by name, container, start) as place, name, container, start from k")
def name_order(spark, sf):
    """Alignments by name, without those whose name was assigned to a probe."""
    kept = A.sorted_by_name(_alignments(spark, sf), table(spark, sf, "read2probe").select(F.col("read_name").alias("name")))
    return places(kept.select("name", "container", "start"), ["name", "container", "start"])


@query(_ALIGNED + " select name, container, start, stop as \"end\", nm from a where container = 'chr1' and start <= 400 and stop >= 300")
def sam_in_range(spark, sf):
    """Alignments of a sorted file that overlap a range."""
    path = scratch(spark, "sam-range")
    A.write_sam(_alignments(spark, sf), path, A.header_lines(_SIZES))
    return A.in_range(A.read_sam(spark, path), "chr1", 300, 400).select("name", "container", "start", "end", F.col("nm").cast("long").alias("nm"))


@query(_ALIGNED + " select name, container, start, stop as \"end\", seq, qual, nm from a")
def bam_round_trip(spark, sf):
    """Alignments written as one sorted BAM file and read again."""
    path = scratch(spark, "bam")
    A.write_bam(_alignments(spark, sf), path, _SIZES, A.header_lines(_SIZES))
    return A.read_bam(spark, path).select("name", "container", "start", "end", "seq", "qual", F.col("nm").cast("long").alias("nm"))


@query("""with d as (select container_name as container, (max(greatest(ext_stop, lig_stop)) + 1)::varchar as size from probes group by 1)
select 'SQ' as kind, container as name, size as value from d union all select 'RG', 'g1', 'sample' union all select 'PG', 'aligner', 'aligner' union all select 'PG', 'readloom', 'readloom'""")
def output_header(spark, sf):
    """The header of an output file: containers sized by the probes, the input's read groups and programs, and our own program."""
    source, path = scratch(spark, "header-in"), scratch(spark, "header-out")
    spark.createDataFrame([("@HD\tVN:1.6\n@RG\tID:g1\tSM:sample\n@PG\tID:aligner\tPN:aligner",)], "value string").write.text(source)
    given = A.read_header(spark, source)
    sizes = [(r.container, r["size"]) for r in A.synthesized_dictionary(table(spark, sf, "probes")).orderBy("container").collect()]  # as many as there are containers
    A.write_sam(_alignments(spark, sf).where("name is null"), path, A.header_lines(sizes, A.carried_header(given, "RG"), A.carried_header(given, "PG")))
    tags = F.col("tags")
    back = A.read_header(spark, path).where("kind != 'HD'")
    return back.select("kind", F.coalesce(tags["SN"], tags["ID"]).alias("name"), F.coalesce(tags["LN"], tags["SM"], tags["PN"]).alias("value"))


@query("select probe_id, reverse(translate(ext_sequence, 'ACGTN', 'TGCAN')) as ext_sequence, reverse(translate(target_sequence, 'ACGTN', 'TGCAN')) as target_sequence, reverse(translate(lig_sequence, 'ACGTN', 'TGCAN')) as lig_sequence, ext_start from probes")
def reversed_probes(spark, sf):
    """Probes with their sequences reverse-complemented, coordinates as they are."""
    return T.reverse_complemented_probes(table(spark, sf, "probes")).select("probe_id", "ext_sequence", "target_sequence", "lig_sequence", "ext_start")


@query("select unnest(['ligation_uid', 'extension_uid', 'genome']) as name, unnest(['4', (select max(length(ext_uid))::varchar from pairs), 'hg38']) as value")
def probe_header(spark, sf):
    """The pairs in the first line of a probe file."""
    path = scratch(spark, "probe-header")
    size = table(spark, sf, "pairs").agg(F.max(F.length("ext_uid"))).first()[0]
    T.write_probes(_probe_columns(table(spark, sf, "probes")), path, ext_uid=size, lig_uid=4, genome="hg38")
    return spark.createDataFrame(list(T.read_probe_header(spark, path).items()), "name string, value string")


@query("""with l as (select file_name, md5(string_agg(coalesce(line_text, '') || chr(10), '' order by line_no, line_id)) as md5, sum(strlen(coalesce(line_text, '')) + 1)::bigint as length from bed_lines where file_name is not null group by 1)
select file_name, length, md5, hash is not null as known from (select *, case when length % 2 = 0 then md5 end as hash from l)""")
def file_digests(spark, sf):
    """Length and md5 of each file, and whether a list of expected ones (those of even length) agrees with it."""
    path = scratch(spark, "digests")
    b = table(spark, sf, "bed_lines").where("file_name is not null").select("file_name", F.coalesce("line_text", F.lit("")).alias("value"), "line_no", "line_id")
    b.repartition("file_name").sortWithinPartitions("file_name", "line_no", "line_id").select("file_name", "value").write.partitionBy("file_name").option("lineSep", "\n").text(path)
    got = T.file_digests(spark, f"{path}/*")
    expected = got.select("path", F.when(F.col("length") % 2 == 0, F.col("md5")).otherwise("other").alias("md5"))
    wrong = checked_files(got, expected).select("path", F.lit(False).alias("known"))
    return got.join(wrong, "path", "left").select(F.url_decode(F.regexp_extract("path", "file_name=([^/]*)/", 1)).alias("file_name"), "length", "md5", F.coalesce("known", F.lit(True)).alias("known"))


@query(f"""with {_COMMON}, g as (select read_index, n, translate(a, 'N', 'A') as a, translate(b, 'N', 'A') as b, (read_index % 4)::int as w from p where n > 2),
d as (select *, len(list_filter(range(1, n + 1), lambda i: a[i] <> b[i]))::int as differing, len(list_filter(range(1, n + 1), lambda i: a[i] <> b[i] or (w = 3 and i = 1)))::int as wrong from g)
select read_index, case when w = 1 then ['cigar_length', 'md_length', 'md_reference'][1:2] when w = 2 then ['nm'] when w = 3 then ['md_reference'] else []::varchar[] end as issues from d""")
def alignment_consistency(spark, sf):
    """What is wrong with alignments of mate two to mate one: nothing, a longer CIGAR, another NM, or another reference base, by read index."""
    w = F.col("read_index") % 4
    p = _whole_mates(spark, sf).where("length(a) > 2").select("read_index", F.translate("a", "N", "A").alias("a"), F.translate("b", "N", "A").alias("b")).withColumn("ops", C.operations("a", "b"))
    md, differing = C.mismatch_details("a", "ops"), F.length(F.replace("ops", F.lit("="), F.lit("")))
    first = F.substring("a", 1, 1)
    x = p.select(
        "read_index", F.col("b").alias("seq"), F.concat((F.length("a") + F.when(w == 1, 1).otherwise(0)).cast("string"), F.lit("M")).alias("cigar"), md.alias("md"), (differing + F.when(w == 2, 1).otherwise(0)).alias("nm"),
        F.when(w == 3, F.concat(F.translate(first, "ACGT", "CGTA"), F.substring(F.col("a"), F.lit(2), F.length("a")))).otherwise(F.col("a")).alias("reference"),
    )
    return A.consistency(x, F.col("reference")).select("read_index", "issues")


@query("""with b as (select 'f' || o_orderkey as path, o_custkey as length, o_orderdate as modified from orders where o_orderkey % 3 <> 0), a as (select 'f' || o_orderkey as path, o_custkey + (o_orderkey % 5 = 0)::int as length, o_orderdate as modified from orders where o_orderkey % 3 <> 1)
select coalesce(a.path, b.path) as path, case when b.path is null then 'created' when a.path is null then 'removed' else 'modified' end as event from a full join b on a.path = b.path where a.path is null or b.path is null or a.length <> b.length""")
def folder_changes(spark, sf):
    """Events between two listings of files."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    shape = lambda df, extra: df.select(F.concat(F.lit("f"), k.cast("string")).alias("path"), (F.col("o_custkey") + extra).alias("length"), F.col("o_orderdate").alias("modified"))
    return changes(shape(o.where(k % 3 != 0), F.lit(0)), shape(o.where(k % 3 != 1), (k % 5 == 0).cast("int")))


@query("select length(coalesce(line_text, '')) as size, count(*) as n from bed_lines group by 1")
def mapped_lines_stream(spark, sf):
    """Lines of a watched folder, mapped as they are read."""
    base = scratch(spark, "watched")
    table(spark, sf, "bed_lines").select(F.coalesce("line_text", F.lit("")).alias("value")).write.option("lineSep", "\n").text(f"{base}/in")
    lines = watch_folder(spark, f"{base}/in", glob="part-*", line_sep="\n")
    run = mapped_lines(lines, F.length).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    if run.exception():
        raise run.exception()
    return spark.read.parquet(f"{base}/out").groupBy(F.col("value").alias("size")).agg(F.count(F.lit(1)).alias("n"))
