"""FASTQ and FASTA files and packed genomes as tables, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.functions.keys import read_stem
from readloom.functions.sequence import reverse_complement
from readloom.sources.lines import groups_of, numbered_lines

#: Bases of one row of a packed genome.
CHUNK = 1 << 16


def read_fastq(spark: SparkSession, path: str | list[str], *, check: bool = True) -> DataFrame:
    """(path, read_index, name, header, seq, qual_header, qual) of FASTQ files, plain or gzipped; read_index from 0 in file order.

    With `check`, records with wrong prefixes, blank lines or differing lengths of bases and qualities raise an
    error; without it they come as they are.
    """
    g = groups_of(numbered_lines(spark, path), 4)
    line = [F.regexp_replace(F.get("lines", F.lit(i)), "\r$", "") for i in range(4)]
    header, qual_header = F.substring(line[0], 2, 1 << 30), F.substring(line[2], 2, 1 << 30)
    out = g.select("path", F.col("record_no").alias("read_index"), read_stem(header).alias("name"), header.alias("header"), line[1].alias("seq"), qual_header.alias("qual_header"), line[3].alias("qual"), F.substring(line[0], 1, 1).alias("p0"), F.substring(line[2], 1, 1).alias("p2"))
    if check:
        wrong = F.col("qual").isNull() | (F.col("p0") != "@") | (F.col("p2") != "+") | (F.col("seq") == "") | (F.length("seq") != F.length("qual"))
        fail = F.raise_error(F.concat(F.lit("bad FASTQ record "), F.col("read_index").cast("string"), F.lit(" in "), F.col("path")))
        out = out.withColumn("seq", F.when(wrong, fail).otherwise(F.col("seq")))
    return out.drop("p0", "p2")


def fastq_lines(reads: DataFrame) -> DataFrame:
    """One text column: each read as its four lines."""
    qh = F.coalesce("qual_header", F.lit("")) if "qual_header" in reads.columns else F.lit("")
    return reads.select(F.concat_ws("\n", F.concat(F.lit("@"), F.col("header")), "seq", F.concat(F.lit("+"), qh), "qual").alias("value"))


def write_fastq(reads: DataFrame, path: str, *, compression: str | None = None) -> None:
    """FASTQ part files in order of read_index."""
    fastq_lines(reads.repartitionByRange("read_index").sortWithinPartitions("read_index")).write.mode("overwrite").text(path, compression=compression)


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, record_no, description, sequence) of FASTA files or folders of them; '#' lines and blank ones are left out.

    The description is the line after its '>'; the sequence its lines joined. One record is put together by one
    task; a record is a sequence, so it has a sequence's size.
    """
    lines = numbered_lines(spark, path).withColumn("line", F.regexp_replace("line", "\r$", "")).where("line != '' and line not like '#%'")
    head = F.col("line").startswith(">")
    # Headers are few; each line finds its own by the block of lines it is in and the headers before that block.
    block = lines.withColumn("block", F.floor(F.col("line_no") / 65536)).withColumn("h", F.when(head, F.col("line_no")))
    inside = W.partitionBy("path", "block").orderBy("line_no")
    ends = block.groupBy("path", "block").agg(F.max("h").alias("h")).withColumn("carry", F.max("h").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)))
    owned = block.withColumn("own", F.max("h").over(inside)).join(ends.select("path", "block", "carry"), ["path", "block"])
    rec = owned.withColumn("record_no", F.coalesce("own", "carry")).groupBy("path", "record_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l")).where("record_no is not null")
    return rec.select("path", "record_no", F.substring(F.get("l.line", F.lit(0)), 2, 1 << 30).alias("description"), F.array_join(F.slice("l.line", F.lit(2), F.size("l")), "").alias("sequence"))


def write_fasta(df: DataFrame, path: str) -> None:
    """FASTA part files of (description, sequence)."""
    df.select(F.concat(F.lit(">"), F.col("description"), F.lit("\n"), F.col("sequence")).alias("value")).write.mode("overwrite").text(path)


def pack_genome(sequences: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """(container, chunk_no, start, seq): sequences in rows of `chunk` bases, start 1-based; `sequences`: container, seq."""
    n = F.floor((F.length("seq") - 1) / chunk)
    s = sequences.where(F.length("seq") > 0).select("container", "seq", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("chunk_no"))
    return s.select("container", "chunk_no", (F.col("chunk_no") * chunk + 1).alias("start"), F.substring(F.col("seq"), (F.col("chunk_no") * chunk + 1).cast("int"), F.lit(chunk)).alias("seq"))


def slices(genome: DataFrame, ranges: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """Bases of ranges (range_id, container, start, stop, strand), 1-based, both ends included; '-' gives the reverse complement.

    Each range looks up just the chunks it touches. A range beyond its container gives what there is.
    """
    r = ranges.withColumn("chunk_no", F.explode(F.sequence(F.floor((F.col("start") - 1) / chunk), F.floor((F.col("stop") - 1) / chunk))))
    g = genome.select("container", "chunk_no", F.col("start").alias("g_start"), F.col("seq").alias("g"))
    at = F.greatest(F.col("start"), F.col("g_start"))
    n = F.least(F.col("stop"), F.col("g_start") + F.length("g") - 1) - at + 1
    part = r.join(g, ["container", "chunk_no"]).select("range_id", "container", "start", "stop", "strand", "chunk_no", F.substring(F.col("g"), (at - F.col("g_start") + 1).cast("int"), F.greatest(n, F.lit(0)).cast("int")).alias("p"))
    one = part.groupBy("range_id", "container", "start", "stop", "strand").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "p"))).alias("l"))
    seq = F.array_join(F.col("l.p"), "")
    return one.select("range_id", "container", "start", "stop", "strand", F.when(F.col("strand") == "-", reverse_complement(seq)).otherwise(seq).alias("sequence"))
