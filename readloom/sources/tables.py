"""Delimited files, probe files, BED and GFF files, and settings, as tables and back."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.text import annotations
from readloom.operators.badlines import parse_lines
from readloom.sources.lines import numbered_lines

#: The columns of a probe file, with their types.
PROBE_COLUMNS = {
    "probe_id": "string", "chromosome": "string", "probe_strand": "string", "ext_start": "int", "ext_stop": "int", "ext_sequence": "string", "lig_start": "int", "lig_stop": "int",
    "lig_sequence": "string", "target_start": "int", "target_stop": "int", "target_sequence": "string", "annotation": "string",
}
#: Bytes from a file's start within which its header row must be.
SNIFF_BYTES = 10_000
_GFF = ["container", "source", "feature", "start", "stop", "score", "strand", "phase", "attributes"]


def _head(spark: SparkSession, path: str) -> bytes:
    """The first bytes of a file (of the first one, for a folder)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isDirectory():
        p = sorted((s.getPath() for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", "."))), key=lambda x: x.toString())[0]
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(SNIFF_BYTES))
    finally:
        stream.close()


def find_header(head: bytes, names: list[str], delimiter: str) -> tuple[str, int, list[str]]:
    """Charset, 0-based line and columns of the header: the first line that has all names, whatever their case and order."""
    wanted = {n.lower() for n in names}
    for charset in ("utf-16", "utf-8"):
        try:
            text = head.decode(charset, errors="strict" if charset == "utf-16" and len(head) < SNIFF_BYTES else "ignore")
        except UnicodeError:
            continue
        for k, line in enumerate(re.split(r"\r\n|\n|\r", text)):
            columns = [c.strip() for c in line.lstrip("﻿").split(delimiter)]
            if wanted <= {c.lower() for c in columns}:
                return charset, k, columns
    raise ValueError(f"no header row with {sorted(wanted)} in the first {SNIFF_BYTES} bytes")


def read_delimited(spark: SparkSession, path: str, names: list[str], *, delimiter: str = "\t", extra: bool = False) -> DataFrame:
    """The named columns (all of them with `extra`) of a delimited file whose header row is found by its names.

    Lines up to the header, and blank ones, are left out; cells are trimmed strings, missing ones null. Files
    are split and parsed in parallel by Spark.
    """
    charset, at, columns = find_header(_head(spark, path), names, delimiter)
    lower = {c.lower(): i for i, c in enumerate(columns)}
    out = [(n, lower[n.lower()]) for n in names] + ([(c, i) for i, c in enumerate(columns) if c.lower() not in {n.lower() for n in names}] if extra else [])
    if charset == "utf-16":
        raw = spark.read.option("encoding", "UTF-16").option("multiLine", "true").option("sep", "\x01").option("quote", "").csv(path).select(F.col("_c0").alias("line"))
        header = delimiter.join(columns)
        raw = raw.where(F.trim("line") != header)
    else:
        raw = numbered_lines(spark, path).where(F.col("line_no") > at)
    line = F.regexp_replace("line", "\r$", "")
    cells = raw.where(F.trim(line) != "").select(F.split(line, re.escape(delimiter), -1).alias("c"))
    return cells.select(*[F.trim(F.get("c", F.lit(i))).alias(n) for n, i in out])


def read_probe_header(spark: SparkSession, path: str) -> dict[str, str | None]:
    """The name=value pairs of a probe file's first line, if that begins with '#'; a bare name has no value."""
    first = re.split(r"\r\n|\n|\r", _head(spark, path).decode("utf-8", "ignore"))[0]
    if not first.startswith("#"):
        return {}
    return {k: (v if sep else None) for k, sep, v in (p.partition("=") for p in first[1:].replace("\t", " ").split())}


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """A probe file's 13 columns, typed; in any order, others ignored. A bad whole number is an error that names it."""
    raw = read_delimited(spark, path, list(PROBE_COLUMNS))

    def typed(n: str, t: str):
        if t == "string":
            return F.col(n)
        bad = F.col(n).isNotNull() & F.col(n).try_cast(t).isNull()
        return F.when(bad, F.raise_error(F.concat(F.lit(f"bad {n} of probe "), F.col("probe_id"), F.lit(": "), F.col(n)))).otherwise(F.col(n).try_cast(t)).alias(n)

    return raw.select(*[typed(n, t) for n, t in PROBE_COLUMNS.items()])


def write_delimited(df: DataFrame, path: str, *, pre_header: str | None = None) -> None:
    """One tab-delimited file with header, in the row order of `df`; `pre_header` is a line before it. For reports."""
    lines = df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value"), F.monotonically_increasing_id().alias("i"))
    spark = df.sparkSession
    head = ([pre_header] if pre_header else []) + ["\t".join(df.columns)]
    top = spark.createDataFrame([(h, i - len(head)) for i, h in enumerate(head)], "value string, i long")
    top.unionByName(lines).repartition(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)


def write_probes(probes: DataFrame, path: str, *, ext_uid: int, lig_uid: int, genome: str = "hg19") -> None:
    """A probe file with its header line."""
    write_delimited(probes.select(*PROBE_COLUMNS), path, pre_header=f"#ligation_uid={lig_uid} extension_uid={ext_uid} genome={genome}")


def reverse_complemented_probes(probes: DataFrame) -> DataFrame:
    """Probes with their three sequences reverse-complemented, coordinates as they are."""
    from readloom.functions.sequence import reverse_complement

    names = ("ext_sequence", "lig_sequence", "target_sequence")
    return probes.select(*[reverse_complement(c).alias(c) if c in names else F.col(c) for c in probes.columns])


def read_name_values(spark: SparkSession, path: str, delimiter: str = "=") -> DataFrame:
    """(name, value) of a file of name-delimiter-value lines; lines without the delimiter are dropped, the last value of a name stays."""
    lines = numbered_lines(spark, path).where(F.col("line").contains(delimiter))
    i = F.instr(F.col("line"), delimiter)
    pairs = lines.select("line_no", F.trim(F.substring(F.col("line"), F.lit(1), i - 1)).alias("name"), F.trim(F.regexp_replace(F.substring(F.col("line"), i + len(delimiter), F.length("line")), "\r$", "")).alias("value"))
    return pairs.groupBy("name").agg(F.max_by("value", "line_no").alias("value"))


def read_bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All lines of BED files, parsed: (path, line_no, track, kind, reason, twelve columns); see `parse_lines`.

    track: the name=value pairs of the file's last track line before the entry, null if there is none.
    """
    from pyspark.sql import Window as W

    lines = numbered_lines(spark, path)
    tracks = lines.where(F.col("line").startswith("track"))
    opens = tracks.select("path", F.col("line_no").alias("from"), "line").withColumn("until", F.lead("from").over(W.partitionBy("path").orderBy("from")))
    opens = opens.withColumn("track", annotations(F.regexp_replace(F.regexp_replace(F.regexp_replace("line", "^track\\s*", ""), "\"([^\"]*)\"", "$1"), "\r$", ""))).select(F.col("path").alias("t_path"), "from", "until", "track")
    parsed = parse_lines(lines, "line", ["path", "line_no"])
    within = (F.col("path") == F.col("t_path")) & (F.col("line_no") > F.col("from")) & (F.col("until").isNull() | (F.col("line_no") < F.col("until")))
    return parsed.join(opens, within, "left").drop("t_path", "from", "until")


def bed_contexts(entries: DataFrame) -> DataFrame:
    """(container, start, stop, strand): start and stop in order, strand '+' unless '-'."""
    return entries.select(
        F.col("container_name").alias("container"), F.least("chrom_start", "chrom_end").alias("start"), F.greatest("chrom_start", "chrom_end").alias("stop"),
        F.when(F.col("strand") == "-", "-").otherwise("+").alias("strand"),
    )


def read_gff(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """GFF entries; lines that don't have exactly nine columns are left out, the phase too."""
    cells = numbered_lines(spark, path).select(F.split(F.regexp_replace("line", "\r$", ""), "\t", -1).alias("c")).where(F.size("c") == len(_GFF))
    typed = {"start": "long", "stop": "long", "score": "double"}
    return cells.select(*[(F.get("c", F.lit(i)).try_cast(typed[n]) if n in typed else F.get("c", F.lit(i))).alias(n) for i, n in enumerate(_GFF) if n != "phase"])


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, md5) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.md5("content").alias("md5"))


def read_settings(text: str) -> dict:
    """Settings of sections FIND, TRIM and OUTPUT, from YAML of names and plain values, one or two levels deep."""

    def value(v: str):
        v = v.strip().strip("'\"")
        if v.lower() in ("true", "false"):
            return v.lower() == "true"
        try:
            return int(v)
        except ValueError:
            try:
                return float(v)
            except ValueError:
                return v or None

    out: dict = {}
    section = None
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if not line.strip():
            continue
        name, sep, rest = line.strip().partition(":")
        if not sep:
            raise ValueError(f"not a setting: {raw!r}")
        if line[0] not in " \t" and not rest.strip():
            section = out.setdefault(name.strip(), {})
        elif line[0] in " \t" and section is not None:
            section[name.strip()] = value(rest)
        else:
            out[name.strip()] = value(rest)
            section = None
    return out
