"""Validation of reads, names, probes and alignments, and barcodes of varying length."""

from __future__ import annotations

import binascii

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.functions.cigar import pair_metrics
from readloom.operators.alignment import Scoring, global_alignments


def variable_uids(df: DataFrame, read: str, primer: str, scoring: Scoring = Scoring()) -> DataFrame:
    """Distinct (read, primer) with the bases before the primer as uid; null where the primer fits badly.

    The read is aligned to the primer; fewer than a quarter of the primer's bases may fail to match. Each distinct
    pair is aligned once.
    """
    got = global_alignments(df, read, primer, scoring)
    m = pair_metrics("ref_aligned", "qry_aligned")
    edits = F.length("qry") - F.col("m.matches")
    bases = F.length(F.replace(F.substring(F.col("ref_aligned"), F.lit(1), F.col("m.first")), F.lit("-"), F.lit("")))
    uid = F.when(edits < F.floor(F.length("qry") / 4), F.substring(F.col("ref"), F.lit(1), bases))
    return got.withColumn("m", m).select(F.col("ref").alias(read), F.col("qry").alias(primer), uid.alias("uid"))


def fits_probe(start: Column, mapped_length: Column, raw_length: Column, mate: Column, strand: Column, ext_start: Column, ext_stop: Column, lig_start: Column, lig_stop: Column, *, ext_uid: int = 10, lig_uid: int = 0, buffer: int = 0) -> Column:
    """Whether a read begins where its primer does, once its barcode and what wasn't mapped are added, within `buffer` bases."""
    first = mate == 1
    offset = mapped_length - raw_length + F.when(first, ext_uid).otherwise(lig_uid)
    forward = strand == "+"
    # Mate one of '+' and mate two of '-' probes begin at their start, the others at their end.
    at_start = first == forward
    place = F.when(at_start, start + offset).otherwise(start + mapped_length - 1 - offset)
    primer = F.when(first, F.when(forward, ext_start).otherwise(ext_stop)).otherwise(F.when(forward, lig_stop).otherwise(lig_start))
    return F.abs(place - primer) <= buffer


def verify_trimmed(df: DataFrame, mapped_length: str, most: int) -> DataFrame:
    """The rows as they are; an error once a mapped length exceeds the trimmed length."""
    fail = F.raise_error(F.concat(F.lit("reads were not trimmed: mapped length "), F.col(mapped_length).cast("string")))
    return df.withColumn(mapped_length, F.when(F.col(mapped_length) > most, fail.cast(df.schema[mapped_length].dataType)).otherwise(F.col(mapped_length)))


def input_report(one: DataFrame, two: DataFrame, alignments: DataFrame) -> DataFrame:
    """(check, ok) of inputs: files not empty, equally many records, names agreeing, both mates among the alignments."""
    a, b = one.agg(F.count(F.lit(1)).alias("n1"), F.first("path").alias("p1")), two.agg(F.count(F.lit(1)).alias("n2"), F.first("path").alias("p2"))
    x = one.select("read_index", F.col("name").alias("a")).join(two.select("read_index", F.col("name").alias("b")), "read_index", "full_outer")
    c = x.agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differ"))
    d = alignments.agg(F.count_if(F.col("mate") == 1).alias("m1"), F.count_if(F.col("mate") == 2).alias("m2"))
    row = a.join(b).join(c).join(d)  # one row each
    checks = {
        "first file has records": F.col("n1") > 0, "second file has records": F.col("n2") > 0, "files differ": ~F.col("p1").eqNullSafe(F.col("p2")), "equally many records": F.col("n1") == F.col("n2"),
        "names agree": F.col("differ") == 0, "alignments of both mates": (F.col("m1") > 0) & (F.col("m2") > 0),
    }
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("ok")) for k, v in checks.items()])).alias("c")).select("c.*")


@F.arrow_udf(T.IntegerType())
def _crc16(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else binascii.crc_hqx(v, 0xFFFF) for v in values.cast(pa.binary()).to_pylist()], pa.int32())


def crc16(c: Column) -> Column:
    """CRC-16 (polynomial 1021, from FFFF) of a string's UTF-8 bytes."""
    return _crc16(c)


def checked_files(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose md5 isn't the expected one: (path, md5, expected); both sides: path, md5."""
    e = expected.select("path", F.col("md5").alias("expected"))
    return df.select("path", "md5").join(e, "path").where(~F.col("md5").eqNullSafe(F.col("expected")))
