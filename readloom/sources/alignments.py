"""SAM text and BAM files as tables, their headers, and a coordinate-sorted SAM sink."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.cigar import expanded
from readloom.functions.sequence import chars, let
from readloom.session import scratch

_COLUMNS = (
    "name string, flag int, container string, start long, mapq int, cigar string, mate_container string, mate_start long, insert_size long, seq string, qual string, tags map<string,string>"
)
_XA = "array<struct<container:string,start:bigint,strand:string,cigar:string,nm:int>>"
#: The letters of BAM's packed operations and bases.
_OPS, _BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
_BASE_OF = str.maketrans("0123456789abcdef", _BASES)
_HALF_OF = bytes(b"0123456789abcdef"[_BASES.index(chr(i))] if chr(i) in _BASES else ord("f") for i in range(256))
#: Qualities and their letters; those that have none become no text.
_QUALITY_OF, _LETTERS_OF = bytes(min(i + 33, 255) for i in range(256)), bytes(max(i - 33, 0) for i in range(256))
_FIXED, _INT = struct.Struct("<iiiBBHHHiiii"), struct.Struct("<i")
#: The first bytes of each BGZF block; bytes in which a split's first record is sought at first; the most bytes before it that the driver gets.
_MARK, _LOOK, _MOST_HEAD = b"\x1f\x8b\x08\x04", 1 << 18, 1 << 20
_SURVEY = pa.schema([("path", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("known", pa.int64()), ("content", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("head", pa.binary()), ("stub", pa.binary()), ("odd", pa.string())])


def _with_derived(df: DataFrame) -> DataFrame:
    """mate, strand, mapped, end and the common tags beside the plain columns."""
    flag = F.col("flag")

    def bit(n: int) -> Column:
        return flag.bitwiseAND(n) != 0

    return df.select(
        "*", F.when(bit(128), 2).otherwise(1).alias("mate"), F.when(bit(16), "-").otherwise("+").alias("strand"), (~bit(4)).alias("mapped"), (bit(1) & ~bit(8)).alias("mate_mapped"),
        (~bit(256)).alias("is_primary"), bit(1024).alias("is_duplicate"), (F.col("start") + reference_span("cigar") - 1).alias("end"),
        F.col("tags")["NM"].try_cast("int").alias("nm"), F.col("tags")["MD"].alias("md"), F.col("tags")["RG"].alias("rg"), alternate_hits(F.col("tags")["XA"]).alias("xa"),
    )


def reference_span(cigar: Column | str) -> Column:
    """Reference bases that a CIGAR covers; 0 for '*'."""
    c = F.col(cigar) if isinstance(cigar, str) else cigar
    parts = F.regexp_extract_all(c, F.lit("([0-9]+[MDN=X])"), F.lit(1))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + F.regexp_extract(p, "^[0-9]+", 0).cast("long"))


def alternate_hits(xa: Column) -> Column:
    """An XA tag as an array of hits; entries that can't be read are left out."""
    pattern = r"^([^,]+),([+-])([0-9]{1,18}),([^,]*),([0-9]{1,9})$"
    hits = F.filter(F.split(xa, ";"), lambda h: h.rlike(pattern))
    return F.transform(
        hits,
        lambda h: F.struct(
            F.regexp_extract(h, pattern, 1).alias("container"), F.regexp_extract(h, pattern, 3).cast("long").alias("start"), F.regexp_extract(h, pattern, 2).alias("strand"),
            F.regexp_extract(h, pattern, 4).alias("cigar"), F.regexp_extract(h, pattern, 5).cast("int").alias("nm"),
        ),
    ).cast(_XA)


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignments of SAM text files; header lines and lines of fewer than 11 columns are left out."""
    c = spark.read.text(path).where(~F.col("value").startswith("@")).select(F.split(F.regexp_replace("value", "\r$", ""), "\t", -1).alias("c")).where(F.size("c") >= 11)
    tags = F.map_from_entries(F.transform(F.filter(F.slice("c", 12, 1 << 20), lambda t: t.rlike("^[A-Za-z][A-Za-z0-9]:[A-Za-z]:")), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, 6, 1 << 30))))
    kinds = [x.split() for x in _COLUMNS.split(", ")][:11]
    cols = [F.get("c", F.lit(i)).try_cast(k).alias(n) if k != "string" else F.get("c", F.lit(i)).alias(n) for i, (n, k) in enumerate(kinds)]
    return _with_derived(c.select(*cols, tags.alias("tags")))


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """(kind, tags) of the header lines: SQ, RG, PG, HD."""
    lines = spark.read.text(path).where(F.col("value").rlike("^@[A-Z]{2}\t"))
    parts = F.filter(F.split("value", "\t"), lambda p: p.contains(":"))
    return lines.select(F.substring("value", 2, 2).alias("kind"), F.map_from_entries(F.transform(parts, lambda p: F.struct(F.substring(p, 1, 2), F.substring(p, 4, 1 << 30)))).alias("tags"))


def dictionary(header: DataFrame) -> DataFrame:
    """(container, size) of a header's sequences."""
    return header.where("kind = 'SQ'").select(F.col("tags")["SN"].alias("container"), F.col("tags")["LN"].cast("long").alias("size"))


def synthesized_dictionary(probes: DataFrame, container: str = "container_name") -> DataFrame:
    """(container, size) that just holds all probes: the greatest stop plus 1."""
    return probes.groupBy(F.col(container).alias("container")).agg((F.max(F.greatest("ext_stop", "lig_stop")) + 1).cast("long").alias("size"))


def gzip_blocks(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, size, content) of each member of a gzip or BGZF file; a wrong checksum or length is an error."""
    at = 0
    while at < len(data):
        if data[at : at + 2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at byte {at}")
        d = zlib.decompressobj(31)  # header with extra fields, checksum and length are verified
        content = d.decompress(data[at:]) + d.flush()
        if not d.eof:
            raise ValueError(f"gzip member at byte {at} is cut off")
        size = len(data) - at - len(d.unused_data)
        yield at, size, content
        at += size


def _bam_header(raw: bytes) -> tuple[list[str], int]:
    """The names of a BAM file's containers, and where its records begin; IndexError or struct.error if `raw` ends before that."""
    if raw[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    at = 8 + _INT.unpack_from(raw, 4)[0]
    refs, at = _INT.unpack_from(raw, at)[0], at + 4
    names = []
    for _ in range(refs):
        k = _INT.unpack_from(raw, at)[0]
        names.append(raw[at + 4 : at + 3 + k].decode())
        at += 8 + k
    if at > len(raw):
        raise IndexError("header is cut off")
    return names, at


def _bam_records(raw: bytes, at: int, names: list[str]) -> Iterator[tuple[int, tuple]]:
    """(end, record) of the whole records from `at` on."""
    full, n = len(raw), {-1: "*"} | dict(enumerate(names))
    while at + 36 <= full:
        size, ref, pos, l_name, mapq, _, n_ops, flag, l_seq, m_ref, m_pos, insert = _FIXED.unpack_from(raw, at)
        if size < 32:
            raise ValueError(f"no BAM record of {size} bytes")
        end, p = at + 4 + size, at + 36
        if end > full:
            return
        name = raw[p : p + l_name - 1].decode()
        p += l_name
        ops = struct.unpack_from(f"<{n_ops}I", raw, p)
        p += 4 * n_ops
        half = (l_seq + 1) // 2
        seq = raw[p : p + half].hex().translate(_BASE_OF)[:l_seq]
        p += half
        quals = raw[p : p + l_seq]
        p += l_seq
        qual = "*" if not l_seq or quals[0] == 255 else quals.translate(_QUALITY_OF).decode()
        yield end, (
            name, flag, n.get(ref, "*") if ref < 0 else n[ref], pos + 1, mapq, "".join([f"{o >> 4}{_OPS[o & 15]}" for o in ops]) or "*", "=" if m_ref == ref >= 0 else n.get(m_ref, "*") if m_ref < 0 else n[m_ref], m_pos + 1, insert,
            seq or "*", qual, list(_bam_tags(raw[p:end])),
        )
        at = end


def _bam_tags(b: bytes) -> Iterator[tuple[str, str]]:
    numbers = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
    at = 0
    while at < len(b):
        tag, kind = b[at : at + 2].decode(), chr(b[at + 2])
        at += 3
        if kind == "A":
            value, at = chr(b[at]), at + 1
        elif kind in numbers:
            f = "<" + numbers[kind]
            value, at = str(struct.unpack_from(f, b, at)[0]), at + struct.calcsize(f)
        elif kind in "ZH":
            end = b.index(0, at)
            value, at = b[at:end].decode(), end + 1
        else:
            f, n = numbers[chr(b[at])], struct.unpack_from("<i", b, at + 1)[0]
            value = ",".join([chr(b[at]), *map(str, struct.unpack_from(f"<{n}{f}", b, at + 5))])
            at += 5 + n * struct.calcsize(f)
        yield tag, value


def _record_batch(held: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _COLUMNS.split(", ")])


def _parse_bam(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole files."""
    for b in batches:
        for data in b.column(0):
            raw = b"".join(c for _, _, c in gzip_blocks(data.as_py()))
            names, at = _bam_header(raw)
            held: list[tuple] = []
            for end, r in _bam_records(raw, at, names):
                at = end
                held.append(r)
                if len(held) >= 10_000:
                    yield _record_batch(held)
                    held = []
            if at != len(raw):
                raise ValueError(f"BAM record at byte {at} is cut off")
            if held:
                yield _record_batch(held)


class _OddError(ValueError):
    """What isn't a whole BGZF block in one split, or a BAM file that can't be taken apart there."""


def _split_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], Iterator[tuple[int, bytes]]]]:
    """((path, offset, file size), blocks) of each split, from what stands between the marks: blocks are (size, content)."""

    def blocks(offset: int, pieces: Iterator[tuple]) -> Iterator[tuple[int, bytes]]:
        held, first = b"", offset == 0
        for piece, *_ in pieces:
            if first:
                if piece:
                    raise _OddError("no BGZF block at the start")
                first = False
                continue
            held += _MARK + piece
            extra = held[12 : 12 + int.from_bytes(held[10:12], "little")]
            at = 0
            while at < len(extra) and extra[at : at + 4] != b"BC\x02\x00":
                at += 4 + int.from_bytes(extra[at + 2 : at + 4], "little")
            if at + 6 > len(extra):
                raise _OddError("no size of a BGZF block")
            size = int.from_bytes(extra[at + 4 : at + 6], "little") + 1
            if len(held) < size:  # the mark stands in the block by chance
                continue
            d = zlib.decompressobj(31)  # checksum and length are verified
            try:
                content = d.decompress(held) + d.flush()
            except zlib.error as e:
                raise _OddError(str(e)) from e
            if len(held) > size or not d.eof or d.unused_data:
                raise _OddError("no whole BGZF block")
            yield size, content
            held = b""
        if held:
            raise _OddError("a BGZF block that isn't whole")

    def rows() -> Iterator[tuple]:
        for b in batches:
            paths, offsets, sizes = (b.column(i).to_pylist() for i in (1, 2, 3))
            for i, piece in enumerate(b.column(0)):
                yield piece.as_py(), paths[i], offsets[i], sizes[i]

    for key, pieces in groupby(rows(), lambda r: r[1:]):
        yield key, blocks(key[1], pieces)


def _first_record(raw: bytes) -> int | None:
    """Where a run of 20 records may begin, or else the longest; whether one does is for the caller to see."""
    best, most = None, 0
    for p in range(len(raw) - 35):
        at, n = p, 0
        while n < 20 and at + 36 <= len(raw):
            size, ref, pos, l_name, _, _, n_ops, _, l_seq, m_ref, m_pos, _ = _FIXED.unpack_from(raw, at)
            if min(ref, pos, m_ref, m_pos) < -1 or l_seq < 0 or l_name < 1 or size < 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq or raw[at + 35 + l_name : at + 36 + l_name] not in (b"\0", b""):
                break
            at, n = at + 4 + size, n + 1
        else:
            if n > most:
                best, most = p, n
            if n == 20:
                break
    return best


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a split: the size of its blocks and of their content, where its first record seems to begin, what stands before that, and where the last record begins that it doesn't hold whole."""
    for (path, offset, size), blocks in _split_blocks(batches):
        known, raw, at, content, first, head, least = 0, b"", 0, 0, None, b"", _LOOK
        try:
            for n, c in blocks:
                known, content, raw = known + n, content + len(c), raw[at:] + c
                at = 0
                if first is None:
                    if offset == 0:
                        if raw[:4] != b"BAM\x01"[: len(raw)]:
                            raise _OddError("not a BAM file")
                        try:
                            first = _bam_header(raw)[1]
                        except (struct.error, IndexError):
                            continue
                    elif len(raw) >= least:
                        first, least = _first_record(raw), least * 4
                    if first is None:
                        continue
                    head, at = raw[:first], first
                while at + 4 <= len(raw) and at + 4 + (k := _INT.unpack_from(raw, at)[0]) <= len(raw):
                    if k < 32:
                        raise _OddError("no BAM record")
                    at += 4 + k
            if first is None:
                first = None if offset == 0 else _first_record(raw)
                head, at = raw[:first], len(raw) if first is None else first
                while at + 4 <= len(raw) and at + 4 + (k := _INT.unpack_from(raw, at)[0]) <= len(raw):
                    if k < 32:
                        raise _OddError("no BAM record")
                    at += 4 + k
            if len(head) > _MOST_HEAD:
                raise _OddError("a long record or header")
            row = [path, offset, size, known, content, first, content - len(raw) + at, head, raw[at : at + 4], None]
        except _OddError as e:
            row = [path, offset, size, 0, 0, None, 0, b"", b"", str(e)]
        yield pa.RecordBatch.from_pylist([dict(zip(_SURVEY.names, row, strict=True))], schema=_SURVEY)


def _entries(splits: list) -> tuple[dict[tuple[str, int], tuple[int, bytes]], list[str]] | None:
    """Of one file's splits in order: {split: (where its first record begins, what its last one lacks)} and the names of containers; None if the file can't be taken apart there.

    A split's guess must be where the records of those before it end, so the result doesn't rest on guesses.
    """
    if any(x.odd for x in splits) or splits[0].at or splits[0].first is None or sum(x.known for x in splits) != splits[0].size:
        return None
    out, lacking, lack, need = {}, None, b"", splits[0].first  # need: bytes until the next record begins; lack: those that the last record has got
    for x in splits:
        if need is None:  # the four bytes of a record's size are in two splits
            stub += x.head[: 4 - len(stub)]
            if len(stub) < 4:
                return None
            need = 4 + _INT.unpack(stub)[0] - got
        if need > x.content or need == x.content and x.first is None:
            if len(x.head) != x.content or x.first is not None:
                return None
            lack, need = lack + x.head, need - x.content
            out[x.path, x.at] = (x.content, b"")
            continue
        if x.first != need:
            return None
        if lacking is not None:
            out[lacking.path, lacking.at] = (out[lacking.path, lacking.at][0], lack + x.head)
        out[x.path, x.at] = (need, b"")
        lacking, lack, got, stub = (x, b"", x.content - x.last, x.stub) if x.last < x.content else (None, b"", 0, b"")
        need = 0 if not got else 4 + _INT.unpack(stub)[0] - got if len(stub) == 4 else None
    if need is None or need:
        return None
    if lacking is not None:
        out[lacking.path, lacking.at] = (out[lacking.path, lacking.at][0], lack)
    return out, _bam_header(splits[0].head)[0]


def _parse_splits(entries: dict[tuple[str, int], tuple[int, bytes]], names: dict[str, list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for (path, offset, _), blocks in _split_blocks(batches):
            if path not in names:
                continue
            (skip, tail), raw = entries[path, offset], b""
            for c in chain((c for _, c in blocks), [tail]):
                raw, skip = raw + c[skip:], max(0, skip - len(c))
                at = 0
                for end, r in _bam_records(raw, at, names[path]):
                    at = end
                    held.append(r)
                raw = raw[at:]
                if len(held) >= 10_000:
                    yield _record_batch(held)
                    held = []
            if raw:
                raise ValueError(f"BAM record of {path} is cut off")
        if held:
            yield _record_batch(held)

    return run


def _pinned(df: DataFrame) -> DataFrame:
    """The rows of a scan with its splits as they are now; each plan would divide the files anew, by the settings and executors of its time."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


def read_bam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignments of BAM files, one task a split; the files are read twice, as where records begin isn't marked.

    The first pass, which runs at once, inflates each split's blocks and goes from record to record; the driver gets a row a
    split and sees that each begins where the one before it ends. Other gzip files, and those where that fails, are read
    as a whole by one task (up to 2 GB each, Spark's limit of a binary value), which also tells what is wrong with them.
    """
    text = spark.read.option("lineSep", _MARK.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    pieces = _pinned(text.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_size").alias("size")))
    splits = sorted(pieces.mapInArrow(_survey, "path string, at long, size long, known long, content long, first long, last long, head binary, stub binary, odd string").collect(), key=lambda x: (x.path, x.at))
    entries, names, whole = {}, {}, []
    for p, of in groupby(splits, lambda x: x.path):
        if found := _entries(list(of)):
            entries.update(found[0])
            names[p] = found[1]
        else:
            whole.append(p)
    out = pieces.mapInArrow(_parse_splits(entries, names), _COLUMNS)
    if whole:
        out = out.unionByName(spark.read.format("binaryFile").load(path).where(F.col("_metadata.file_path").isin(*whole)).select("content").mapInArrow(_parse_bam, _COLUMNS))
    return _with_derived(out)


def in_range(alignments: DataFrame, container: str, start: int, stop: int, *, contained: bool = False) -> DataFrame:
    """Alignments that overlap a range, or lie within it; the filters reach the scan of a Parquet table."""
    c = alignments.where(F.col("container") == container)
    return c.where((F.col("start") >= start) & (F.col("end") <= stop)) if contained else c.where((F.col("start") <= stop) & (F.col("end") >= start))


def sam_lines(alignments: DataFrame) -> DataFrame:
    """One text column: each alignment as a SAM line with its tags in order of name; tags are written as text."""
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda t: F.concat(F.lit("\t"), t["key"], F.when(t["value"].rlike("^-?[0-9]+$"), ":i:").otherwise(":Z:"), t["value"])), "")
    plain = [c.split()[0] for c in _COLUMNS.split(", ")][:11]
    return alignments.select(F.concat(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in plain]), F.coalesce(tags, F.lit(""))).alias("value"))


def write_sam(alignments: DataFrame, path: str, header: list[str]) -> None:
    """Coordinate-sorted SAM part files, the header as the first lines of the first one."""
    ordered = alignments.repartitionByRange("container", "start", "name", "mate").sortWithinPartitions("container", "start", "name", "mate")
    body = sam_lines(ordered)
    if header:
        top = alignments.sparkSession.createDataFrame([("\n".join(header),)], "value string").coalesce(1)
        body = top.unionByName(body)
    body.write.mode("overwrite").text(path)


def header_lines(sizes: list[tuple[str, int]], read_groups: list[str] = (), programs: list[str] = (), *, own_program: str | None = "readloom") -> list[str]:
    """Header lines: sorted-by-coordinate mark, sequences, kept read groups and programs, and our own program unless excluded."""
    own = [f"@PG\tID:{own_program}\tPN:{own_program}"] if own_program else []
    return ["@HD\tVN:1.6\tSO:coordinate", *[f"@SQ\tSN:{c}\tLN:{n}" for c, n in sizes], *read_groups, *programs, *own]


def carried_header(header: DataFrame, kind: str) -> list[str]:
    """The lines of one kind (RG, PG) of an input's header, as `read_header` gives them; headers are short."""
    tags = F.array_join(F.transform(F.map_entries("tags"), lambda t: F.concat(F.lit("\t"), t["key"], F.lit(":"), t["value"])), "")
    rows = header.where(F.col("kind") == kind).select(F.concat(F.lit("@"), F.col("kind"), tags).alias("line")).distinct().collect()
    return sorted(r.line for r in rows)


def consistency(alignments: DataFrame, reference: Column) -> DataFrame:
    """Alignments with what is wrong with them (issues, empty if all is well); `reference`: the bases under the alignment.

    cigar_length: the operations don't cover exactly the read; no_md: no MD tag; md_length: MD and CIGAR differ in the
    columns they have; md_reference: the bases that MD names, or those it says match the read, aren't the reference's;
    nm: NM isn't the mismatches, inserted and deleted bases; reference_n: the reference has an N, nothing else is looked at.
    Clipped bases take no part.
    """

    def count(text: Column, other: str) -> Column:
        return F.length(F.regexp_replace(text, other, ""))

    # MD as one letter a column of the reference: '=' as the read, a base where it differs, a small one where it's deleted.
    parts = F.regexp_extract_all("md", F.lit("([0-9]+|\\^[A-Za-z]+|[A-Za-z](?:0*[A-Za-z])*)"), F.lit(1))
    said = F.array_join(F.transform(parts, lambda p: F.when(p.startswith("^"), F.lower(F.substring(p, 2, 1 << 20))).when(p < "A", F.repeat(F.lit("="), p.cast("int"))).otherwise(F.upper(F.translate(p, "0", "")))), "")

    def step(seq: Column, acc: Column, p: Column) -> Column:
        """One part of the CIGAR more: the read's bases in the columns that take up reference, or '-' where they are deleted."""
        n, o = F.regexp_extract(p, "^[0-9]+", 0).cast("int"), F.right(p, F.lit(1))
        return (
            F.when(o == "I", F.struct(acc["out"].alias("out"), (acc["at"] + n).alias("at")))
            .when(o.isin("D", "N"), F.struct(F.concat(acc["out"], F.repeat(F.lit("-"), n)).alias("out"), acc["at"].alias("at")))
            .when(o.isin("H", "S", "P"), acc)
            .otherwise(F.struct(F.concat(acc["out"], F.substring(seq, acc["at"] + 1, n)).alias("out"), (acc["at"] + n).alias("at")))
        )

    def under(v: Column) -> Column:
        first = F.length(F.regexp_extract(v["ops"], "^H*(S*)", 1))
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
        return let({"seq": F.substring(v["seq"], first + 1, count(v["ops"], "[^MI=X]"))}, lambda s: F.aggregate(v["parts"], start, lambda acc, p: step(s["seq"], acc, p))["out"])

    def issues(v: Column, under: Column) -> Column:
        said, clean, md = v["said"], ~v["ref"].contains("N"), v["md"].isNotNull()
        deleted = count(said, "[^a-z]") == count(under, "[^-]")
        columns = count(v["ops"], "[^MDN=X]")
        same_length = (F.length(said) == columns) & (F.length(under) == columns) & deleted
        built = F.array_join(F.zip_with(chars(said), chars(under), lambda m, r: F.when(m == "=", r).otherwise(m)), "")
        edits = F.length(F.replace(said, F.lit("="), F.lit(""))) + count(v["ops"], "[^I]")
        return let({"same": same_length}, lambda s: F.array_compact(F.array(
            F.when(~clean, "reference_n"), F.when(clean & (count(v["ops"], "[^MIS=X]") != F.length(v["seq"])), "cigar_length"), F.when(clean & ~md, "no_md"), F.when(clean & md & ~s["same"], "md_length"),
            F.when(clean & md & s["same"] & (F.upper(built) != v["ref"]), "md_reference"), F.when(clean & md & s["same"] & ~v["nm"].eqNullSafe(edits), "nm"),
        )))

    # Each value is computed once a row: plans repeat what lambdas or several conditions refer to.
    values = {"ops": expanded("cigar"), "parts": F.regexp_extract_all("cigar", F.lit("([0-9]+[^0-9])"), F.lit(1)), "seq": F.col("seq"), "said": said, "md": F.col("md"), "nm": F.col("nm"), "ref": F.upper(reference)}
    return alignments.withColumn("issues", let(values, lambda v: let({"under": under(v)}, lambda u: issues(v, u["under"]))))


def _bgzf(raw: bytes) -> bytes:
    """A BGZF member of at most 65,280 bytes of content."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(raw) + c.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw))


def _bam_record(r: tuple, refs: dict[str, int]) -> bytes:
    """One row of the plain columns."""
    name, flag, container, start, mapq, cigar, mate_container, mate_start, insert_size, seq, qual, tagged = r
    name = (name or "*").encode() + b"\0"
    ops: list[int] = []
    if cigar not in (None, "", "*"):
        n = ""
        for ch in cigar:
            if ch.isdigit():
                n += ch
            else:
                ops.append(int(n) << 4 | _OPS.index(ch))
                n = ""
    seq = "" if seq in (None, "*") else seq
    packed = bytes.fromhex((seq.upper().encode("latin-1", "replace").translate(_HALF_OF) + b"0" * (len(seq) % 2)).decode())
    if qual in (None, "*"):
        quals = b"\xff" * len(seq)
    else:
        quals = qual.encode("latin-1").translate(_LETTERS_OF)
        if qual and min(qual) < "!":
            raise ValueError(f"bad quality of {r[0]}: {qual}")
    tags = b""
    for k, v in sorted(tagged or []):
        number = v is not None and v.lstrip("-").isdigit() and -(2**31) <= int(v) < 2**31
        tags += k.encode() + (b"i" + _INT.pack(int(v)) if number else b"Z" + (v or "").encode() + b"\0")
    ref = refs.get(container, -1)
    mate = ref if mate_container == "=" else refs.get(mate_container, -1)
    size = 32 + len(name) + 4 * len(ops) + len(packed) + len(quals) + len(tags)
    fixed = _FIXED.pack(size, ref, (start or 0) - 1, len(name), mapq or 0, 4680, len(ops), flag or 0, len(seq), mate, (mate_start or 0) - 1, insert_size or 0)
    return b"".join((fixed, name, struct.pack(f"<{len(ops)}I", *ops), packed, quals, tags))


def _encode_bam(refs: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = bytearray(), []

        def blocks() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["data"])

        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                held += _bam_record(r, refs)
                while len(held) >= 65_280:
                    out.append(_bgzf(bytes(held[:65_280])))
                    del held[:65_280]
            if len(out) >= 64:
                yield blocks()
                out = []
        if held:
            out.append(_bgzf(bytes(held)))
        if out:
            yield blocks()

    return run


def bam_blocks(alignments: DataFrame, sizes: list[tuple[str, int]]) -> DataFrame:
    """Coordinate-sorted alignments as BGZF members (data), without the header: range-partitioned, in partition order."""
    order = {c: i for i, (c, _) in enumerate(sizes)}
    place = F.create_map(*[F.lit(x) for kv in order.items() for x in kv]) if order else F.create_map(F.lit(""), F.lit(0))
    rank = F.coalesce(F.element_at(place, F.col("container")), F.lit(len(order)))
    plain = [c.split()[0] for c in _COLUMNS.split(", ")]
    keys = ["rank_", "start", "name", "mate"]
    ordered = alignments.withColumn("rank_", rank).repartitionByRange(*keys).sortWithinPartitions(*keys).select(*plain)
    return ordered.mapInArrow(_encode_bam(order), "data binary")


def write_bam(alignments: DataFrame, path: str, sizes: list[tuple[str, int]], header: list[str]) -> None:
    """One coordinate-sorted BAM file at any path that Spark can write: tasks write its parts, whose bytes the driver's JVM then puts together."""
    text = ("\n".join(header) + "\n").encode()
    head = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(sizes))
    for name, n in sizes:
        head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n)
    spark = alignments.sparkSession
    hadoop, conf, parts = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration(), scratch(spark, "bam-parts")
    # The text sink writes bytes as they are; the mark that a block begins with is written after the one before it.
    blocks = bam_blocks(alignments, sizes).select(F.col("data").substr(F.lit(5), F.length("data")).cast("string").alias("value"))
    blocks.write.option("lineSep", _MARK.decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none").text(parts)
    source, target = hadoop.fs.Path(parts), hadoop.fs.Path(path)
    fs = source.getFileSystem(conf)
    found = [x.getPath() for x in fs.listStatus(source) if x.getPath().getName().startswith("part-")]
    f = target.getFileSystem(conf).create(target, True)
    try:
        top = b"".join(_bgzf(head[a : a + 65_280]) for a in range(0, len(head), 65_280))
        f.write(bytearray(top + _MARK))
        for part in sorted(found, key=lambda x: (int(x.getName().split("-")[1]), x.getName())):
            g = fs.open(part)
            try:
                hadoop.io.IOUtils.copyBytes(g, f, 1 << 20, False)
            finally:
                g.close()
        f.write(bytearray(_bgzf(b"")[len(_MARK) :]))
    finally:
        f.close()
    fs.delete(source, True)


def sorted_by_name(alignments: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Alignments by name and mate, without those whose name is among the excluded (name)."""
    kept = alignments if excluded is None else alignments.join(excluded.select("name").dropna().distinct(), "name", "left_anti")
    return kept.orderBy("name", "mate")
