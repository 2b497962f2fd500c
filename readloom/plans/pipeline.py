"""The whole commands as plans: duplicate removal, trimming, and find-and-trim."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.cigar import pair_metrics
from readloom.functions.sequence import fixed_trim, has_n, merge_pair, orientations, quality_total, quality_trim, reverse_complement, uid
from readloom.operators.alignment import Scoring, extend_to_primers, global_alignments, tasks
from readloom.operators.dedup import mapping_classes, probe_details, reduce_duplicates, summary_report, uid_tallies
from readloom.operators.joins import best_candidates, mate_probe_intersection, merge_raw_reads, range_join, unambiguous
from readloom.operators.kmers import candidates, placed
from readloom.session import materialize


@dataclass(frozen=True)
class DedupOptions:
    """Options of `dedup`; `policy` is 'remove', 'mark' or 'keep'."""

    ext_uid: int = 10
    lig_uid: int = 0
    policy: str = "remove"
    merge_pairs: bool = False
    scoring: Scoring = Scoring()


def assign_probes(alignments: DataFrame, probes: DataFrame) -> DataFrame:
    """(read_index, probe_id): probes whose window contains both mates of a read, alternate hits included.

    `alignments`: read_index, mate, container, start, end, strand, mapped, mate_mapped, xa. The second mate's
    strand is turned, so both carry the probe's. Read indexes with more than two primary records are left out.
    """
    primary = unambiguous(alignments.where("is_primary and mapped and mate_mapped"), "read_index", 2)
    turned = F.when(F.col("strand") == "-", "+").otherwise("-")
    strand = F.when(F.col("mate") == 2, turned).otherwise(F.col("strand"))
    own = primary.select("read_index", "mate", "container", "start", F.col("end").alias("stop"), strand.alias("strand"))
    from readloom.sources.alignments import reference_span

    x = primary.select("read_index", "mate", F.explode("xa").alias("x"))
    other = F.when(F.col("x.strand") == "-", "+").otherwise("-")
    alt = x.select(
        "read_index", "mate", F.col("x.container").alias("container"), F.col("x.start").alias("start"), (F.col("x.start") + reference_span(F.col("x.cigar")) - 1).alias("stop"),
        F.when(F.col("mate") == 2, other).otherwise(F.col("x.strand")).alias("strand"),
    )
    windows = probes.select("probe_id", F.col("container_name").alias("container"), F.least("ext_start", "lig_start").alias("start"), F.greatest("ext_stop", "lig_stop").alias("stop"), "strand")
    hits = range_join(own.unionByName(alt), windows, strand="strand").select("read_index", "mate", F.col("w_probe_id").alias("probe_id")).distinct()
    return mate_probe_intersection(hits)


def resolve(assigned: DataFrame, pairs: DataFrame, probes: DataFrame, *, ext_uid: int, lig_uid: int) -> DataFrame:
    """One probe per read_index: reads of several probes are aligned to each, the best one wins, ties drop the read.

    `pairs`: read_index, r1, r2. Only reads of several probes are aligned.
    """
    n = assigned.groupBy("read_index").agg(F.count(F.lit(1)).alias("n"))
    counted = assigned.join(n, "read_index")
    single = counted.where("n = 1").select("read_index", "probe_id")
    whole = F.concat("ext_sequence", "target_sequence", "lig_sequence")
    many = counted.where("n > 1").select("read_index", "probe_id").join(pairs.select("read_index", "r1", "r2"), "read_index")
    many = many.join(probes.select("probe_id", whole.alias("whole")), "probe_id")
    one = many.select("read_index", "probe_id", F.expr(f"substring(r1, {ext_uid + 1})").alias("ref"), F.col("whole").alias("qry"))
    two = many.select("read_index", "probe_id", F.expr(f"substring(r2, {lig_uid + 1})").alias("ref"), reverse_complement("whole").alias("qry"))
    both = one.unionByName(two)
    aligned = global_alignments(both, "ref", "qry")
    m = pair_metrics("ref_aligned", "qry_aligned")
    scored = both.join(aligned.select("ref", "qry", m.alias("m")), ["ref", "qry"])
    per = scored.groupBy("read_index", "probe_id").agg(F.sum("m.matches").alias("matches"), F.sum(F.col("m.first") + F.col("m.mismatches") + F.col("m.inner_gaps")).alias("edits"))
    return single.unionByName(best_candidates(per).select("read_index", "probe_id"))


@dataclass(frozen=True)
class DedupRun:
    """What `dedup_run` makes: the reduced pairs, and its reports."""

    pairs: DataFrame
    probe_details: DataFrame
    uid_tallies: DataFrame
    summary: DataFrame


def dedup(alignments: DataFrame, reads: DataFrame, probes: DataFrame, options: DedupOptions = DedupOptions()) -> DataFrame:
    """Reduced, extended read pairs: read_index, probe_id, uid, name, r1, r2, quals, is_duplicate, is_best, one, two, extended.

    `alignments` as from `read_sam`, `reads`: name, mate, read_index, seq, qual. With `merge_pairs` the extended
    mates come as one sequence too (struct merged). Alignments none of which has a read are an error.
    """
    return dedup_run(alignments, reads, probes, options).pairs


def dedup_run(alignments: DataFrame, reads: DataFrame, probes: DataFrame, options: DedupOptions = DedupOptions(), *, prefix: str = "") -> DedupRun:
    """`dedup` with its reports: per probe, barcodes per probe, and the summary; `prefix` names the sample in it.

    Pairs that reduction keeps but that can't be extended to their primers are taken off the reports' counts.
    """
    # Read several times below, so written once: merged reads, and later the assigned and scored pairs.
    whole = materialize(merge_raw_reads(alignments.where("is_primary"), reads), "merged-reads")
    if whole.isEmpty():
        a, r = (df.select("name").limit(1).collect() for df in (alignments, reads))
        if a and r:
            raise ValueError(f"no alignment has a read of its name, such as {a[0].name!r} and {r[0].name!r}")
    one, two = (whole.where(f"mate = {m}").select("read_index", "name", F.col("seq").alias(f"r{m}"), F.col("qual").alias(f"q{m}")) for m in (1, 2))
    pairs = one.join(two.drop("name"), "read_index").where(~has_n("r1") & ~has_n("r2"))
    assigned = materialize(assign_probes(whole, probes), "assigned")
    probe_of = resolve(assigned, pairs, probes, ext_uid=options.ext_uid, lig_uid=options.lig_uid)
    barcode = F.concat(uid("r1", options.ext_uid), uid("r2", options.lig_uid))
    scored = materialize(pairs.join(probe_of, "read_index").select("read_index", "probe_id", barcode.alias("uid"), (quality_total("q1") + quality_total("q2")).alias("score"), "name", "r1", "q1", "r2", "q2"), "scored")
    kept = materialize(reduce_duplicates(scored, policy=options.policy), "reduced")
    extended = materialize(extend_to_primers(kept.select(F.col("read_index").alias("id"), "probe_id", "r1", "r2"), probes, scoring=options.scoring), "extended")
    extended = extended.withColumnRenamed("id", "read_index")
    counted = scored.select("read_index", "probe_id", "uid", "score").join(extended.select("read_index", "extended"), "read_index", "left")
    classes = mapping_classes(alignments.where("is_primary").select("name", "mate", "mapped"))
    out = _merged_mates(kept.join(extended.drop("probe_id"), "read_index").where("extended"), probes, options)
    return DedupRun(out, probe_details(counted, probes), uid_tallies(counted), summary_report(counted, probes, classes, prefix=prefix))


def _merged_mates(out: DataFrame, probes: DataFrame, options: DedupOptions) -> DataFrame:
    if options.merge_pairs:
        strand = probes.select("probe_id", (F.col("strand") == "-").alias("back"))
        out = out.join(strand, "probe_id")

        def part(c: str, s: str) -> Column:
            return F.substring(F.col(c), F.col(f"{s}.first") + 1, F.col(f"{s}.last") - F.col(f"{s}.first") + 1)

        # On the positive strand mate one lies upstream; both are put on the reference strand first.
        a, qa, b, qb = part("r1", "one"), part("q1", "one"), reverse_complement(part("r2", "two")), F.reverse(part("q2", "two"))
        c, qc, d, qd = part("r2", "two"), part("q2", "two"), reverse_complement(part("r1", "one")), F.reverse(part("q1", "one"))
        sa, sb = F.col("one.start"), F.col("two.start")
        up_first = F.when(F.col("back"), sb).otherwise(sa)
        down_first = F.when(F.col("back"), sa).otherwise(sb)
        u, qu, v, qv = (F.when(F.col("back"), x).otherwise(y) for x, y in ((c, a), (qc, qa), (d, b), (qd, qb)))
        swap = up_first > down_first
        left, ql, right, qr = (F.when(swap, x).otherwise(y) for x, y in ((v, u), (qv, qu), (u, v), (qu, qv)))
        out = out.withColumn("merged", merge_pair(F.col("back"), left, right, ql, qr, F.least(up_first, down_first), F.greatest(up_first, down_first))).drop("back")
    return out


def trim(reads: DataFrame, lengths: DataFrame, *, mate: int, three_prime: bool = True) -> DataFrame:
    """Reads cut to the bases to keep; `lengths` is the row of `trim_lengths`. Short reads are an error."""
    row = lengths.first()
    cut = fixed_trim("seq", "qual", row[f"r{mate}_first"], row[f"r{mate}_last"], three_prime)
    return reads.withColumn("c", cut).select(*[F.col(f"c.{c}").alias(c) if c in ("seq", "qual") else F.col(c) for c in reads.columns])


def mismatched_names(one: DataFrame, two: DataFrame) -> DataFrame:
    """Records whose canonical names differ between two files at the same read_index, or that only one has."""
    a, b = one.select("read_index", F.col("name").alias("name_one")), two.select("read_index", F.col("name").alias("name_two"))
    return a.join(b, "read_index", "full_outer").where(~F.col("name_one").eqNullSafe(F.col("name_two")))


@dataclass(frozen=True)
class FindOptions:
    """Options of `find_and_trim`: what a match may differ by, what of a read stays, and what is noted of it.

    replace_found puts the searched sequence, with the best quality, in place of what was found (unless that is
    kept). notes: names of annotations by what they hold: before, found, after, sought, primary_id, secondary_id,
    orientation. limit and least_ratio: candidates as `kmers.candidates` bounds them, for speed; without them no
    match is missed.
    """

    mismatches: int = 2
    insertion_gaps: int = 0
    insertion_bases: int = 0
    deletion_gaps: int = 0
    deletion_bases: int = 0
    k: int = 5
    keep_before: bool = False
    keep_found: bool = True
    keep_after: bool = True
    replace_found: bool = False
    leading_quality: int = 0
    trailing_quality: int = 0
    orientations: tuple[str, ...] = ("FWD", "RVS", "RVS_CMP", "CMP")
    notes: dict[str, str] = field(default_factory=dict)
    limit: int | None = None
    least_ratio: float = 0.0


def _by_kmers(texts: DataFrame, sought: DataFrame, o: FindOptions) -> DataFrame:
    """(ref, qry) that share as many k-mers as a match within the allowed differences must leave.

    A mismatch, a missing base or a code that stands for several breaks at most k k-mers of the sought sequence, a
    gap k - 1 more at its place. k is the greatest, up to o.k, for which one is left. Of a text with such codes one
    k-mer is enough.
    """
    q, r = texts.select(F.col("text").alias("query_id"), F.col("text").alias("seq")), sought.select(F.col("sought").alias("reference_id"), F.col("sought").alias("seq"))
    if o.limit is not None or o.least_ratio > 0:
        got = candidates(q, r, k=o.k, limit=o.limit, least_ratio=o.least_ratio)
        return got.select(F.col("query_id").alias("ref"), F.col("reference_id").alias("qry"))
    insertions = o.insertion_gaps if o.insertion_bases else 0
    deletions = min(o.deletion_gaps, o.deletion_bases)
    missing = o.deletion_bases if o.deletion_gaps else 0
    codes = F.regexp_count(F.upper("seq"), F.lit("[^ACGT]"))

    def left(k: int) -> Column:
        return F.length("seq") - k + 1 - k * (o.mismatches + codes) - (k - 1) * (insertions + deletions) - missing

    best = F.coalesce(*[F.when(left(k) >= 1, F.lit(k)) for k in range(o.k, 0, -1)], F.when(F.length("seq") > o.mismatches + missing, F.lit(1)), F.lit(0))
    sized = r.withColumn("k", best).where("k > 0")
    out = q.select("query_id", F.col("query_id").alias("reference_id")).limit(0)
    for k in sorted(row.k for row in sized.select("k").distinct().collect()):
        of = sized.where(F.col("k") == k)
        got = candidates(q, of.drop("k"), k=k, include_last=True).join(of.select("reference_id", left(k).alias("left")), "reference_id")
        enough = F.when(F.upper("query_id").rlike("^[ACGT]*$"), F.greatest(F.col("left"), F.lit(1))).otherwise(1)
        out = out.unionByName(got.where(F.col("hits") >= enough).select("query_id", "reference_id"))
    return out.select(F.col("query_id").alias("ref"), F.col("reference_id").alias("qry"))


def _near(texts: DataFrame, sought: DataFrame, o: FindOptions, broadcast_rows: int = 100_000) -> DataFrame:
    """(ref, qry) of texts and sought sequences worth an alignment, as `find_and_trim` tells."""
    gaps = min(o.insertion_gaps, o.insertion_bases) > 0 or min(o.deletion_gaps, o.deletion_bases) > 0
    if gaps or o.limit is not None or o.least_ratio > 0:
        return _by_kmers(texts, sought, o)
    plain = lambda c: F.upper(c).rlike("^[ACGT]*$")
    few = F.upper("sought").rlike("^[ACGT]*([RYSWKMBDHVNU][ACGT]*){0,4}$")
    whole = few & (F.length("sought") >= 3 * (o.mismatches + 1))
    n = sought.agg(F.count_if(whole).alias("whole"), F.count_if(~whole).alias("rest")).first()
    out = _by_kmers(texts.where(~plain("text")), sought, o)
    if n["rest"]:
        out = out.union(_by_kmers(texts.where(plain("text")), sought.where(~whole), o))
    if n["whole"]:
        out = out.union(placed(texts.where(plain("text")), sought.where(whole), o.mismatches, broadcast=n["whole"] <= broadcast_rows))
    return out


def find_and_trim(reads: DataFrame, searched: DataFrame, options: FindOptions = FindOptions()) -> DataFrame:
    """Reads with each searched sequence found in them, cut: read_index, status, primary_id, secondary_id, orientation, before, found, after, seq, qual, notes.

    `reads`: read_index, seq, qual; `searched`: primary_id, secondary_id, seq. Reads are quality-trimmed, those
    with N left out (status 'skipped'). Sequences are searched in any orientation; what they may match is
    aligned and must keep within the allowed differences. Where no gaps are allowed, only those that fit somewhere
    without any are aligned; else those that share enough k-mers. status: 'none', 'single' or 'multiple'; a read
    gives one row for each match, and one if there is none. Each distinct pair is aligned once. notes: the
    annotations asked for, as text for a record's header, null where nothing was found. Searched sequences not longer
    than the differences allowed to them would fit anything and are left out.
    """
    cut = quality_trim("seq", "qual", options.leading_quality, options.trailing_quality)
    clean = reads.select("read_index", cut.alias("c")).select("read_index", "c.seq", "c.qual", has_n("c.seq").alias("skip"))
    ways = F.explode(F.filter(orientations("seq"), lambda w: w["orientation"].isin(*options.orientations)))
    wanted = searched.select("primary_id", "secondary_id", ways.alias("o")).select("primary_id", "secondary_id", "o.orientation", F.col("o.sequence").alias("qry"))
    live = clean.where(~F.col("skip"))
    # Dealt out by text first: the search takes far longer than the bytes suggest.
    texts = live.select(F.col("seq").alias("text")).repartition(tasks(live), "text").distinct()
    work = _near(texts, wanted.select(F.col("qry").alias("sought")).dropna().distinct(), options)
    aligned = global_alignments(work, "ref", "qry")
    inner = F.length(F.regexp_extract("qry_aligned", "^-*", 0)), F.length(F.regexp_extract("qry_aligned", "-*$", 0))
    size = F.length("qry_aligned") - inner[0] - inner[1]
    m = pair_metrics(F.substring(F.col("ref_aligned"), inner[0] + 1, size), F.substring(F.col("qry_aligned"), inner[0] + 1, size))
    o = options
    fits = aligned.select("ref", "qry", m.alias("m"), F.length(F.replace(F.substring(F.col("ref_aligned"), F.lit(1), inner[0]), F.lit("-"), F.lit(""))).alias("at"),
        F.length(F.replace(F.substring(F.col("ref_aligned"), inner[0] + 1, size), F.lit("-"), F.lit(""))).alias("len")).where(
        (F.col("m.mismatches") <= o.mismatches) & (F.col("m.insertions") <= o.insertion_bases) & (F.col("m.insertion_gaps") <= o.insertion_gaps)
        & (F.col("m.deletions") <= o.deletion_bases) & (F.col("m.deletion_gaps") <= o.deletion_gaps)
    )
    # Alignments are read twice below, by count and by match, so they are written once.
    fits = materialize(fits.drop("m"), "found")
    hits = live.select("read_index", F.col("seq").alias("ref")).join(fits, "ref").join(wanted, "qry").select("read_index", "primary_id", "secondary_id", "orientation", "at", "len", "qry")
    n = hits.groupBy("read_index").agg(F.count(F.lit(1)).alias("n"))
    out = clean.join(n, "read_index", "left").join(hits, "read_index", "left")
    status = F.when(F.col("skip"), "skipped").when(F.col("n").isNull(), "none").when(F.col("n") == 1, "single").otherwise("multiple")

    def parts(c: str) -> tuple[Column, Column, Column]:
        x = F.col(c)
        return F.substring(x, F.lit(1), F.col("at")), F.substring(x, F.col("at") + 1, F.col("len")), F.substring(x, F.col("at") + F.col("len") + 1, F.length(x))

    def kept(c: str) -> Column:
        b, f, a = parts(c)
        put = F.col("qry") if c == "seq" else F.repeat(F.lit("~"), F.length("qry"))
        some = [p for p, on in ((b, o.keep_before), (f if o.keep_found else put, o.keep_found or o.replace_found), (a, o.keep_after)) if on]
        return F.when(F.col("at").isNull(), F.col(c)).otherwise(F.concat(*some) if some else F.lit(""))

    b, f, a = parts("seq")
    held = {"before": b, "after": a, "found": F.upper(f), "sought": F.col("qry"), "primary_id": F.col("primary_id"), "secondary_id": F.col("secondary_id"), "orientation": F.col("orientation")}
    if unknown := set(o.notes) - set(held):
        raise ValueError(f"no such notes: {sorted(unknown)}")
    said = F.concat(F.lit(""), *[F.concat(F.lit(f"{o.notes[k]}="), v, F.lit(" ")) for k, v in held.items() if k in o.notes])
    return out.select(
        "read_index", status.alias("status"), "primary_id", "secondary_id", "orientation", b.alias("before"), f.alias("found"), a.alias("after"), kept("seq").alias("seq"), kept("qual").alias("qual"),
        F.when(F.col("at").isNotNull(), said).alias("notes"),
    )


#: Settings of a find-and-trim run by section, and the options they set.
_FIND = {
    "Allowed_Mismatch_Bases": "mismatches", "Allowed_Insertion_Gaps": "insertion_gaps", "Allowed_Insertion_Bases": "insertion_bases", "Allowed_Deletion_Gaps": "deletion_gaps",
    "Allowed_Deletion_Bases": "deletion_bases",
}
_WAYS = {
    "Include_Forward_Version_Of_Search_Sequence": "FWD", "Include_Reverse_Version_Of_Search_Sequence": "RVS", "Include_Reverse_Compliment_Version_Of_Search_Sequence": "RVS_CMP",
    "Include_Compliment_Version_Of_Search_Sequence": "CMP",
}
_NOTES = {
    "Add_Pre_Text_To_FastQ_Annotation_With_Following_Key": "before", "Add_Found_Text_To_FastQ_Annotation_With_Following_Key": "found", "Add_Found_Sequence_To_FastQ_Annotation_With_Following_Key": "sought",
    "Add_Found_Sequence_Primary_ID_To_FastQ_Annotation_With_Following_Key": "primary_id", "Add_Found_Sequence_Secondary_ID_To_FastQ_Annotation_With_Following_Key": "secondary_id",
    "Add_Found_Sequence_Orientation_ID_To_FastQ_Annotation_With_Following_Key": "orientation", "Add_Post_Text_To_FastQ_Annotation_With_Following_Key": "after",
}


def find_options(settings: dict, defaults: FindOptions = FindOptions()) -> FindOptions:
    """Options from settings as `read_settings` gives them: sections FIND and TRIM; what isn't set keeps its default."""
    find, trimming = settings.get("FIND") or {}, settings.get("TRIM") or {}
    new: dict = {option: int(find[k]) for k, option in _FIND.items() if find.get(k) is not None}
    if any(k in find for k in _WAYS):
        new["orientations"] = tuple(w for k, w in _WAYS.items() if find.get(k, w in defaults.orientations))
    for k, option in (("Leading_Quality_Trim_Threshold", "leading_quality"), ("Trailing_Quality_Trim_Threshold", "trailing_quality")):
        if trimming.get(k) is not None:
            new[option] = int(trimming[k])
    for k, option in (("Remove_Pre_Text_In_Output", "keep_before"), ("Remove_Post_Text_In_Output", "keep_after"), ("Remove_Found_Text_In_Output", "keep_found")):
        if k in trimming:
            new[option] = not trimming[k]
    if "Keep_Found_Text_In_Output" in trimming:
        new["keep_found"] = bool(trimming["Keep_Found_Text_In_Output"])
    if trimming.get("Replace_Found_Text_With_Search_Sequence"):
        new |= {"keep_found": False, "replace_found": True}
    notes = {held: str(trimming[k]) for k, held in _NOTES.items() if trimming.get(k)}
    return replace(defaults, **new, notes=notes or defaults.notes)


def routed(found: DataFrame, *, multiple: str = "own", none: str = "own") -> DataFrame:
    """Rows of `find_and_trim` with the output they go to: file 'match', 'multiple' or 'no_match'.

    multiple: 'own', 'match', 'no_match' (a row for the read as it was) or 'exclude'; none: 'own', 'match' or 'exclude'.
    Skipped reads go nowhere.
    """
    if multiple not in ("own", "match", "no_match", "exclude") or none not in ("own", "match", "exclude"):
        raise ValueError("no such output")
    many = {"own": "multiple", "match": "match", "no_match": "no_match", "exclude": None}[multiple]
    empty = {"own": "no_match", "match": "match", "exclude": None}[none]
    status = F.col("status")
    file = F.when(status == "single", "match").when(status == "multiple", F.lit(many)).when(status == "none", F.lit(empty))
    out = found.withColumn("file", file).where("file is not null")
    if multiple == "no_match":
        gone = [F.when(status != "multiple", F.col(c)).alias(c) if c in ("primary_id", "secondary_id", "orientation", "before", "found", "after", "notes") else F.col(c) for c in out.columns if c not in ("seq", "qual")]
        whole = [F.when(status == "multiple", F.lit(None)).otherwise(F.col(c)).alias(c) for c in ("seq", "qual")]
        out = out.select(*gone, *whole).distinct()
    return out


def find_summary(found: DataFrame) -> DataFrame:
    """One row: reads in all, with one, several and no match, skipped, and their percentages."""
    per = found.groupBy("read_index").agg(F.min("status").alias("status"))
    n = F.count(F.lit(1))
    kinds = ("single", "multiple", "none", "skipped")
    return per.agg(n.alias("reads"), *[F.count_if(F.col("status") == k).alias(k) for k in kinds], *[F.round(100.0 * F.count_if(F.col("status") == k) / n, 2).alias(f"pct_{k}") for k in kinds])


def match_summary(found: DataFrame) -> DataFrame:
    """Per searched sequence: matches, those shared with others in the read, and not shared."""
    return found.where("primary_id is not null").groupBy("primary_id", "secondary_id").agg(
        F.count(F.lit(1)).alias("matches"), F.count_if(F.col("status") == "multiple").alias("shared"), F.count_if(F.col("status") == "single").alias("not_shared")
    )


def paired_files(names: DataFrame) -> DataFrame:
    """Files whose lists of read names agree, in pairs: (digest, one, two); `names`: path, read_index, name.

    Names are digested with their place and the digests combined by a sum, so no list of names is ever put
    together. Digests that exactly two files share make a pair.
    """
    part = F.conv(F.substring(F.md5(F.concat_ws(" ", F.col("read_index").cast("string"), "name")), 1, 15), 16, 10).cast("decimal(38,0)")
    per = names.groupBy("path").agg(F.sum(part).alias("total"), F.count(F.lit(1)).alias("n"))
    digest = F.md5(F.concat_ws("/", F.col("total").cast("string"), F.col("n").cast("string")))
    same = per.groupBy(digest.alias("digest")).agg(F.min("path").alias("one"), F.max("path").alias("two"), F.count(F.lit(1)).alias("files"))
    return same.where("files = 2").drop("files")
