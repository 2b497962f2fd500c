"""Queries of the read operators over the project tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import sequence as S
from readloom.functions.keys import code_key, container_key, read_stem
from readloom.operators import alignment, checks, dedup, joins, kmers, words
from readloom.operators import statistics as st
from readloom.plans import pipeline
from readloom.session import scratch, spread
from readloom.streaming import files

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def key(c: str, case: str = "upper") -> str:
    return f"nullif({case}(trim({c}, {_BLANK})), '')"


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """pairs with tidy keys, and both barcodes as one."""
    return table(spark, sf, "pairs").select("read_index", code_key("probe_id").alias("probe_id"), F.concat(code_key("ext_uid"), code_key("lig_uid")).alias("uid"), "score")


def extended_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """`pairs`, and whether both mates could be extended."""
    both = F.coalesce(F.col("is_read_one_extended") & F.col("is_read_two_extended"), F.lit(False))
    return table(spark, sf, "pairs").select("read_index", code_key("probe_id").alias("probe_id"), F.concat(code_key("ext_uid"), code_key("lig_uid")).alias("uid"), "score", both.alias("extended"))


_P = f"p as (select read_index, {key('probe_id')} as probe_id, {key('ext_uid')} || {key('lig_uid')} as uid, score from pairs)"
_E = f"p as (select read_index, {key('probe_id')} as probe_id, {key('ext_uid')} || {key('lig_uid')} as uid, score, coalesce(is_read_one_extended and is_read_two_extended, false) as able from pairs)"
_G = "g as (select * from p where read_index is not null and probe_id is not null and uid is not null)"
_BEST = f"""{_P}, {_G}, r as (select *, row_number() over (partition by probe_id, uid order by score desc nulls last, read_index) as r, count(*) over (partition by probe_id, uid) as n_pairs from g),
best as (select probe_id, uid, read_index as best_index, score as best_score, n_pairs from r where r = 1)"""
_STATS = f"""{_E}, {_G}, r as (
  select *, row_number() over (partition by probe_id, uid order by score desc nulls last, read_index, able desc) as r, count(*) over (partition by probe_id, uid) as n_pairs from g
), s as (
  select q.probe_id, count(*) filter (where r = 1 and able) as unique_pairs, count(*) filter (where able) as total_pairs, coalesce(max(n_pairs), 0) as max_pairs_per_uid
  from probes q left join r on q.probe_id = r.probe_id group by 1
), stats as (
  select probe_id, unique_pairs, total_pairs - unique_pairs as duplicate_pairs, total_pairs,
    case when unique_pairs = 0 then 0.0 else round(total_pairs::double / unique_pairs, 2) end as average_pairs_per_uid, max_pairs_per_uid from s)"""


@query(f"with {_BEST} select * from best")
def dedup_best_pair(spark, sf):
    """The best pair of each probe and barcode."""
    return dedup.best_pairs(pairs(spark, sf))


@query(f"with {_BEST} select g.read_index, g.probe_id, g.uid, g.score, b.best_index is null as is_duplicate, b.best_index is not null as is_best from g left join best b on g.probe_id = b.probe_id and g.read_index = b.best_index")
def dedup_mark_duplicates(spark, sf):
    return dedup.reduce_duplicates(pairs(spark, sf), policy="mark")


@query(f"with {_BEST} select g.read_index, g.probe_id, g.uid, g.score, false as is_duplicate, true as is_best from g join best b on g.probe_id = b.probe_id and g.read_index = b.best_index")
def dedup_remove_duplicates(spark, sf):
    return dedup.reduce_duplicates(pairs(spark, sf))


@query(f"with {_P}, {_G} select *, false as is_duplicate, true as is_best from g")
def dedup_keep_all(spark, sf):
    return dedup.reduce_duplicates(pairs(spark, sf), policy="keep")


@query(f"with {_STATS} select * from stats")
def probe_stats(spark, sf):
    """Per probe, without the pairs that couldn't be extended."""
    return dedup.probe_stats(extended_pairs(spark, sf), table(spark, sf, "probes"))


@query(f"with {_STATS} select s.*, container_name, least(ext_start, lig_start) as start, greatest(ext_stop, lig_stop) as stop, strand from stats s join probes using (probe_id)")
def probe_details(spark, sf):
    return dedup.probe_details(extended_pairs(spark, sf), table(spark, sf, "probes"))


@query(f"with {_BEST} select probe_id, uid, n_pairs as n, row_number() over (partition by probe_id order by n_pairs desc, uid) as rank from best")
def uid_tallies(spark, sf):
    return dedup.uid_tallies(pairs(spark, sf))


@query(f"with {_P} select count(distinct uid) as distinct_uids from p")
def distinct_uids(spark, sf):
    return dedup.distinct_uids(pairs(spark, sf))


def _records(spark, sf):
    """Mates of pairs that have a mapping quality as records; a quality of 0 counts as unmapped."""
    mates = F.array(*[F.struct(F.lit(m).alias("mate"), F.col(c).alias("q")) for m, c in ((1, "one_mapq"), (2, "two_mapq"))])
    return table(spark, sf, "pairs").select(F.col("read_name").alias("name"), F.explode(mates).alias("m")).where("m.q is not null").select("name", "m.mate", (F.col("m.q") > 0).alias("mapped"))


_CLASSES = """c as (select read_name, max((one_mapq > 0)::int) as a, max((two_mapq > 0)::int) as b from pairs where read_name is not null and (one_mapq is not null or two_mapq is not null) group by 1),
classes as (select count(*) filter (where a + b = 2) as both_mapped, count(*) filter (where a + b = 1) as one_mapped, count(*) filter (where a + b = 0) as none_mapped, count(*) filter (where a is null or b is null) as unpaired from c)"""


@query(f"with {_CLASSES} select * from classes")
def mapping_classes(spark, sf):
    return dedup.mapping_classes(_records(spark, sf))


@query(f"""with {_STATS}, {_CLASSES}, t as (
  select sum(unique_pairs)::bigint as u, sum(duplicate_pairs)::bigint as d, count(*) as n, count(*) filter (where total_pairs = 0) as e, count(*) filter (where unique_pairs > 0) as l,
    max(unique_pairs) as m, sum(average_pairs_per_uid) filter (where unique_pairs > 0) as a from stats)
select 'sample' as sample_prefix, both_mapped + one_mapped + none_mapped as input_read_pairs, both_mapped as pairs_with_both_reads_mapped, none_mapped as pairs_with_both_reads_unmapped,
  one_mapped as pairs_with_only_one_read_mapped, u + d as pairs_with_on_target_reads, round_even(100.0 * (u + d) / both_mapped, 4) as pct_pairs_with_on_target_reads,
  greatest(0, both_mapped - u - d) as pairs_with_off_target_reads, round_even(100.0 * greatest(0, both_mapped - u - d) / both_mapped, 4) as pct_pairs_with_off_target_reads, d as duplicate_read_pairs_removed,
  round_even(100.0 * d / (u + d), 1) as duplicate_rate, n as probes, e as probes_with_no_mapped_read_pairs, u as unique_read_pairs, (select count(distinct uid) from p) as distinct_uids_found,
  round_even(u / n, 4) as average_uids_per_probe, round_even(u / l, 4) as average_uids_per_probes_with_reads, m as max_uids_per_probe, round_even(a / l, 4) as average_read_pairs_per_uid,
  unpaired as unpaired_reads, 2 * (both_mapped + one_mapped + none_mapped) + unpaired as input_reads from t, classes""")
def summary_report(spark, sf):
    return dedup.summary_report(extended_pairs(spark, sf), table(spark, sf, "probes"), dedup.mapping_classes(_records(spark, sf)), prefix="sample")


@query(f"with {_STATS} select container_name, least(ext_start, lig_start) as start, greatest(ext_stop, lig_stop) as stop, probe_id, unique_pairs, strand, target_start, target_stop from stats join probes using (probe_id)")
def probe_coverage(spark, sf):
    return dedup.probe_coverage(extended_pairs(spark, sf), table(spark, sf, "probes"))


_LENGTHS = "(select max(length(ext_sequence)) as xe, min(length(ext_sequence)) as ne, max(length(lig_sequence)) as xg, min(length(lig_sequence)) as ng, min(length(target_sequence)) as nt, max(length(target_sequence)) as xt from probes)"


@query(f"select 10 + xe as r1_first, nt + ng as r1_last, xg as r2_first, nt + ne as r2_last from {_LENGTHS}")
def trim_lengths(spark, sf):
    return dedup.trim_lengths(table(spark, sf, "probes"))


@query(f"select ne as min_ext, xe as max_ext, ng as min_lig, xg as max_lig, nt as min_target, xt as max_target from {_LENGTHS}")
def probe_length_stats(spark, sf):
    return dedup.probe_length_stats(table(spark, sf, "probes"))


@query("""with w as (select probe_id, ext_sequence || target_sequence || lig_sequence as sequence from probes)
select sequence, list_sort(list(distinct probe_id)) as probe_ids from w where sequence is not null group by 1 having count(distinct probe_id) > 1""")
def shared_probe_sequences(spark, sf):
    return dedup.shared_probe_sequences(table(spark, sf, "probes"))


_SIZES = f"select {key('container_name', 'lower')} as container_name, max(greatest(chrom_start, chrom_end)) as size from features group by 1"


@query(f"with d as ({_SIZES}) select probe_id, p.container_name, greatest(ext_stop, lig_stop) as stop, size from probes p left join d on p.container_name = d.container_name where size is null or greatest(ext_stop, lig_stop) > size")
def probes_out_of_bounds(spark, sf):
    sizes = table(spark, sf, "features").groupBy(container_key("container_name").alias("container_name")).agg(F.max(F.greatest("chrom_start", "chrom_end")).alias("size"))
    return dedup.probes_out_of_bounds(table(spark, sf, "probes"), sizes)


# --- names and trimming


@query("select read_name, nullif(regexp_extract(read_name, '^[^ /]*'), '') as stem from read2probe")
def read_name_canonical(spark, sf):
    return table(spark, sf, "read2probe").select("read_name", read_stem("read_name").alias("stem"))


@query("select read_index, substr(r1_seq, 1, 10) as uid from pairs where r1_seq is not null and not contains(lower(r1_seq), 'n') and not coalesce(contains(lower(r2_seq), 'n'), false)")
def uid_extract_n_filter(spark, sf):
    df = table(spark, sf, "pairs").where("r1_seq is not null")
    return df.where(~S.has_n("r1_seq") & ~F.coalesce(S.has_n("r2_seq"), F.lit(False))).select("read_index", S.uid("r1_seq", 10).alias("uid"))


@query("""select read_index, substr(r1_seq, 6, least(19, length(r1_seq) - 1) - 4) as seq, substr(r1_qual, 6, least(19, length(r1_seq) - 1) - 4) as qual
from pairs where length(r1_seq) > 5 and length(r1_seq) = length(r1_qual)""")
def fixed_trim(spark, sf):
    df = table(spark, sf, "pairs").where("length(r1_seq) > 5 and length(r1_seq) = length(r1_qual)")
    return df.select("read_index", S.fixed_trim("r1_seq", "r1_qual", 5, 19).alias("c")).select("read_index", "c.*")


@query("""with a as (select read_index, r1_seq as s, r1_qual as q, length(regexp_extract(r1_qual, '^[!-4]*')) as l from pairs where r1_qual is not null),
b as (select *, substr(q, l + 1) as r from a), c as (select *, length(r) - length(regexp_extract(r, '[!-0]*$')) as k from b)
select read_index, substr(s, l + 1, k) as seq, substr(r, 1, k) as qual from c""")
def quality_trim(spark, sf):
    df = table(spark, sf, "pairs").where("r1_qual is not null")
    return df.select("read_index", S.quality_trim("r1_seq", "r1_qual", 20, 16).alias("c")).select("read_index", "c.*")


@query("select read_index, list_sum(list_transform(range(1, length(r1_qual) + 1), lambda i: unicode(r1_qual[i]) - 33))::bigint as total from pairs where length(r1_qual) > 0")
def quality_totals(spark, sf):
    return spread(table(spark, sf, "pairs").where("length(r1_qual) > 0").select("read_index", "r1_qual")).select("read_index", S.quality_total("r1_qual").alias("total"))


# --- sequences


_COMP = "translate({}, 'ACGTURYSWKMBDHVN', 'TGCAAYRSWMKVHDBN')"


def _n(s: str, codes: str) -> str:
    return f"length(regexp_replace({s}, '[^{codes}]', '', 'g'))"


@query("select probe_id, o.orientation, o.sequence from (select probe_id, unnest([{'orientation': 'FWD', 'sequence': s}, {'orientation': 'RVS', 'sequence': reverse(s)}, {'orientation': 'RVS_CMP', 'sequence': reverse("
       + _COMP.format("s") + ")}, {'orientation': 'CMP', 'sequence': " + _COMP.format("s") + "}]) as o from (select probe_id, ext_sequence as s from probes))")
def sequence_orientations(spark, sf):
    return table(spark, sf, "probes").select("probe_id", F.explode(S.orientations("ext_sequence")).alias("o")).select("probe_id", "o.*")


# The published values once more, written out for the SQL: what a sequence starts with, has with any G or C and without, and has for
# each A/T and G/C end, then the ten 2-mers; enthalpy and entropy each.
_NN = {
    "breslauer1986": "0 0 / 0 -16.8 / 0 -20.1 / 0 0 / 0 0 / AA -9.1 -24.0 AT -8.6 -23.9 TA -6.0 -16.9 CA -5.8 -12.9 GT -6.5 -17.3 CT -7.8 -20.8 GA -5.6 -13.5 CG -11.9 -27.8 GC -11.1 -26.7 GG -11.0 -26.6",
    "sugimoto1996": "0.6 -9.0 / 0 0 / 0 0 / 0 0 / 0 0 / AA -8.0 -21.9 AT -5.6 -15.2 TA -6.6 -18.4 CA -8.2 -21.0 GT -9.4 -25.5 CT -6.6 -16.4 GA -8.8 -23.5 CG -11.8 -29.0 GC -10.5 -26.4 GG -10.9 -28.4",
    "santalucia1997": "0 0 / 0 0 / 0 0 / 2.3 4.1 / 0.1 -2.8 / AA -7.9 -22.2 AT -7.2 -20.4 TA -7.2 -21.3 CA -8.5 -22.7 GT -8.4 -22.4 CT -7.8 -21.0 GA -8.2 -22.2 CG -10.6 -27.2 GC -9.8 -24.4 GG -8.0 -19.9",
    "santalucia2004": "0.2 -5.7 / 0 0 / 0 0 / 2.2 6.9 / 0 0 / AA -7.6 -21.3 AT -7.2 -20.4 TA -7.2 -20.4 CA -8.5 -22.7 GT -8.4 -22.4 CT -7.8 -21.0 GA -8.2 -22.2 CG -10.6 -27.2 GC -9.8 -24.4 GG -8.0 -19.0",
}


def _nn_sql(source: str) -> str:
    *ends, steps = [x.split() for x in _NN[source].split(" / ")]
    start, any_gc, no_gc, at, gc = ends

    def total(i: int) -> str:
        whens = " ".join(f"when p = '{steps[k]}' or p = reverse(translate('{steps[k]}', 'ACGT', 'TGCA')) then {float(steps[k + 1 + i])}" for k in range(0, 30, 3))
        both = " + ".join(f"(case when {e} in ('A', 'T') then {float(at[i])} else {float(gc[i])} end)" for e in ("s[1]", "s[length(s)]"))
        pairs = "list_transform(range(1, length(s)), lambda j: s[j:j+1])"
        return f"list_sum(list_transform({pairs}, lambda p: (case {whens} else 0.0 end)::double)) + {both} + {float(start[i])} + (case when regexp_matches(s, '[GC]') then {float(any_gc[i])} else {float(no_gc[i])} end)"

    return f"round(1000 * ({total(0)}) / (({total(1)}) + 0.368 * (length(s) - 1) * ln(50 / 1e3) + 1.9872 * ln(25 / 4 * 1e-9)) - 273.15, 6)"


@query(f"""with x as (select probe_id, lig_sequence as s from probes where length(lig_sequence) > 1),
c as (select *, {_n('s', 'ARWMDHVN')} as a, {_n('s', 'CYSB')} as c, {_n('s', 'GK')} as g, {_n('s', 'TU')} as t from x)
select probe_id, 100.0 * {_n('s', 'CGRYSKMBDHVN')} / length(s) as gc, a, c, g, t, 2 * (a + t) + 4 * (g + c) as tm_wallace, 64.9 + 41 * (g + c - 16.4) / length(s) as tm_gc,
{', '.join(f'{_nn_sql(k)} as tm_{k}' for k in _NN)} from c""")
def sequence_measures(spark, sf):
    """GC percentage, base counts and melting temperatures of ligation primers."""
    c = "lig_sequence"
    n = S.base_counts(c)
    return table(spark, sf, "probes").where(f"length({c}) > 1").select(
        "probe_id", S.gc_percent(c).alias("gc"), *[n[x].alias(x) for x in "acgt"], S.melting_wallace(c).alias("tm_wallace"), S.melting_gc(c).alias("tm_gc"),
        *[F.round(S.melting_neighbour(c, source=k), 6).alias(f"tm_{k}") for k in S.NEIGHBOURS],
    )


_FIT = "list_filter(range(1, length(t) - length(q) + 2), lambda i: len(list_filter(range(0, length(q)), lambda j: t[i + j] <> q[j + 1] and t[i + j] <> 'N' and q[j + 1] <> 'N')) <= {})"


@query(f"""with x as (select probe_id, ext_sequence as q, target_sequence as t from probes), y as (select *, {_FIT.format(12)} as l, {_FIT.format(1)} as strict from x)
select probe_id, strict as positions, l[1:3] as first_three, l[1] as first, len(l) > 0 as any from y""")
def approximate_matches(spark, sf):
    """Places of the whole primers in the targets: all with one mismatch allowed, the first three and the first with twelve, and whether there are any."""
    loose = S.approximate_matches("target_sequence", "ext_sequence", 12, first=3)
    return table(spark, sf, "probes").select(
        "probe_id", S.approximate_matches("target_sequence", "ext_sequence", 1).alias("positions"), loose.alias("first_three"), S.first_match("target_sequence", "ext_sequence", 12).alias("first"),
        S.has_match("target_sequence", "ext_sequence", 12).alias("any"),
    )


@query("""with x as (select read_index, r1_seq as u, reverse(translate(r2_seq, 'ACGTURYSWKMBDHVN', 'TGCAAYRSWMKVHDBN')) as d, r1_qual as uq, reverse(r2_qual) as dq from pairs
  where length(r1_seq) = length(r1_qual) and length(r2_seq) = length(r2_qual) and length(r1_seq) >= 8 and length(r2_seq) >= 8), y as (select *, length(u) - 8 as h from x)
select read_index, substr(u, 1, h) || list_aggregate(list_transform(range(1, 9), lambda i: case when unicode(uq[h + i]) >= unicode(dq[i]) then u[h + i] else d[i] end), 'string_agg', '') || substr(d, 9) as seq,
  substr(uq, 1, h) || list_aggregate(list_transform(range(1, 9), lambda i: case when unicode(uq[h + i]) >= unicode(dq[i]) then uq[h + i] else dq[i] end), 'string_agg', '') || substr(dq, 9) as qual from y""")
def pair_merge(spark, sf):
    """Mates of pairs merged over 8 bases."""
    ok = "length(r1_seq) = length(r1_qual) and length(r2_seq) = length(r2_qual) and length(r1_seq) >= 8 and length(r2_seq) >= 8"
    df = spread(table(spark, sf, "pairs").where(ok).select("read_index", "r1_seq", "r1_qual", "r2_seq", "r2_qual"))
    down = S.reverse_complement("r2_seq")
    m = S.merge_pair(F.lit(False), F.col("r1_seq"), down, F.col("r1_qual"), F.reverse("r2_qual"), F.lit(1), F.length("r1_seq") - 7)
    return df.select("read_index", m.alias("m")).select("read_index", "m.*")


# --- compositions and k-mers


_CODES = "ACGTURYSWKMBDHVN"


@query(f"""with b as (select {key('probe_id')} as probe_id, unnest(string_split(upper(ext_uid), '')) as code from pairs), c as (select probe_id, code, count(*) as n from b where contains('{_CODES}', code) group by 1, 2)
select probe_id, code, n, round(n / sum(n) over (partition by probe_id), 3) as share from c""")
def composition(spark, sf):
    df = table(spark, sf, "pairs").select(code_key("probe_id").alias("probe_id"), "ext_uid")
    return st.composition(df, ["probe_id"], F.col("ext_uid"))


@query(f"""with d as (select distinct {key('probe_id')} as probe_id, {key('ext_uid')} as u from pairs), b as (select probe_id, unnest(string_split(u, '')) as code from d), c as (select probe_id, code, count(*) as n from b where contains('{_CODES}', code) group by 1, 2)
select probe_id, code, n, round(n / sum(n) over (partition by probe_id), 3) as share from c""")
def composition_unique(spark, sf):
    df = table(spark, sf, "pairs").select(code_key("probe_id").alias("probe_id"), code_key("ext_uid").alias("u")).distinct()
    return st.composition(df, ["probe_id"], F.col("u"))


@query(f"""with e as (select {key('ext_uid')} as u from pairs), b as (select u[p] as code, p - 1 as pos from (select u, unnest(range(1, length(u) + 1)) as p from e))
select pos::int as pos, count(*) as n, {', '.join(f"count(*) filter (where code = '{x}') / count(*) as {x.lower()}" for x in 'ACGT')} from b group by 1""")
def composition_by_position(spark, sf):
    df = table(spark, sf, "pairs").select(code_key("ext_uid").alias("u"))
    return st.composition_by_position(df, [], F.col("u"))


@query(f"""with c as (select {key('probe_id')} as probe_id, {key('ext_uid')} as value, count(*) as n from pairs where {key('ext_uid')} is not null group by 1, 2)
select *, n / sum(n) over (partition by probe_id) as share, n = max(n) over (partition by probe_id) as is_mode from c""")
def tally_modes(spark, sf):
    df = table(spark, sf, "pairs").select(code_key("probe_id").alias("probe_id"), code_key("ext_uid").alias("u"))
    return st.tally(df, ["probe_id"], F.col("u"))


@query(f"select v as value, count(*) as n from (select {key('ext_uid')} as v from pairs union all select {key('lig_uid')} from pairs) where v is not null group by 1")
def tally_merge(spark, sf):
    df = table(spark, sf, "pairs")
    one, two = (df.select(code_key(c).alias("value")).dropna().groupBy("value").agg(F.count(F.lit(1)).alias("n")) for c in ("ext_uid", "lig_uid"))
    return st.merge_tallies(one, two, [])


_WHOLE = "ext_sequence || target_sequence || lig_sequence"


@query(f"""with r as (select distinct probe_id as reference_id, upper(s)[p:p + 7] as k from (select probe_id, {_WHOLE} as s, unnest(range(1, length({_WHOLE}) - 7)) as p from probes)),
q as (select read_index as query_id, s[p:p + 7] as k from (select read_index, upper(r1_seq) as s, unnest(range(1, length(r1_seq) - 7)) as p from (select distinct read_index, r1_seq from pairs)))
, h as (select query_id, reference_id, count(*) as hits from q join r using (k) group by 1, 2), k as (select *, rank() over (partition by query_id order by hits desc) as rank from h)
select * from k where rank <= 11""")
def kmer_candidates(spark, sf):
    """Probes whose whole sequence shares 8-mers with read one: the best ten, one more and ties."""
    reads = spread(table(spark, sf, "pairs").select(F.col("read_index").alias("query_id"), F.col("r1_seq").alias("seq"))).distinct()
    refs = table(spark, sf, "probes").select(F.col("probe_id").alias("reference_id"), F.concat("ext_sequence", "target_sequence", "lig_sequence").alias("seq"))
    return kmers.candidates(reads, refs, k=8, limit=10)


@query("""with m as (select s[p:p + 9] as kmer from (select upper(target_sequence) as s, unnest(range(1, length(target_sequence) - 8)) as p from probes)),
b as (select kmer from m union all select reverse(translate(kmer, 'ACGT', 'TGCA')) from m), c as (select kmer, count(*) as n from b where regexp_full_match(kmer, '[ACGT]+') group by 1 having count(*) > 1)
select kmer, list_sum(list_transform(range(1, 11), lambda i: (strpos('ACGT', kmer[i]) - 1) * pow(4, 10 - i)))::bigint as number, n from c""")
def kmer_repeated(spark, sf):
    return kmers.repeated(table(spark, sf, "probes"), "probe_id", "target_sequence", 10, both_strands=True)


@query("""with g as (select probe_id as container, upper(ext_sequence || target_sequence || lig_sequence) as s from probes),
q as (select probe_id as query_id, upper(lig_sequence) as q from probes where regexp_full_match(upper(lig_sequence), '[ACGT]{11,}')),
w as (select query_id, '+' as strand, q from q union all select query_id, '-', reverse(translate(q, 'ACGT', 'TGCA')) from q)
select distinct query_id, container, strpos(s, q)::bigint as start, strand from w join g on contains(s, q)""")
def genome_exact_search(spark, sf):
    """Ligation primers looked up in all probes' sequences, on both strands."""
    p = table(spark, sf, "probes")
    genome = p.select(F.col("probe_id").alias("container"), F.lit(1).cast("long").alias("start"), F.concat("ext_sequence", "target_sequence", "lig_sequence").alias("seq"))
    return kmers.exact_search(genome, p.select(F.col("probe_id").alias("query_id"), F.col("lig_sequence").alias("seq")))


# --- joins of reads


def _mates(spark, sf):
    """read2probe by stem and mate, where the name tells the mate."""
    tail = F.regexp_extract("read_name", "[ /]([12])", 1)
    return table(spark, sf, "read2probe").select(read_stem("read_name").alias("read_index"), tail.try_cast("int").alias("mate"), code_key("probe_id").alias("probe_id")).where("mate is not null")


_MATES = f"m as (select nullif(regexp_extract(read_name, '^[^ /]*'), '') as read_index, try_cast(regexp_extract(read_name, '[ /]([12])', 1) as int) as mate, {key('probe_id')} as probe_id from read2probe)"


@query(f"""with {_MATES} select read_index, min(probe_id) filter (where mate = 1) as one, min(probe_id) filter (where mate = 2) as two, count(*) filter (where mate = 1) > 0 as has_one
from m where mate is not null and read_index is not null and probe_id is not null group by 1 having count(*) filter (where mate = 1) > 0 and count(*) filter (where mate = 2) > 0""")
def mate_pairing(spark, sf):
    got = joins.pair_mates(_mates(spark, sf).dropna(), "read_index", "mate")
    return got.select("read_index", F.col("one.probe_id").alias("one"), F.col("two.probe_id").alias("two"), F.lit(True).alias("has_one"))


@query(f"with {_MATES} select distinct a.read_index, a.probe_id from m a join m b on a.read_index = b.read_index and a.probe_id = b.probe_id and a.mate = 1 and b.mate = 2")
def mate_probe_intersection(spark, sf):
    return joins.mate_probe_intersection(_mates(spark, sf))


_RAW = "r as (select read_name as name, 1 as mate, min(read_index) as read_index, min(r1_seq) as seq, min(r1_qual) as qual from pairs group by 1)"


@query(f"""with {_RAW}, a as (select read_name as name, 1 as mate, min(struct_pack(start := coalesce(read_index, 0), l := length(substr(r1_seq, 5, 20)))) as s from (
  select distinct read_name, read_index, r1_seq from pairs where read_name is not null) group by 1)
select name, mate, s.start as start, read_index, seq, qual from a join r using (name, mate)""")
def merge_raw_reads(spark, sf):
    p = table(spark, sf, "pairs")
    reads = p.groupBy(F.col("read_name").alias("name")).agg(F.lit(1).alias("mate"), F.min("read_index").alias("read_index"), F.min("r1_seq").alias("seq"), F.min("r1_qual").alias("qual"))
    aln = p.select(F.col("read_name").alias("name"), F.lit(1).alias("mate"), F.coalesce("read_index", F.lit(0)).alias("start"), F.substring("r1_seq", 5, 20).alias("seq"))
    return joins.merge_raw_reads(aln, reads).drop("mapped_length")


@query("select p.read_index, p.score, n.name as original_name from (select read_index, score from pairs) p join (select read_index, min(read_name) as name from pairs group by 1) n on p.read_index = n.read_index")
def restore_names(spark, sf):
    p = table(spark, sf, "pairs")
    return joins.restore_names(p.select("read_index", "score"), p.groupBy("read_index").agg(F.min("read_name").alias("name")))


@query("select read_index, read_name from pairs where read_index not in (select read_index from pairs where read_index is not null group by 1 having count(*) > 1)")
def ambiguous_anti(spark, sf):
    return joins.unambiguous(table(spark, sf, "pairs").select("read_index", "read_name"), "read_index", 1)


@query("select read_name, probe_id from read2probe r where not exists (select 1 from pairs p where p.read_name = r.read_name)")
def exclude_names(spark, sf):
    return joins.excluding(table(spark, sf, "read2probe").select("read_name", "probe_id"), table(spark, sf, "pairs"), "read_name")


@query(f"""with {_MATES}, c as (select read_index, probe_id, count(*) as matches, length(probe_id) as edits from m where read_index is not null group by 1, 2),
r as (select *, rank() over (partition by read_index order by matches desc, edits nulls first) as r from c), b as (select *, count(*) over (partition by read_index) as n from r where r = 1)
select read_index, probe_id, matches, edits from b where n = 1""")
def best_candidate_unique(spark, sf):
    r = table(spark, sf, "read2probe").select(read_stem("read_name").alias("read_index"), code_key("probe_id").alias("probe_id")).where("read_index is not null")
    return joins.best_candidates(r.groupBy("read_index", "probe_id").agg(F.count(F.lit(1)).alias("matches"), F.length(F.first("probe_id")).alias("edits")))


@query("""with a as (select l_orderkey as name, l_suppkey % 3 as p, l_linenumber % 2 as s from lineitem), b as (select l_orderkey as name, l_partkey % 3 as p, l_linenumber % 2 as s from lineitem),
n as (select name, count(*) as c from a join b using (name, p) where a.s <> b.s group by 1)
select name, coalesce(c, 0) as pairings, case when coalesce(c, 0) = 0 then 'none' when c = 1 then 'single' else 'multiple' end as status from (select distinct name from a) left join n using (name)""")
def pair_assignments(spark, sf):
    li = table(spark, sf, "lineitem")
    one = li.select(F.col("l_orderkey").alias("name"), (F.col("l_suppkey") % 3).alias("primary_id"), (F.col("l_linenumber") % 2).alias("secondary_id"))
    two = li.select(F.col("l_orderkey").alias("name"), (F.col("l_partkey") % 3).alias("primary_id"), (F.col("l_linenumber") % 2).alias("secondary_id"))
    return joins.pair_assignments(one, two)


@query(f"select p as probe_id from (select {key('probe_id')} as p from pairs intersect select {key('probe_id')} from read2probe)")
def intersect_sets(spark, sf):
    return table(spark, sf, "pairs").select(code_key("probe_id").alias("probe_id")).intersect(table(spark, sf, "read2probe").select(code_key("probe_id").alias("probe_id")))


@query("select read_name from pairs union select read_name from read2probe")
def union_dedup(spark, sf):
    return table(spark, sf, "pairs").select("read_name").union(table(spark, sf, "read2probe").select("read_name")).dropDuplicates()


@query("select read_name from read2probe except select read_name from pairs")
def except_sets(spark, sf):
    return table(spark, sf, "read2probe").select("read_name").subtract(table(spark, sf, "pairs").select("read_name"))


# --- alignment kernels, commands and streams; rows only here, tested against brute force


@query()
def nw_align(spark, sf):
    """Read one of every pair aligned to its probe's target, each distinct pair of sequences once."""
    p = table(spark, sf, "pairs").select(code_key("probe_id").alias("probe_id"), "r1_seq")
    both = p.join(table(spark, sf, "probes").select("probe_id", "target_sequence"), "probe_id")
    return alignment.global_alignments(both, "target_sequence", "r1_seq")


@query()
def extend_to_primer(spark, sf):
    p = table(spark, sf, "pairs").select(F.col("read_index").alias("id"), code_key("probe_id").alias("probe_id"), F.col("r1_seq").alias("r1"), F.col("r2_seq").alias("r2"))
    out = alignment.extend_to_primers(p, table(spark, sf, "probes"))
    return out.select("id", "probe_id", F.col("one.cigar").alias("one_cigar"), F.col("two.cigar").alias("two_cigar"), "extended")


def _primers(spark, sf):
    primers = F.array(*[F.struct(F.lit(k).alias("secondary_id"), F.col(c).alias("seq")) for k, c in (("extension", "ext_sequence"), ("ligation", "lig_sequence"))])
    return table(spark, sf, "probes").select(F.col("probe_id").alias("primary_id"), F.explode(primers).alias("s")).select("primary_id", "s.*")


def _found(spark, sf):
    p = table(spark, sf, "pairs").groupBy("read_index").agg(F.min("r1_seq").alias("seq"), F.min("r1_qual").alias("qual"))
    return pipeline.find_and_trim(p.where("length(seq) = length(qual)"), _primers(spark, sf))


_SOUGHT = """w as (select probe_id as primary_id, s.k as secondary_id, upper(s.q) as q from (select probe_id, unnest([{'k': 'extension', 'q': ext_sequence}, {'k': 'ligation', 'q': lig_sequence}]) as s from probes))"""


@query(f"""with {_SOUGHT}, r as (select read_index, upper(min(r1_seq)) as seq, min(r1_qual) as qual from pairs group by 1), c as (select * from r where length(seq) = length(qual) and not contains(seq, 'N')),
h as (select read_index, primary_id, secondary_id, strpos(seq, q)::int - 1 as place, length(q)::int as size from c join w on contains(seq, q))
select read_index, primary_id, secondary_id, place, size from h""")
def exact_primers(spark, sf):
    """Whole extension and ligation primers, as they are, found in read one without a mismatch: each place once, the first one of a read."""
    p = table(spark, sf, "pairs").groupBy("read_index").agg(F.min("r1_seq").alias("seq"), F.min("r1_qual").alias("qual"))
    found = pipeline.find_and_trim(p.where("length(seq) = length(qual)"), _primers(spark, sf), pipeline.FindOptions(mismatches=0, orientations=("FWD",)))
    return found.where("primary_id is not null").select("read_index", "primary_id", "secondary_id", F.length("before").alias("place"), F.length("found").alias("size"))


@query()
def find_and_trim(spark, sf):
    """Whole extension and ligation primers, in all orientations, found in read one."""
    return _found(spark, sf)


@query()
def find_summary(spark, sf):
    return pipeline.find_summary(_found(spark, sf))


@query(ORACLE["dedup_best_pair"])
def stream_best_pair(spark, sf):
    """`dedup_best_pair` over pairs as a stream of files; the last state is written to the shared folder."""
    src = table(spark, sf, "pairs")
    base = scratch(spark, "stream")
    stream = files.stream_table(spark, f"{sf}/pairs.parquet", src.schema, per_trigger=4)
    best = files.running_best(stream.select("read_index", code_key("probe_id").alias("probe_id"), F.concat(code_key("ext_uid"), code_key("lig_uid")).alias("uid"), "score"))
    run = best.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{base}/out")).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    if run.exception():
        raise run.exception()
    return spark.read.parquet(f"{base}/out")


# --- probes of alignments


@query(f"""with m as (select read_index, 1 as mate, {key('probe_id')} as own, one_mapq as q, two_mapq as o from pairs union all select read_index, 2, {key('probe_id')}, two_mapq, one_mapq from pairs),
a as (select read_index, mate, r.container_name as container, r.target_start - 40 + read_index % 80 as start, (case when r.strand = '+' then 1 else -1 end) * (case when mate = 1 then 1 else -1 end) as way,
  r.target_start - 20 as x_start, read_index % 5 = 0 as x from m join probes r on m.own = r.probe_id where q > 0 and o > 0 and read_index is not null),
n as (select read_index from a group by 1 having count(*) > 2), k as (select * from a where read_index not in (select read_index from n)),
h as (select read_index, mate, container, start, start + 29 as stop, way * (case when mate = 1 then 1 else -1 end) as way from k union all select read_index, mate, container, x_start, x_start + 24, way * (case when mate = 1 then 1 else -1 end) from k where x),
g as (select distinct h.read_index, h.mate, w.probe_id from h join probes w on h.container = w.container_name and h.way = (case when w.strand = '+' then 1 else -1 end)
  and least(w.ext_start, w.lig_start) <= h.start and h.stop <= greatest(w.ext_stop, w.lig_stop))
select read_index, probe_id from g group by 1, 2 having count(distinct mate) = 2""")
def assigned_probes(spark, sf):
    """Probes whose window holds both mates: 30 mapped bases around the target of the pair's probe, and for each fifth read an alternate hit of 25."""
    mates = F.array(*[F.struct(F.lit(m).alias("mate"), F.col(c).alias("q"), F.col(d).alias("o")) for m, c, d in ((1, "one_mapq", "two_mapq"), (2, "two_mapq", "one_mapq"))])
    p = table(spark, sf, "pairs").select("read_index", code_key("probe_id").alias("probe_id"), F.explode(mates).alias("m")).where("read_index is not null").select("read_index", "probe_id", "m.*")
    probes = table(spark, sf, "probes")
    both = p.join(probes.select("probe_id", F.col("container_name").alias("container"), "target_start", F.col("strand").alias("s")), "probe_id")
    way = F.when((F.col("s") == "+") == (F.col("mate") == 1), "+").otherwise("-")
    hit = F.struct(F.col("container").alias("container"), (F.col("target_start") - 20).cast("long").alias("start"), way.alias("strand"), F.lit("20M5D").alias("cigar"), F.lit(0).alias("nm"))
    start = F.col("target_start") - 40 + F.col("read_index") % 80
    a = both.select(
        "read_index", "mate", "container", start.alias("start"), (start + 29).alias("end"), way.alias("strand"), F.lit(True).alias("is_primary"), F.coalesce(F.col("q") > 0, F.lit(False)).alias("mapped"),
        F.coalesce(F.col("o") > 0, F.lit(False)).alias("mate_mapped"), F.when(F.col("read_index") % 5 == 0, F.array(hit)).alias("xa"),
    )
    return pipeline.assign_probes(a, probes).select("read_index", "probe_id")


# --- checks


@query(f"""with m as (select read_index, {key('probe_id')} as probe_id, 1 as mate, length(r1_seq) as n from pairs union all select read_index, {key('probe_id')}, 2, length(r2_seq) from pairs),
b as (select m.*, r.*, (mate = 1) = (strand = '+') as at_start from m join probes r on m.probe_id = r.probe_id where n is not null),
c as (select *, 36 - n + case when mate = 1 then 10 else 0 end as gone, case when mate = 1 then (case when strand = '+' then ext_start else ext_stop end) else (case when strand = '+' then lig_stop else lig_start end) end as primer from b)
select read_index, probe_id, mate, abs(case when at_start then ext_start + gone else ext_start + 36 - 1 - gone end - primer) <= 40 as fits from c""")
def strict_coordinates(spark, sf):
    """Mates taken to be mapped over 36 bases from their probe's extension start on: whether they'd begin within 40 bases of their primer."""
    mates = F.array(*[F.struct(F.lit(m).alias("mate"), F.length(c).alias("n")) for m, c in ((1, "r1_seq"), (2, "r2_seq"))])
    p = table(spark, sf, "pairs").select("read_index", code_key("probe_id").alias("probe_id"), F.explode(mates).alias("m")).where("m.n is not null").select("read_index", "probe_id", "m.mate", "m.n")
    both = p.join(table(spark, sf, "probes"), "probe_id")
    ok = checks.fits_probe(F.col("ext_start"), F.lit(36), F.col("n"), F.col("mate"), F.col("strand"), *[F.col(c) for c in ("ext_start", "ext_stop", "lig_start", "lig_stop")], buffer=40)
    return both.select("read_index", "probe_id", "mate", ok.alias("fits"))


@query("""with a as (select l_orderkey * 8 + l_linenumber as i, l_shipdate as n from lineitem where l_linenumber < 5), b as (select l_orderkey * 8 + l_linenumber as i, l_shipdate as n from lineitem where l_linenumber > 2)
select coalesce(a.i, b.i) as read_index, a.n as name_one, b.n as name_two from a full join b on a.i = b.i where a.n is distinct from b.n""")
def mismatched_names(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("read_index"), F.col("l_shipdate").alias("name"), "l_linenumber")
    return pipeline.mismatched_names(li.where("l_linenumber < 5"), li.where("l_linenumber > 2"))


@query(f"select distinct nullif(regexp_extract(read_name, '^[^ /]*'), '') as read_name from read2probe where nullif(regexp_extract(read_name, '^[^ /]*'), '') is not null and {key('probe_id')} = (select min({key('probe_id')}) from read2probe)")
def assigned_names(spark, sf):
    """Distinct names assigned to the first probe, as a point lookup."""
    r = table(spark, sf, "read2probe").select(read_stem("read_name").alias("read_name"), code_key("probe_id").alias("probe_id"))
    return joins.names_of(r, r.agg(F.min("probe_id").alias("probe_id"))).select("read_name")


@query()
def variable_uids(spark, sf):
    """Barcodes before the whole extension primer of the read's probe, of any length."""
    p = table(spark, sf, "pairs").select(code_key("probe_id").alias("probe_id"), F.col("r1_seq").alias("read"))
    both = p.join(table(spark, sf, "probes").select("probe_id", F.col("ext_sequence").alias("primer")), "probe_id")
    return checks.variable_uids(both, "read", "primer")


@query()
def merged_words(spark, sf):
    """Annotations of each container's probes merged into one string."""
    return words.merged_words(table(spark, sf, "probes"), "container_name", "annotation")
