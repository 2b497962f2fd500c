"""Queries of interval, statistic, text and number operators over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.functions import cigar as C
from readloom.functions import numbers as N
from readloom.functions import sequence as S
from readloom.functions import text as X
from readloom.functions.keys import code_key, container_key
from readloom.operators import intervals, joins
from readloom.operators import statistics as st
from readloom.plans import pipeline
from readloom.plans.read_queries import key, table
from readloom.sources import lines as L

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _spans(spark, sf):
    f = table(spark, sf, "features")
    return f.select("feature_id", "feature_name", F.concat_ws("/", F.col("panel_id").cast("string"), container_key("container_name")).alias("container"), F.col("chrom_start").alias("start"), F.col("chrom_end").alias("stop"))


_F = f"f as (select feature_id, feature_name, concat_ws('/', panel_id::varchar, {key('container_name', 'lower')}) as container, chrom_start as start, chrom_end as stop, least(chrom_start, chrom_end) as a, greatest(chrom_start, chrom_end) as b from features where chrom_start is not null and chrom_end is not null)"
_RANGE = f"with {_F}, w as (select * from f where feature_name like 'capture%') select r.feature_id, w.feature_id as w_feature_id from f r join w on r.container = w.container and "


def _range(spark, sf, **options):
    s = _spans(spark, sf)
    got = joins.range_join(s, s.where("feature_name like 'capture%'"), **options)
    return got.select("feature_id", "w_feature_id")


@query(_RANGE + "w.a <= r.a and r.b <= w.b")
def containment_join(spark, sf):
    """Every feature within capture regions of its panel and container."""
    return _range(spark, sf)


@query(_RANGE + "w.a <= r.a and r.b <= w.b")
def containment_join_binned(spark, sf):
    return _range(spark, sf, bin_width=512)


@query(_RANGE + "greatest(w.a, r.a) <= least(w.b, r.b)")
def overlap_join(spark, sf):
    return _range(spark, sf, how="overlap")


@query(_RANGE + "greatest(w.a, r.a) <= least(w.b, r.b)")
def overlap_join_binned(spark, sf):
    return _range(spark, sf, how="overlap", bin_width=512)


_C = f"c as (select distinct {key('container_name', 'lower')} as c, chrom_start as s, chrom_end as e from features where chrom_start is not null and chrom_end is not null and container_name is not null)"
_ORDER = "case when regexp_matches(c, '[0-9]') then 0 else 1 end, try_cast(regexp_extract(c, '[0-9]+') as int), c"


def _neighbour_sql(previous: bool) -> str:
    g, m, d = ("<", "max", "desc") if previous else (">", "min", "")
    order = ", ".join(f"{x} {d}" for x in _ORDER.rsplit(", ", 1)[0].split(", try")[0:1]) + f", try_cast(regexp_extract(c, '[0-9]+') as int) {d}, c {d}"
    return f"""with {_C}, edge as (select c, {m}(struct_pack(s := s, e := e)) as x from c group by 1),
turn as (select c, coalesce(lead(c) over w, first_value(c) over w) as tc from edge window w as (order by {order} rows between unbounded preceding and unbounded following)),
n as (select a.c, a.s, a.e, {m}(struct_pack(s := b.s, e := b.e)) as x from c a join c b on a.c = b.c and b.s {g} a.s and b.e {g} a.e group by 1, 2, 3)
select c.c as container_name, c.s as chrom_start, c.e as chrom_end, case when n.x is null then turn.tc else c.c end as to_container, coalesce(n.x.s, edge.x.s) as to_start, coalesce(n.x.e, edge.x.e) as to_stop
from c left join n on c.c = n.c and c.s = n.s and c.e = n.e join turn on turn.c = c.c join edge on edge.c = turn.tc"""


def _neighbours(spark, sf, previous):
    f = table(spark, sf, "features").select(container_key("container_name").alias("container_name"), "chrom_start", "chrom_end")
    return intervals.neighbours(f, "container_name", "chrom_start", "chrom_end", previous=previous)


@query(_neighbour_sql(False))
def next_feature(spark, sf):
    return _neighbours(spark, sf, False)


@query(_neighbour_sql(True))
def prev_feature(spark, sf):
    return _neighbours(spark, sf, True)


_DEPTH = f"""{_F}, ev as (select container, a as pos, 1 as d from f union all select container, b + 1, -1 from f), s as (select container, pos, sum(d) as d from ev group by 1, 2),
dp as (select container, pos as span_start, lead(pos) over w as span_end, (sum(d) over w)::bigint as depth from s window w as (partition by container order by pos)), dd as (select * from dp where depth > 0)"""


def _depths(spark, sf):
    return intervals.coverage_depth(_spans(spark, sf), ["container"], F.col("start"), F.col("stop"))


@query(f"with {_DEPTH} select * from dd")
def coverage_depth(spark, sf):
    return _depths(spark, sf)


@query(f"""with {_DEPTH}, i as (select *, span_end - span_start as n, greatest(0, least(span_end, 1000001) - greatest(span_start, 200000)) as k from dd)
select container, sum(k)::bigint as unique_in, sum(k * (depth - 1))::bigint as redundant_in, sum(n - k)::bigint as unique_out, sum((n - k) * (depth - 1))::bigint as redundant_out, sum(n * depth)::bigint as total_bases, sum(k) / 800001 as covered_ratio from i group by 1""")
def coverage_roi(spark, sf):
    return intervals.roi_coverage(_depths(spark, sf), ["container"], 200_000, 1_000_000)


@query(f"with {_DEPTH} select container, max(depth) as max_depth, min(span_start) as first_covered, max(span_end) as end_covered from dd group by 1")
def coverage_max(spark, sf):
    return intervals.max_depth(_depths(spark, sf), ["container"])


def _sizes(spark, sf):
    f = table(spark, sf, "features").groupBy(F.col("panel_id").alias("genome"), container_key("container_name").alias("container"))
    return f.agg(F.count_distinct("strand").alias("size"))


_SIZES = f"z as (select panel_id as genome, {key('container_name', 'lower')} as container, count(distinct strand) as size from features group by 1, 2), q as (select container, size from z where genome = (select min(genome) from z))"


def _least_genome(spark, sf):
    z = _sizes(spark, sf)
    return z.join(z.agg(F.min("genome").alias("genome")), "genome").select("container", "size")


@query(f"with {_SIZES} select genome from z join q using (container, size) group by 1 having count(*) = (select count(*) from q)")
def genome_identify(spark, sf):
    """Panels that hold all (container, number of strands) of the first panel."""
    return joins.identify_genomes(_least_genome(spark, sf), _sizes(spark, sf))


@query(f"""with {_SIZES}, o as (select container, max(size) as size from z group by 1) select coalesce(q.container, o.container) as container, q.size, o.size as genome_size,
case when q.size is null or o.size is null then 'NO_MATCH' when q.size <> o.size then '*' else 'equal' end as status from q full join o on q.container = o.container""")
def genome_mismatch(spark, sf):
    return joins.genome_mismatches(_least_genome(spark, sf), _sizes(spark, sf).groupBy("container").agg(F.max("size").alias("size")))


# --- statistics


_V = f"v as (select {key('probe_id')} as probe_id, score as x, one_mapq as y, two_mapq as z from pairs where {key('probe_id')} is not null)"


def _values(spark, sf):
    return table(spark, sf, "pairs").select(code_key("probe_id").alias("probe_id"), F.col("score").alias("x"), F.col("one_mapq").alias("y"), F.col("two_mapq").alias("z")).where("probe_id is not null")


def _rounded(df, names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


@query(f"""with {_V} select probe_id, count(x) as n, sum(x)::bigint as total, sum(x * x)::bigint as squares, min(x) as least, max(x) as greatest, round(avg(x), 6) as mean, round(exp(avg(ln(case when x > 0 then x end))), 6) as geometric_mean,
round(var_samp(x), 4) as var_samp, round(var_pop(x), 4) as var_pop, round(stddev_samp(x), 6) as sd_samp, round(stddev_pop(x), 6) as rms_deviation from v group by 1""")
def running_stats(spark, sf):
    out = _rounded(st.running_stats(_values(spark, sf), ["probe_id"], F.col("x")), {"mean", "geometric_mean", "sd_samp", "rms_deviation"})
    return _rounded(out, {"var_samp", "var_pop"}, 4)


def _q(n: str, k: int, s: int) -> str:
    return f"case when {n} < {s} then null when {n} * {k} % {s} = 0 then (l[({n} * {k} // {s})::int] + l[({n} * {k} // {s} + 1)::int]) / 2 else l[({n} * {k} // {s} + 1)::int]::double end"


@query(f"with {_V}, l as (select probe_id, list_sort(list(x) filter (where x is not null)) as l, count(x) as n from v group by 1) select probe_id, n, {', '.join(f'{_q('n', k, 4)} as q{k}' for k in (1, 2, 3))} from l where n > 0")
def type2_quantiles(spark, sf):
    return st.quantiles(_values(spark, sf), ["probe_id"], F.col("x"), 4)


_MEDIAN = "(l[((n + 1) // 2)::int] + l[((n + 2) // 2)::int]) / 2"


@query(f"""with {_V}, l as (select probe_id, list_sort(list(x) filter (where x is not null)) as l, count(x) as n from v group by 1), m as (select probe_id, n, {', '.join(f'{_q('n', k, 4)} as q{k}' for k in (1, 3))}, l[1] as least, l[n::int] as greatest, {_MEDIAN} as median from l where n > 0)
select *, q3 - q1 as iqr from m""")
def five_numbers(spark, sf):
    return st.five_numbers(_values(spark, sf), ["probe_id"], F.col("x"))


@query(f"""with {_V}, l as (select probe_id, list_sort(list(x::double) filter (where x is not null)) as l, count(x) as n from v group by 1), m as (select probe_id, l, n, {_MEDIAN} as median from l where n > 0),
d as (select probe_id, l as v, median, n, list_sort(list_transform(l, lambda x: abs(x - median))) as l from m), e as (select probe_id, v, median, {_MEDIAN} as mad from d),
w as (select probe_id, median, mad, list_transform(v, lambda x: case when mad > 0 and abs((x - median) / (5.0 * mad)) < 1 then pow(1 - pow((x - median) / (5.0 * mad), 2), 2) else 0.0 end) as w, v from e)
select probe_id, round(median, 6) as median, round(mad, 6) as mad, round(coalesce(list_sum(list_transform(list_zip(v, w), lambda p: p[1] * p[2])) / nullif(list_sum(w), 0), median), 6) as biweight from w""")
def biweight_mean(spark, sf):
    return _rounded(st.biweight_mean(_values(spark, sf), ["probe_id"], F.col("x")), {"median", "mad", "biweight"})


@query(f"""with {_V}, r as (select probe_id, regr_count(x, y) as n, regr_slope(x, y) as slope, regr_intercept(x, y) as intercept, regr_r2(x, y) as r2, regr_syy(x, y) as syy from v group by 1)
select probe_id, n, round(slope, 6) as slope, round(intercept, 4) as intercept, round(r2, 6) as r2, round(case when n > 2 then syy * (1 - r2) / (n - 2) end, 4) as mse, round(case when n > 2 then 1 - (1 - r2) * (n - 1) / (n - 2) end, 6) as adjusted_r2, round(sign(slope) * sqrt(r2), 6) as r from r""")
def linear_regression(spark, sf):
    out = st.linear_regression(_values(spark, sf), ["probe_id"], F.col("x"), F.col("y"))
    return _rounded(_rounded(out, {"slope", "r2", "adjusted_r2", "r"}), {"mse", "intercept"}, 4)


_SUMS = ", ".join(f"sum({a} * {b}) as {n}" for n, a, b in (("sx", "x0", "1"), ("sz", "x1", "1"), ("sy", "y", "1"), ("sxx", "x0", "x0"), ("szz", "x1", "x1"), ("sxz", "x0", "x1"), ("sxy", "x0", "y"), ("szy", "x1", "y"), ("syy", "y", "y")))


@query(f"""with {_V}, w as (select y::double as x0, z::double as x1, x::double as y from v where x is not null and y is not null and z is not null), s as (select count(*) as n, {_SUMS} from w),
c as (select *, sxx - sx * sx / n as cxx, szz - sz * sz / n as czz, sxz - sx * sz / n as cxz, sxy - sx * sy / n as cxy, szy - sz * sy / n as czy, syy - sy * sy / n as cyy from s),
b as (select *, (cxy * czz - czy * cxz) / (cxx * czz - cxz * cxz) as b1, (czy * cxx - cxy * cxz) / (cxx * czz - cxz * cxz) as b2 from c),
r as (select *, (sy - b1 * sx - b2 * sz) / n as b0, cyy - b1 * cxy - b2 * czy as sse from b)
select n, round(b0, 4) as b0, round(b1, 6) as b1, round(b2, 6) as b2, round(1 - sse / cyy, 6) as r2, round(1 - sse / cyy * (n - 1) / (n - 3), 6) as adjusted_r2, round(sse / (n - 3), 3) as mse from r""")
def multi_regression(spark, sf):
    """The regression of score on both mapping qualities: coefficients, r2 and mse."""
    m = st.multiple_regression(_values(spark, sf), F.col("x"), [F.col("y"), F.col("z")])
    row = (m["n"], *[float(round(b, 6 if i else 4)) for i, b in enumerate(m["coefficients"])], float(round(m["r2"], 6)), float(round(m["adjusted_r2"], 6)), float(round(m["mse"], 3)))
    return spark.createDataFrame([row], "n long, b0 double, b1 double, b2 double, r2 double, adjusted_r2 double, mse double")


# --- numbers


_CDF = "(0.3989423 * exp(-z * z / 2) * (((((1.330274429 * t - 1.821255978) * t + 1.781477937) * t - 0.356563782) * t + 0.31938153) * t))"


@query(f"""with o as (select o_orderkey, o_totalprice as x, o_orderkey as a, o_custkey as b, (o_totalprice - 150000) / 30000 as z from orders), u as (select *, 1 / (1 + abs(z) * 0.2316419) as t from o)
select o_orderkey, round(case when x > 0 then log2(x) else 'nan'::double end, 6) as lg, round(case when z > 6 then 1.0 when z < -6 then 0.0 when z < 0 then {_CDF} else 1 - {_CDF} end, 9) as cdf,
((a + b) * (a + b + 1) / 2 + b)::double as cantor, gcd(a, b)::bigint as g, lcm(a, b)::bigint as l, length(floor(abs(x))::bigint::varchar) as digits, hex(a) as h, bin(a) as bits, bit_count(a & b)::int as common, (a | b) as either, xor(a, b) as one from u""")
def number_functions(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"), F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"), ((F.col("o_totalprice") - 150000) / 30000).alias("z"))
    a, b = F.col("a"), F.col("b")
    bits = N.bit_set_algebra(a, b)
    return o.select(
        "o_orderkey", F.round(N.log2_safe("x"), 6).alias("lg"), F.round(N.normal_cdf("z"), 9).alias("cdf"), N.cantor_pair(a, b).alias("cantor"), N.gcd(a, b).alias("g"), N.lcm(a, b).alias("l"),
        N.digits_before_point("x").alias("digits"), N.to_hex("a").alias("h"), N.to_binary_text("a").alias("bits"), bits["n_both"].alias("common"), bits["either"].alias("either"), bits["one"].alias("one"),
    )


@query("""with l as (select l_orderkey, list(l_quantity order by l_linenumber, l_quantity) as q from lineitem group by 1)
select l_orderkey, list_min(q) as least, list_max(q) as greatest, list_sum(q) as total, (coalesce(list_position(q, 5.0), 0) - 1)::int as at_five,
  list_transform(list_sort(list_transform(range(1, len(q) + 1), lambda i: struct_pack(x := q[i], i := i))), lambda s: (s.i - 1)::int) as sorted from l""")
def array_functions(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity")))
    q = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(rows.alias("r")).select("l_orderkey", F.col("r.l_quantity").alias("q"))
    return q.select("l_orderkey", F.array_min("q").alias("least"), F.array_max("q").alias("greatest"), N.array_total("q").alias("total"), N.index_of("q", F.lit(5.0)).alias("at_five"), N.sort_index("q").alias("sorted"))


@query("""with l as (select l_orderkey, list(l_quantity order by l_linenumber, l_quantity) as q from lineitem group by 1)
select l_orderkey, list_concat(q, [0.0::double]) as joined, q[2:] as rest, list_filter(q, lambda x: x not in (5.0, 10.0)) as others,
  flatten(flatten(list_transform(range(1, len(q) + 1), lambda i: list_transform(list_filter(range(1, len(q) + 1), lambda j: j <> i), lambda j: [q[i], q[j]])))) as twos from l""")
def array_helpers(spark, sf):
    """Quantities of each order joined, without some places and values, and all ordered twos, one after the other."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity")))
    q = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(rows.alias("r")).select("l_orderkey", F.col("r.l_quantity").alias("q"))
    return q.select("l_orderkey", N.joined("q", F.array(F.lit(0.0))).alias("joined"), N.without_place("q", 0).alias("rest"), N.without_values("q", F.array(F.lit(5.0), F.lit(10.0))).alias("others"), F.flatten(N.permutations("q", 2)).alias("twos"))


@query("""with h as (select *, lpad(hex(o_orderkey), 8, '0') as h from orders) select o_orderkey, h as big, h[7:8] || h[5:6] || h[3:4] || h[1:2] as little, -o_orderkey as back, format('{:,.2f}', o_totalprice) as price,
 case when o_orderkey = 0 then '0' else '(-' || o_orderkey || ')' end as negative, factorial((o_orderkey % 21)::int)::bigint as fact, regexp_replace(o_orderpriority, '(..)', '\\1-', 'g') as dashed from h""")
def byte_functions(spark, sf):
    """Numbers as bytes and back, with thousands, in parentheses; factorials; a sign after every second character."""
    k = F.col("o_orderkey")
    dashed = X.insert_every("o_orderpriority", 2, "-")
    even = F.when((F.length("o_orderpriority") % 2 == 0) & ~dashed.endswith("-"), F.concat(dashed, F.lit("-"))).otherwise(dashed)
    return table(spark, sf, "orders").select(
        "o_orderkey", F.hex(N.to_bytes(k, 4)).alias("big"), F.hex(N.to_bytes(k, 4, little=True)).alias("little"), N.from_bytes(N.to_bytes(-k, 5, little=True), little=True).alias("back"),
        X.thousands("o_totalprice", 2).alias("price"), X.in_parentheses(-k).alias("negative"), N.factorial((k % 21).cast("int")).alias("fact"), even.alias("dashed"),
    )


@query("""with p as (select p_partkey, p_name as t, substr(p_name, 3, 5) as q from part) select p_partkey, len(list_filter(range(1, length(t) - 3), lambda i: len(list_filter(range(0, 5), lambda j: t[i + j] <> 'xxolo'[j + 1])) <= 2)) > 0 as near, contains(t, q) as own from p""")
def plain_matches(spark, sf):
    """Whether plain strings stand in names with some other characters."""
    return table(spark, sf, "part").select("p_partkey", S.contains_within("p_name", F.lit("xxolo"), 2).alias("near"), S.contains_within("p_name", F.substring("p_name", 3, 5), 0).alias("own"))


# --- text


@query("""select p_partkey, lpad(p_partkey::varchar, 8, '0') as padded, reverse(p_name) as back, repeat('ab', 3) as thrice, case when length(p_name) - length(replace(p_name, ' ', '')) < 1 then -1 else strpos(p_name, ' ') - 1 end as blank,
 try_cast(p_brand as double) is not null as numeric, length(p_type) - length(regexp_replace(p_type, '[AEIOU]', '', 'g')) as vowels, regexp_extract_all(p_type, '(?s)(.{1,4})', 1) as wrapped,
 p_partkey::varchar || case when p_partkey % 100 between 11 and 13 then 'th' when p_partkey % 10 = 1 then 'st' when p_partkey % 10 = 2 then 'nd' when p_partkey % 10 = 3 then 'rd' else 'th' end as nth,
 case when length(p_name) <= 9 then p_name else substr(p_name, 1, 6) || '...' end as short, printf('%02d:%02d:%02d', p_partkey // 3600, p_partkey // 60 % 60, p_partkey % 60) as span, md5(p_name) as md5 from part""")
def text_functions(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        "p_partkey", X.pad_left(k.cast("string"), 8, "0").alias("padded"), F.reverse("p_name").alias("back"), F.repeat(F.lit("ab"), 3).alias("thrice"), X.nth_index("p_name", " ", 1).alias("blank"),
        X.is_numeric("p_brand").alias("numeric"), X.count_matched("p_type", "[AEIOU]").alias("vowels"), X.wrapped("p_type", 4).alias("wrapped"), X.ordinal(k).alias("nth"), X.shortened("p_name", 9).alias("short"),
        X.duration_text(k).alias("span"), N.checksums("p_name")["md5"].alias("md5"),
    )


_NATURAL = """list_aggregate(list_transform(regexp_extract_all(lower({c}), '[0-9]+|[^0-9]+'), lambda p: (case when regexp_matches(p, '^[0-9]')
  then chr(1) || lpad(length(regexp_replace(p, '^0+([0-9])', '\\1'))::varchar, 3, '0') || regexp_replace(p, '^0+([0-9])', '\\1') else p end)), 'string_agg', '')"""


@query(f"""with n as (select distinct feature_name as name from features where feature_name is not null)
select name, row_number() over (order by coalesce({_NATURAL.format(c='name')}, ''), name) as place from n""")
def natural_sort(spark, sf):
    """Distinct feature names with their place in natural order; places run on over range partitions."""
    n = table(spark, sf, "features").select(F.col("feature_name").alias("name")).dropna().distinct()
    return st.places(n.select("name", X.natural_key("name").alias("key_")), ["key_", "name"]).drop("key_")


@query("""with t as (select line_id, regexp_replace(regexp_replace(line_text, '\\r$', ''), '^track\\s*', '') as t from bed_lines where starts_with(line_text, 'track') and (length(line_text) - length(replace(line_text, '"', ''))) % 2 = 0)
select line_id, nullif(regexp_extract(t, 'useScore=([^ \\t]*)', 1), '') as use_score, nullif(regexp_extract(t, '(^|[ \\t])name="([^"]*)"', 2), '') as name, nullif(regexp_extract(t, 'description="([^"]*)"', 1), '') as description from t""")
def annotation_map(spark, sf):
    """Pairs of track lines, quoted values whole."""
    t = table(spark, sf, "bed_lines").where("line_text like 'track%'").where(F.regexp_count("line_text", F.lit('"')) % 2 == 0)
    m = X.annotations(F.regexp_replace(F.regexp_replace("line_text", "\r$", ""), "^track\\s*", ""), quoted=True)
    return t.select("line_id", m.alias("m")).select("line_id", *[F.nullif(F.col("m")[k], F.lit("")).alias(n) for k, n in (("useScore", "use_score"), ("name", "name"), ("description", "description"))])


def _lines(spark, sf):
    return table(spark, sf, "bed_lines").select(F.col("file_name").alias("path"), F.col("line_no").cast("long").alias("line_no"), F.col("line_text").alias("line"))


@query("select file_name as path, line_no::bigint as line_no, line_text as line, strpos(lower(line_text), 'exon 1') - 1 as \"column\" from bed_lines where contains(lower(line_text), 'exon 1')")
def text_search(spark, sf):
    return L.search(_lines(spark, sf), "Exon 1")


@query("with m as (select file_name as path, min(struct_pack(line_no := line_no::bigint, line := line_text)) as m from bed_lines where line_no > 100 and contains(lower(line_text), 'browser') group by 1) select path, m.line_no as line_no, m.line as line, strpos(lower(m.line), 'browser') - 1 as \"column\" from m")
def text_next_match(spark, sf):
    return L.next_match(_lines(spark, sf), "browser", 100)


@query("select file_name as path, line_no::bigint as line_no, line_text as line from bed_lines where line_no between 50 and 80")
def line_window(spark, sf):
    return L.line_window(_lines(spark, sf), 50, 80)


@query("with t as (select file_name as path, line_no::bigint as line_no, unnest(string_split_regex(lower(line_text), '[ \\t\\n\\r\\f\\x0b]+')) as token from bed_lines) select token, path, line_no, count(*) as n from t where token <> '' group by 1, 2, 3")
def token_index(spark, sf):
    return L.token_index(_lines(spark, sf))


@query("""with a as (select file_name as path, line_no, line_text from bed_lines union all select 'copy of ' || file_name, line_no, line_text from bed_lines),
p as (select path, sum(('0x' || substr(md5(concat_ws(' ', line_no::varchar, line_text)), 1, 15))::bigint)::hugeint as t, count(*) as n from a group by 1), d as (select path, md5(t::varchar || '/' || n::varchar) as digest from p)
select digest, min(path) as one, max(path) as two from d group by 1 having count(*) = 2""")
def file_digest_pairing(spark, sf):
    a = table(spark, sf, "bed_lines").select(F.col("file_name").alias("path"), F.col("line_no").alias("read_index"), F.col("line_text").alias("name"))
    return pipeline.paired_files(a.unionByName(a.withColumn("path", F.concat(F.lit("copy of "), F.col("path")))))


_RUNS = """r as (select read_index, p, ch, sum(case when ch = prev then 0 else 1 end) over (partition by read_index order by p) as g from (
  select read_index, p, u[p] as ch, lag(u[p]) over (partition by read_index order by p) as prev from (select read_index, u, unnest(range(1, length(u) + 1)) as p from x))),
s as (select read_index, g, any_value(ch) as ch, count(*) as n from r group by 1, 2)"""


@query(f"""with x as (select read_index, min({key('ext_uid')}) as u from pairs group by 1 having min({key('ext_uid')}) is not null), {_RUNS}
select x.read_index, string_agg(n::varchar || ch, '' order by g) as summary, any_value(x.u) as expanded from x join s using (read_index) group by 1""")
def run_lengths(spark, sf):
    """Run-length encoding of barcodes and back, as of CIGAR strings."""
    u = table(spark, sf, "pairs").groupBy("read_index").agg(F.min(code_key("ext_uid")).alias("u")).where("u is not null").withColumn("summary", C.summarized("u"))
    return u.select("read_index", "summary", C.expanded("summary").alias("expanded"))


@query("""with d as (select distinct l_orderkey, l_linenumber::int as k from lineitem), g as (select *, k - row_number() over (partition by l_orderkey order by k) as grp from d),
r as (select l_orderkey, min(k) as a, max(k) as b from g group by l_orderkey, grp)
select l_orderkey, string_agg(case when a = b then a::varchar else a || '-' || b end, ', ' order by a) as ranges from r group by 1""")
def range_summaries(spark, sf):
    """Line numbers of each order as '1-3, 5'."""
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_linenumber").cast("int")).alias("k"))
    return g.select("l_orderkey", X.range_summary("k").alias("ranges"))


@query("select event_id, json_extract_string(props, '$.k') as k, try_cast(json_extract_string(props, '$.k') as double) is not null as numeric from events")
def json_values(spark, sf):
    """A value picked from a JSON text by its path."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select("event_id", k.alias("k"), X.is_numeric(k).alias("numeric"))


@query("""select doc_id, nullif(regexp_extract(text, '<a href="([^"]*)"', 1), '') as link from documents where contains(text, '<a href=')""")
def xml_values(spark, sf):
    """The first link's target of texts with links, by its path in the element cut out of the text."""
    element = F.concat(F.regexp_extract("text", "(<a href=\"[^\"]*\")", 1), F.lit("/>"))
    ok = F.when(element != "/>", F.regexp_replace(element, "&(?!(amp|lt|gt|quot|apos);)", "&amp;"))
    return table(spark, sf, "documents").where(F.col("text").contains("<a href=")).select("doc_id", F.nullif(F.xpath_string(ok, F.lit("/a/@href")), F.lit("")).alias("link"))
