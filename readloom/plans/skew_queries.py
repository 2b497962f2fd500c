"""Queries of hot keys, covered spans and bad lines over the project tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.keys import code_key, container_key, read_stem
from readloom.operators.badlines import COLUMNS, bad_lines, valid_entries
from readloom.operators.hotkeys import hot_keys, tree_aggregate
from readloom.operators.spans import merge_spans


def _keys() -> dict:
    return {"probe_id": code_key("probe_id"), "read_name": read_stem("read_name")}


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Values of probe_id or read_name in at least 1 % of all rows of read2probe."""
    df = spark.read.parquet(f"{sf}/read2probe.parquet")
    return hot_keys(df, _keys(), 0.01).select("key_field", "key_value")


def p2_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, first and last assignment of every probe and every read name."""
    df = spark.read.parquet(f"{sf}/read2probe.parquet")
    return tree_aggregate(df, _keys(), F.col("assigned_at"))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/features.parquet")
    keys = {"panel_id": F.col("panel_id"), "container_name": container_key("container_name")}
    return merge_spans(df, keys, F.col("chrom_start"), F.col("chrom_end"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Covered periods and gaps of each panel and container of features."""
    return _features(spark, sf)


def p4_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Per panel and container: number of periods and gaps, bases covered and uncovered between them."""
    by = F.col("span_kind") == "period"
    size = F.col("span_end") - F.col("span_start")
    return _features(spark, sf).groupBy("panel_id", "container_name").agg(
        F.count_if(by).alias("periods"), F.count_if(~by).alias("gaps"),
        F.sum(F.when(by, size).otherwise(0)).alias("covered"), F.sum(F.when(by, 0).otherwise(size)).alias("uncovered"),
    )


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Bad lines of bed_lines with their reason."""
    return bad_lines(spark.read.parquet(f"{sf}/bed_lines.parquet"), "line_text", ["line_id"])


def p5_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Valid entries of bed_lines with typed columns."""
    return valid_entries(spark.read.parquet(f"{sf}/bed_lines.parquet"), "line_text", ["line_id"])


QUERIES = {f.__name__: f for f in (p2_found, p2_per_key, p4_found, p4_coverage, p5_found, p5_valid)}

_BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)"
_KEYED = f"""
with k as (
  select 'probe_id' as key_field, nullif(upper(trim(probe_id, {_BLANK})), '') as key_value, assigned_at from read2probe
  union all
  select 'read_name', nullif(regexp_extract(read_name, '^[^ /]*'), ''), assigned_at from read2probe
)"""
_SPANS = f"""
with f as (
  select panel_id, nullif(lower(trim(container_name, {_BLANK})), '') as container_name,
         least(chrom_start, chrom_end) as a, greatest(chrom_start, chrom_end) as b
  from features where chrom_start is not null and chrom_end is not null and chrom_start <> chrom_end
), g as (
  select *, max(b) over (partition by panel_id, container_name order by a, b rows between unbounded preceding and 1 preceding) as pb from f
), h as (
  select *, sum(case when pb is null or a > pb then 1 else 0 end) over (partition by panel_id, container_name order by a, b rows unbounded preceding) as run from g
), p as (
  select panel_id, container_name, run, min(a) as a, max(b) as b from h group by panel_id, container_name, run
), spans as (
  select 'period' as span_kind, panel_id, container_name, a as span_start, b as span_end from p
  union all
  select 'gap', panel_id, container_name, b, n from (select *, lead(a) over (partition by panel_id, container_name order by a) as n from p) where n is not null
)"""
# Quotes hide separators: within them a tab becomes chr(1), a space chr(2), before the line is split.
_QUOTED = """case when position('"' in t) = 0 then t else list_aggregate(list_transform(string_split(t, '"'),
  lambda x, i: case when i % 2 = 0 then replace(replace(x, chr(9), chr(1)), ' ', chr(2)) else x end), 'string_agg', '"') end"""
_LINES = f"""
with l as (
  select line_id, regexp_replace(coalesce(line_text, ''), '\\r$', '') as t from bed_lines
), s as (
  select line_id, t, string_split(regexp_replace({_QUOTED}, ' +', chr(9), 'g'), chr(9)) as c, (length(t) - length(replace(t, '"', ''))) % 2 as odd from l
), r as (
  select *, case
    when starts_with(t, '#') or starts_with(t, 'browser') then null
    when odd = 1 then 'quoting'
    when starts_with(t, 'track') then null
    when t = '' or len(c) < 3 or len(c) > 12 then 'columns'
    {"".join(
      f"when len(c) >= {i + 1} " + ("and c[5] not in ('', '.') " if i == 4 else "") +
      f"and not coalesce(regexp_full_match(c[{i + 1}], '[+-]?[0-9]+') and try_cast(ltrim(c[{i + 1}], '+') as hugeint) between -2147483648 and 2147483647, false) then '{COLUMNS[i]}' "
      for i in (1, 2, 4, 6, 7))}
  end as reason from s
)"""


def _cell(i: int, name: str) -> str:
    if name in ("chrom_start", "chrom_end", "score", "thick_start", "thick_end"):
        return f"try_cast(ltrim(c[{i + 1}], '+') as integer) as {name}"
    return f"replace(replace(c[{i + 1}], chr(1), chr(9)), chr(2), ' ') as {name}"


ORACLE = {
    "p2_found": _KEYED + " select key_field, key_value from k where key_value is not null group by 1, 2 having count(*) >= 0.01 * (select count(*) from read2probe)",
    "p2_per_key": _KEYED + " select key_field, key_value, count(*) as n_rows, count(assigned_at) as n_valued, min(assigned_at) as first_value, max(assigned_at) as last_value from k where key_value is not null group by 1, 2",
    "p4_found": _SPANS + " select * from spans",
    "p4_coverage": _SPANS + """ select panel_id, container_name, count(*) filter (where span_kind = 'period') as periods, count(*) filter (where span_kind = 'gap') as gaps,
      cast(sum(case when span_kind = 'period' then span_end - span_start else 0 end) as bigint) as covered,
      cast(sum(case when span_kind = 'gap' then span_end - span_start else 0 end) as bigint) as uncovered from spans group by 1, 2""",
    "p5_found": _LINES + " select line_id, reason from r where reason is not null",
    "p5_valid": _LINES + " select line_id, " + ", ".join(_cell(i, n) for i, n in enumerate(COLUMNS))
    + " from r where reason is null and not (starts_with(t, '#') or starts_with(t, 'browser') or starts_with(t, 'track'))",
}
