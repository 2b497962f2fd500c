"""Queries of the llm operators over the project and text tables, with their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.keys import code_key, container_key
from readloom.llm import heavy, leakage, packing, reading, survivors
from readloom.llm.percentiles import merge_runs, percentiles, percentiles_of_runs, value_runs

#: Share of all rows from which a barcode is frequent.
FREQUENT = 0.005


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _barcodes() -> dict:
    return {"ext_uid": code_key("ext_uid"), "lig_uid": code_key("lig_uid")}


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Barcodes in at least 0.5 % of all rows of pairs."""
    out = heavy.frequent_values(_table(spark, sf, "pairs"), _barcodes(), FREQUENT)
    return out.select(F.col("field").alias("uid_field"), F.col("value").alias("uid"))


def p1_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Barcodes that may reach 0.5 % of all rows, with lower and upper bound of their counts."""
    out = heavy.heavy_values(_table(spark, sf, "pairs"), _barcodes(), FREQUENT)
    return out.select(F.col("field").alias("uid_field"), F.col("value").alias("uid"), "lower", "upper")


def _mates(pairs: DataFrame) -> DataFrame:
    mates = F.array(*[F.struct(F.lit(m).alias("mate"), F.col(c).alias("mapq")) for m, c in ((1, "one_mapq"), (2, "two_mapq"))])
    return pairs.select(code_key("probe_id").alias("probe_id"), F.explode(mates).alias("m"), "loaded_at").select("probe_id", "m.mate", "m.mapq", "loaded_at").where("mapq between 0 and 60 and probe_id is not null")




def _by_mate() -> dict:
    return {k: F.col(k) for k in ("probe_id", "mate")}


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Probe, mate and percentile (10, 50, 90) whose mapping quality is below 30, of at least 100 valid values."""
    out = percentiles(_mates(_table(spark, sf, "pairs")), _by_mate(), F.col("mapq"), [10, 50, 90], least=100)
    return out.where("percentile < 30").select("probe_id", "mate", F.col("pct").cast("int").alias("pct"))


def p3_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Quartiles and deciles of mapping quality by probe and mate, interpolated between order statistics."""
    out = percentiles(_mates(_table(spark, sf, "pairs")), _by_mate(), F.col("mapq"), [10, 25, 50, 75, 90], method="linear")
    return out.select("probe_id", "mate", F.col("pct").cast("int").alias("pct"), "n_values", F.round("percentile", 6).alias("percentile"))


def p3_by_day(spark: SparkSession, sf: str) -> DataFrame:
    """Medians by probe and mate, combined from the runs of each day."""
    days = value_runs(_mates(_table(spark, sf, "pairs")), {**_by_mate(), "day": F.to_date("loaded_at")}, F.col("mapq"))
    runs = merge_runs(days.drop("day"))
    return percentiles_of_runs(runs, ["probe_id", "mate"], [50]).select("probe_id", "mate", "n_values", F.col("percentile").alias("median"))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """One row per read_index of pairs: each field's latest value, qualities as sums."""
    fields = {
        "probe_id": code_key("probe_id"), "ext_uid": code_key("ext_uid"), "lig_uid": code_key("lig_uid"),
        "q1": survivors.total_quality(F.col("r1_qual")), "q2": survivors.total_quality(F.col("r2_qual")),
        "one_mapq": F.col("one_mapq"), "two_mapq": F.col("two_mapq"), "container_name": container_key("container_name"),
    }
    return survivors.latest_values(_table(spark, sf, "pairs"), F.col("read_index"), F.col("loaded_at"), fields)


def _best_pairs(spark: SparkSession, sf: str, fill: list[str], least: int, only: list[str]) -> DataFrame:
    total = F.coalesce("q1", F.lit(0)) + F.coalesce("q2", F.lit(0))
    records = _records(spark, sf).withColumn("total_quality", total).withColumnRenamed("id", "read_index").select("probe_id", "ext_uid", "lig_uid", "read_index", "latest", "total_quality", *only)
    return survivors.skyline_survivors(
        records, ["probe_id", "ext_uid", "lig_uid"], recent="latest", trust=[F.col("total_quality"), -F.col("read_index")], fields=only, fill=fill, least=least, unique=True
    )


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """The best pair of each group of two or more pairs that share probe and both barcodes."""
    return _best_pairs(spark, sf, [], 2, ["q1", "q2", "one_mapq", "two_mapq"]).select("probe_id", "ext_uid", "lig_uid", "read_index")


def p6_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """One record per group, nulls filled from the dominance layers of its duplicates."""
    out = _best_pairs(spark, sf, ["one_mapq", "two_mapq", "container_name"], 1, ["q1", "q2", "one_mapq", "two_mapq", "container_name"])
    return out.drop("q1", "q2")


def p7_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's place in containers of each capacity of pack_sizes."""
    out = packing.pack_texts(_table(spark, sf, "documents"), F.col("doc_id"), F.col("text"), _table(spark, sf, "pack_sizes"))
    return out.withColumnRenamed("id", "doc_id")


def _leaks(spark: SparkSession, sf: str, find) -> DataFrame:
    items = _table(spark, sf, "eval_items")
    return find(_table(spark, sf, "documents"), F.col("doc_id"), F.col("text"), items, F.col("item_id"), [F.col("item_text"), F.col("answer_key")]).withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold 12 consecutive words of an evaluation item, with the item."""
    return _leaks(spark, sf, leakage.leaks)


def p8_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Where in a document the passages of an item stand."""
    return _leaks(spark, sf, leakage.leaked_spans)


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    return reading.reading_levels(_table(spark, sf, "documents"), F.col("doc_id"), F.col("text"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with demanding prose: those that the models put on level 5, confirmed by the exact measures."""
    return _levels(spark, sf).where((F.col("level") == reading.LEVELS) & reading.is_demanding()).select(F.col("id").alias("doc_id"))


def p9_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by language, post type and level, with their words."""
    docs = _table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "post_type")
    per = _levels(spark, sf).join(docs, "id").groupBy("lang", "post_type", "level")
    return per.agg(F.count(F.lit(1)).alias("documents"), F.sum("n_words").alias("words"))


def p9_levels(spark: SparkSession, sf: str) -> DataFrame:
    """The reading level of every document."""
    return _levels(spark, sf).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_bounds, p3_found, p3_percentiles, p3_by_day, p6_found, p6_survivors, p7_packed, p8_found, p8_spans, p9_found, p9_profile, p9_levels)}

_BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)"


def _key(c: str, case: str = "upper") -> str:
    return f"nullif({case}(trim({c}, {_BLANK})), '')"


_MAPQ = f"""
with m as (
  select {_key("probe_id")} as probe_id, 1 as mate, one_mapq as v from pairs union all select {_key("probe_id")}, 2, two_mapq from pairs
), n as (
  select *, row_number() over (partition by probe_id, mate order by v) as r, count(*) over (partition by probe_id, mate) as c
  from m where v between 0 and 60 and probe_id is not null
)"""
_LATEST = "list({c} order by loaded_at desc, {c} desc) filter (where {c} is not null)[1] as {c}"
_PAIRS = f"""
with k as (
  select read_index, loaded_at, {_key("probe_id")} as probe_id, {_key("ext_uid")} as ext_uid, {_key("lig_uid")} as lig_uid,
    list_sum(list_transform(range(1, length(r1_qual) + 1), lambda i: unicode(r1_qual[i]) - 33)) as q1,
    list_sum(list_transform(range(1, length(r2_qual) + 1), lambda i: unicode(r2_qual[i]) - 33)) as q2
  from pairs where read_index is not null
), p as (
  select read_index, {", ".join(_LATEST.format(c=c) for c in ("probe_id", "ext_uid", "lig_uid", "q1", "q2"))} from k group by read_index
)"""

_FILLED = ("one_mapq", "two_mapq", "container_name")
_RECORDS = f"""
with k as (
  select read_index, loaded_at, {_key("probe_id")} as probe_id, {_key("ext_uid")} as ext_uid, {_key("lig_uid")} as lig_uid, one_mapq, two_mapq, {_key("container_name", "lower")} as container_name,
    list_sum(list_transform(range(1, length(r1_qual) + 1), lambda i: unicode(r1_qual[i]) - 33)) as q1,
    list_sum(list_transform(range(1, length(r2_qual) + 1), lambda i: unicode(r2_qual[i]) - 33)) as q2
  from pairs where read_index is not null
), p as (
  select read_index, max(loaded_at) as latest, {", ".join(_LATEST.format(c=c) for c in ("probe_id", "ext_uid", "lig_uid", "q1", "q2", *_FILLED))} from k group by read_index
), r as (
  select probe_id || '/' || ext_uid || '/' || lig_uid as g, *, (coalesce(q1, 0) + coalesce(q2, 0))::bigint as total_quality, coalesce(latest, '0001-01-01'::timestamp) as recent,
    (q1 is not null)::int + (q2 is not null)::int + (one_mapq is not null)::int + (two_mapq is not null)::int + (container_name is not null)::int as complete from p where probe_id is not null and ext_uid is not null and lig_uid is not null
)"""


def _layer(name: str, of: str) -> str:
    """The records of a relation that none of it dominates; read_index breaks ties of quality, so no two are equal."""
    better = "b.total_quality > a.total_quality or (b.total_quality = a.total_quality and b.read_index < a.read_index)"
    return f"{name} as (select * from {of} a where not exists (select 1 from {of} b where b.g = a.g and b.complete >= a.complete and b.recent >= a.recent and ({better})))"


def _rest(name: str, of: str, layer: str) -> str:
    return f"{name} as (select * from {of} where read_index not in (select read_index from {layer}))"


ORACLE = {
    "p6_survivors": _RECORDS + ", " + ", ".join((_layer("l1", "r"), _rest("r2", "r", "l1"), _layer("l2", "r2"), _rest("r3", "r2", "l2"), _layer("l3", "r3"), _rest("r4", "r3", "l3")))
    + """, u as (select *, 1 as layer from l1 union all select *, 2 from l2 union all select *, 3 from l3 union all select *, 4 from r4)
      select any_value(probe_id) as probe_id, any_value(ext_uid) as ext_uid, any_value(lig_uid) as lig_uid, count(*) as n_records, count(*) filter (where layer = 1) as n_skyline, """
    + ", ".join(f"list({c} order by layer, total_quality desc, read_index)[1] as {c}" for c in ("read_index", "latest", "total_quality"))
    + ", " + ", ".join(f"list({c} order by layer, total_quality desc, read_index) filter (where {c} is not null)[1] as {c}" for c in _FILLED) + " from u group by g",
    "p1_found": " union all ".join(
        f"select '{f}' as uid_field, {_key(f)} as uid from pairs where {_key(f)} is not null group by 1, 2 having count(*) >= {FREQUENT} * (select count(*) from pairs)" for f in ("ext_uid", "lig_uid")
    ),
    "p3_found": _MAPQ + """ select probe_id, mate, pct from n, (select unnest([10, 50, 90])::integer as pct) where c >= 100 and r = ceil(c * pct / 100::decimal(5, 0)) and v < 30""",
    "p3_percentiles": _MAPQ + """, q as (select *, (c - 1) * pct / 100.0 as h from n, (select unnest([10, 25, 50, 75, 90])::integer as pct))
      select probe_id, mate, pct, max(c) as n_values, round(sum(v * case when r = floor(h) + 1 then 1 - (h - floor(h)) else h - floor(h) end), 6) as percentile
      from q where r = floor(h) + 1 or r = floor(h) + 2 group by 1, 2, 3""",
    "p3_by_day": _MAPQ + " select probe_id, mate, c as n_values, v as median from n where r = ceil(c / 2)",
    "p6_found": _PAIRS + """ select probe_id, ext_uid, lig_uid, read_index from (
        select *, row_number() over (partition by probe_id, ext_uid, lig_uid order by coalesce(q1, 0) + coalesce(q2, 0) desc, read_index) as r, count(*) over (partition by probe_id, ext_uid, lig_uid) as n
        from p where probe_id is not null and ext_uid is not null and lig_uid is not null) where r = 1 and n >= 2""",
}
