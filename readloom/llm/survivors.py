"""The best representative of each group of duplicate records: skyline selection and filling by dominance layers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quality_sums(text: pa.Array) -> pa.Array:
    """Sum over each string's characters of their code less 33; null for null, 0 for an empty one."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    n = len(text)
    if not n:
        return pa.array([], pa.int64())
    text = pc.fill_null(text, "").cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], "int64")[text.offset : text.offset + n + 1]
    data = np.frombuffer(text.buffers()[2], "uint8") if text.buffers()[2] is not None else np.zeros(0, "uint8")
    used = data[offsets[0] : offsets[-1]]
    if (used >= 128).any():
        return pa.array([sum(map(ord, s)) - 33 * len(s) for s in text.to_pylist()], pa.int64())
    upto = np.concatenate(([0], np.cumsum(used, dtype="int64")))
    at = offsets - offsets[0]
    return pa.array(upto[at[1:]] - upto[at[:-1]] - 33 * np.diff(at))


@F.arrow_udf(T.LongType())
def _quality(text: pa.Array) -> pa.Array:
    sums = quality_sums(text)
    return pc.if_else(pc.is_null(text), pa.scalar(None, pa.int64()), sums) if text.null_count else sums


def total_quality(c: Column) -> Column:
    """`quality_sums` as a Column function, on whole Arrow batches."""
    return _quality(c)


def latest_values(df: DataFrame, ident: Column, loaded: Column, fields: dict[str, Column]) -> DataFrame:
    """One record per id, each field with its most recently loaded value that isn't null: (id, *fields, latest).

    The rows of one record are ordered by recency alone, so each is a dominance layer of its own, and filling
    nulls from successive layers is the greatest (loaded, value) among the values that are there: an aggregate
    that combines within each task, so an id with very many rows is no burden. Rows loaded at the same time
    give the greatest value; rows without a time count as the oldest. Rows without an id are no records. A
    field without any value is null.
    """
    flat = df.select(ident.alias("id"), loaded.alias("latest"), *[c.alias(k) for k, c in fields.items()]).where("id is not null")
    newest = [F.max(F.when(F.col(k).isNotNull(), F.struct("latest", k))).alias(f"s_{k}") for k in fields]
    one = flat.groupBy("id").agg(F.max("latest").alias("latest"), *newest)
    return one.select("id", *[F.col(f"s_{k}.{k}").alias(k) for k in fields], "latest")


def _layered(df: DataFrame, by: list[str], levels: int, depth: int) -> DataFrame:
    """layer_: the dominance layer of each record within `by`, up to `depth`; null beyond.

    In order of falling trust a record is dominated by an earlier one that is at least as complete and as recent.
    The latest time among the earlier ones is kept for each number of completeness, so one sorted pass suffices.
    """
    w = W.partitionBy(*by).orderBy(F.col("trust_").desc())
    before = w.rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("layer_", F.lit(None).cast("int"))
    for d in range(1, depth + 1):
        open_ = F.col("layer_").isNull()
        best = F.array(*[F.max(F.when(open_ & (F.col("complete_") >= c), F.col("recent_"))).over(before) for c in range(levels + 1)])
        dominated = F.coalesce(F.get(best, F.col("complete_")) >= F.col("recent_"), F.lit(False))
        df = df.withColumn("layer_", F.when(~open_, F.col("layer_")).when(~dominated, F.lit(d)))
    return df


def skyline_survivors(
    df: DataFrame, keys: list[str], *, recent: str, trust: list[Column], fields: list[str], fill: list[str] = (), depth: int = 3, salts: int | None = None, least: int = 1, unique: bool = False
) -> DataFrame:
    """One surviving record per group: (*keys, n_records, n_skyline, all other columns of the survivor).

    Criteria: completeness (how many of `fields` are not null), recency (`recent`, later is better, null the
    oldest) and trust (`trust`, compared in order, greater is better; it should be unique within a group, else
    ties go on to the greatest of all other columns). A record is dominated if another one is at least as good
    in all three. The survivor is the most trusted record of the skyline, the records that nothing dominates.

    `fill`: columns of the survivor that are null take the value of the first dominance layer that has one,
    within a layer from the most trusted record; layers beyond `depth` count as one.

    A skyline of the whole is the skyline of the parts' skylines, and the first `depth` layers lie within the
    first `depth` layers of the parts. So groups are first reduced in `salts` parts each (by default as many as there are
    shuffle partitions, so a hot group is spread over all tasks), and one task gets only what is undominated of it. Records beyond `depth` stay only where they hold a part's most trusted
    value of a column to fill.

    Groups with a null key are no groups. Repeated rows count as records; of equal ones one survives. They are
    collapsed first, within each task and then by row, unless `unique` says that there are none. Groups of fewer
    than `least` records are left out. An empty table gives an empty result. Any column names will do; where `df`
    has a column n_records or n_skyline itself, the operator's own gets an underscore. Map columns have no order
    and are an error.
    """
    salts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if depth < 1 or salts < 1:
        raise ValueError("depth and salts must be at least 1")
    depth = depth if fill else 1
    rest = [c for c in df.columns if c not in keys]
    complete = sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0))
    when = F.coalesce(F.unix_micros(F.col(recent).cast("timestamp")), F.lit(-(2**63)))
    # All columns travel once, as the last parts of trust_.
    parts = [c.alias(f"t{i}") for i, c in enumerate(trust)] + [F.col(c).alias(f"c{i}") for i, c in enumerate(rest)]
    k = [f"k{i}" for i in range(len(keys))]
    base = df.dropna(subset=keys).select(
        *[F.col(x).alias(y) for x, y in zip(keys, k, strict=True)], complete.alias("complete_"), when.alias("recent_"), F.struct(*parts).alias("trust_"),
        F.pmod(F.xxhash64(*rest), F.lit(salts)).cast("int").alias("salt_"),
    )
    columns = [*k, "salt_", "complete_", "recent_", "trust_"]
    base = base.withColumn("m_", F.lit(1)) if unique else base.groupBy(*columns).agg(F.count(F.lit(1)).alias("m_"))
    held = {c: F.col(f"trust_.c{rest.index(c)}") for c in fill}
    part = [*k, "salt_"]
    local = _layered(base, part, len(fields), depth)
    w = W.partitionBy(*part).orderBy(F.col("trust_").desc())
    local = local.withColumn("n_here_", F.when(F.row_number().over(w) == 1, F.sum("m_").over(W.partitionBy(*part))).otherwise(0))
    keep = F.col("layer_").isNotNull()
    for c in fill:
        late = F.col("layer_").isNull() & held[c].isNotNull()
        keep = keep | (late & (F.count_if(late).over(w.rowsBetween(W.unboundedPreceding, 0)) == 1))
    kept = local.withColumn("kept_", keep).where("kept_").drop("salt_", "kept_", "layer_", "m_")
    whole = _layered(kept, k, len(fields), depth)
    ranked = whole.withColumn("n_", F.sum("n_here_").over(W.partitionBy(*k))).where(F.col("n_") >= least)
    first = F.max(F.when(F.col("layer_") == 1, F.struct("trust_")))
    order = F.struct(-F.coalesce("layer_", F.lit(depth + 1)), F.col("trust_"))
    filled = [F.max_by(held[c], F.when(held[c].isNotNull(), order)).alias(f"f{i}") for i, c in enumerate(fill)]
    out = ranked.groupBy(*k).agg(F.max("n_").alias("n_"), F.count_if(F.col("layer_") == 1).alias("s_"), first.alias("s"), *filled)

    def free(name: str) -> str:
        return free(name + "_") if name in df.columns else name

    cols = [F.coalesce(F.col(f"s.trust_.c{i}"), F.col(f"f{list(fill).index(c)}")).alias(c) if c in fill else F.col(f"s.trust_.c{i}").alias(c) for i, c in enumerate(rest)]
    return out.select(*[F.col(y).alias(x) for x, y in zip(keys, k, strict=True)], F.col("n_").alias(free("n_records")), F.col("s_").alias(free("n_skyline")), *cols)
