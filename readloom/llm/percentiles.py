"""Exact percentiles per group of very large numeric columns: a distributed sort with per-partition counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.session import materialize

#: Column names that the operator's own results use.
_OWN = {"value", "n", "part", "run_end", "pct", "n_values", "percentile"}


def value_runs(df: DataFrame, keys: dict[str, Column], value: Column) -> DataFrame:
    """Each group's distinct values with their counts: (*keys, value, n).

    This is the form to keep for a file or a day: runs of separate parts combine without loss by `merge_runs`,
    and percentiles come from any union of them. Equal values collapse within each task before the shuffle.
    Null and NaN values are no values; a null key value is a group of its own.
    """
    if _OWN & set(keys):
        raise ValueError(f"key names taken by the result: {sorted(_OWN & set(keys))}")
    rows = df.select(*[c.alias(k) for k, c in keys.items()], value.alias("value")).where("value is not null")
    if isinstance(rows.schema["value"].dataType, T.FloatType | T.DoubleType):
        rows = rows.where(~F.isnan("value"))
    return rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))


def merge_runs(*runs: DataFrame) -> DataFrame:
    """Runs of separately processed parts as one."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.groupBy(*[c for c in runs[0].columns if c != "n"]).agg(F.sum("n").alias("n"))


def _local_offsets(n_keys: int):
    """mapInArrow over a sorted partition: its number and the running count within each group, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, base = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column(n_keys + 1).to_numpy()
            change = np.zeros(b.num_rows, bool)
            for i in range(n_keys):
                k = b.column(i)
                same = pc.equal(k[1:], k[:-1])
                null = pc.and_(pc.is_null(k[1:]), pc.is_null(k[:-1]))
                change[1:] |= ~pc.or_(pc.fill_null(same, False), null).to_numpy(zero_copy_only=False)
            first = [b.column(i)[0].as_py() for i in range(n_keys)]
            run_sum = np.cumsum(n)
            starts = np.flatnonzero(change)
            before = np.zeros(b.num_rows, "int64")
            if len(starts):
                before[starts] = run_sum[starts - 1]
                before = np.maximum.accumulate(before)
            carry = base if first == last else 0
            head = starts[0] if len(starts) else b.num_rows
            end = run_sum - before
            end[:head] += carry
            last, base = [b.column(i)[b.num_rows - 1].as_py() for i in range(n_keys)], int(end[-1])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(b.num_rows, part, "int32")), pa.array(end.astype("int64"))], names=[*b.schema.names, "part", "run_end"]
            )

    return run


def percentiles_of_runs(runs: DataFrame, keys: list[str], pcts: list[float], *, method: str = "nearest", least: int = 1) -> DataFrame:
    """Percentiles of each group of `value_runs`: (*keys, pct, n_values, percentile).

    method 'nearest': the smallest value with at least pct % of the values at or below it. 'linear': between the
    two order statistics around (n - 1) * pct / 100, as a double. Both are exact. Groups of fewer than `least`
    values are left out.

    All runs are sorted over all partitions by group and value, so a hot group is spread too. Each sorted
    partition notes its number and the running count within each group; the counts by group and partition give
    each partition's offset in its group, and so the partition and the local position of every order statistic
    asked for, which are then picked out. The sorted runs are written once, to the shared folder.
    """
    if method not in ("nearest", "linear"):
        raise ValueError("method must be 'nearest' or 'linear'")
    if not pcts or not all(0 <= p <= 100 for p in pcts):
        raise ValueError("percentages must be between 0 and 100")
    cols = [*keys, "value", "n"]
    ordered = runs.select(*cols).repartitionByRange(*keys, "value").sortWithinPartitions(*keys, "value")
    schema = T.StructType([*ordered.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("run_end", T.LongType())])
    placed = materialize(ordered.mapInArrow(_local_offsets(len(keys)), schema), "sorted-runs")
    counts = placed.groupBy(*keys, "part").agg(F.sum("n").alias("here"))
    group = W.partitionBy(*keys)
    offsets = counts.withColumn("upto", F.sum("here").over(group.orderBy("part"))).withColumn("n_values", F.sum("here").over(group))
    offsets = offsets.where(F.col("n_values") >= least).withColumn("before", F.col("upto") - F.col("here"))
    nv, share = F.col("n_values"), F.col("pct") / 100
    if method == "nearest":
        # pct * n / 100 in decimals of the input: ceil of a product of doubles may be one too high.
        positions = F.array(F.struct(F.greatest(F.lit(1).cast("long"), F.ceil(nv.cast("decimal(19,0)") * F.col("pct").cast("decimal(9,6)") / 100)).cast("long").alias("pos"), F.lit(1.0).alias("weight")))
    else:
        at = (nv - 1) * share
        low, frac = F.floor(at), at - F.floor(at)
        positions = F.array(
            F.struct((low + 1).alias("pos"), (1 - frac).alias("weight")),
            F.struct(F.least(low + 2, nv).alias("pos"), frac.alias("weight")),
        )
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in pcts]))
    targets = (
        offsets.withColumn("pct", wanted)
        .withColumn("p", F.explode(positions))
        .where((F.col("p.pos") > F.col("before")) & (F.col("p.pos") <= F.col("upto")))
        .select(*[F.col(k).alias(f"t_{k}") for k in keys], F.col("part").alias("t_part"), "pct", "n_values", (F.col("p.pos") - F.col("before")).alias("local"), "p.weight")
    )
    match = [F.col(k).eqNullSafe(F.col(f"t_{k}")) for k in keys] + [F.col("part") == F.col("t_part")]
    hit = placed.join(targets, match).where((F.col("local") <= F.col("run_end")) & (F.col("local") > F.col("run_end") - F.col("n")))
    pick = F.max("value") if method == "nearest" else F.sum(F.col("value") * F.col("weight"))
    return hit.groupBy(*keys, "pct").agg(F.max("n_values").alias("n_values"), pick.alias("percentile"))


def percentiles(df: DataFrame, keys: dict[str, Column], value: Column, pcts: list[float], *, method: str = "nearest", least: int = 1) -> DataFrame:
    """Exact percentiles per group straight from rows: `percentiles_of_runs` of `value_runs`.

    Nulls and NaN are no values; a group without values gives no row, an empty table none at all. Ties and
    repeated rows count as often as they stand. Other columns of `df` aren't read, whatever their names.
    """
    return percentiles_of_runs(value_runs(df, keys, value), list(keys), pcts, method=method, least=least)
