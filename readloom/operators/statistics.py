"""Grouped statistics: moments, exact quantiles, robust means, regressions, tallies and compositions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.functions.sequence import BASES, chars
from readloom.session import materialize


def running_stats(df: DataFrame, keys: list[str], x: Column) -> DataFrame:
    """count, total, squares, least, greatest, mean, geometric mean, variances and deviations of each group."""
    return df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"), F.min(x).alias("least"), F.max(x).alias("greatest"), F.avg(x).alias("mean"),
        F.exp(F.avg(F.when(x > 0, F.ln(x)))).alias("geometric_mean"), F.var_samp(x).alias("var_samp"), F.var_pop(x).alias("var_pop"),
        F.stddev_samp(x).alias("sd_samp"), F.stddev_pop(x).alias("rms_deviation"),
    )


def _null_safe(keys: list[str]) -> Column:
    """The condition that aliases l and r have the same keys."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return out


def _ranked(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Each group's values x, of m rows each, with the positions they take up in sorted order: (*keys, x, m, upto, n), n in all.

    The values are range-partitioned over all groups, so that a hot group, or the only one, is spread over tasks. Each
    part counts for itself; it starts after the group's parts before it.
    """
    parts = materialize(runs.repartitionByRange(*keys, "x").withColumn("part", F.spark_partition_id()), "ranges")
    sums = parts.groupBy(*keys, "part").agg(F.sum("m").alias("here"))
    g = W.partitionBy(*keys)
    before = sums.select(*keys, "part", (F.sum("here").over(g.orderBy("part")) - F.col("here")).alias("before"), F.sum("here").over(g).alias("n"))
    own = parts.withColumn("own", F.sum("m").over(W.partitionBy(*keys, "part").orderBy("x")))
    return own.alias("l").join(before.alias("r"), _null_safe([*keys, "part"])).select(*[f"l.{k}" for k in keys], "l.x", "l.m", (F.col("l.own") + F.col("r.before")).alias("upto"), "r.n")


def places(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows with their place from 1 on in the order of the columns `by`, which should tell rows apart.

    Rows are range-partitioned and numbered within their part; only the parts' sizes, a row each, come together.
    """
    parts = materialize(df.repartitionByRange(*by).withColumn("part_", F.spark_partition_id()), "places")
    sizes = parts.groupBy("part_").agg(F.count(F.lit(1)).alias("size_"))
    before = sizes.select("part_", F.coalesce(F.sum("size_").over(W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    own = parts.withColumn("own_", F.row_number().over(W.partitionBy("part_").orderBy(*by)))
    return own.join(F.broadcast(before), "part_").select(*df.columns, (F.col("own_") + F.col("before_")).alias("place"))  # as many rows as there are partitions


def _runs(df: DataFrame, keys: list[str], x: Column) -> DataFrame:
    """Each group's distinct values x with the number m of their rows."""
    return df.select(*keys, x.alias("x")).where("x is not null").groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("m"))


def _at(pos: Column) -> Column:
    return F.max(F.when((F.col("upto") - F.col("m") < pos) & (pos <= F.col("upto")), F.col("x")))


def _quantiles(subsets: int) -> list[Column]:
    n = F.col("n")
    out = []
    for k in range(1, subsets):
        whole = (n * k) % subsets == 0
        low = F.floor(n * k / subsets)
        first, second = F.greatest(low, F.lit(1)), F.least(low + 1, n)
        mean = (_at(first) + _at(second)) / 2
        out.append(F.when(F.max(n) >= subsets, F.when(F.max(whole), mean).otherwise(_at(second).cast("double"))).alias(f"q{k}"))
    return out


def _median() -> Column:
    return (_at(F.floor((F.col("n") + 1) / 2)) + _at(F.floor((F.col("n") + 2) / 2))) / 2


def quantiles(df: DataFrame, keys: list[str], x: Column, subsets: int) -> DataFrame:
    """The subsets - 1 quantiles q1, q2, ... of each group, averaged at discontinuities; null where n < subsets.

    At location n * k / subsets the value is the mean of that order statistic and the next one if the location
    is whole, else the next one. Equal values are collapsed before anything is sorted.
    """
    if subsets < 2:
        raise ValueError("subsets must be at least 2")
    return _ranked(_runs(df, keys, x), keys).groupBy(*keys).agg(F.max("n").alias("n"), *_quantiles(subsets)).where("n is not null")


def five_numbers(df: DataFrame, keys: list[str], x: Column) -> DataFrame:
    """least, q1, median, q3, greatest and iqr of each group; of fewer than four values the quartiles are null, of one value the median is it."""
    q1, _, q3 = _quantiles(4)
    got = _ranked(_runs(df, keys, x), keys).groupBy(*keys).agg(F.max("n").alias("n"), F.min("x").alias("least"), q1, _median().alias("median"), q3, F.max("x").alias("greatest"))
    return got.where("n is not null").withColumn("iqr", F.col("q3") - F.col("q1"))


def biweight_mean(df: DataFrame, keys: list[str], x: Column, tuning: float = 5.0) -> DataFrame:
    """Tukey's biweight mean of each group: (*keys, median, mad, biweight).

    Weights are (1 - u^2)^2 within |u| < 1, u = (x - median) / (tuning * MAD); the median itself where MAD is 0.
    Medians run over each group's distinct values with their counts, which is all that is sorted and joined.
    """
    runs = _runs(df, keys, x.cast("double"))

    def with_median(values: DataFrame, name: str) -> DataFrame:
        """The values with their group's median; values are read twice, from what `_ranked` has written."""
        ranked = _ranked(values, keys)
        one = ranked.groupBy(*keys).agg(_median().alias(name))
        return ranked.alias("l").join(one.alias("r"), _null_safe(keys)).select(*[f"l.{k}" for k in keys], "l.x", "l.m", f"r.{name}")

    centred = with_median(runs, "median")
    apart = centred.groupBy(*keys, F.abs(F.col("x") - F.col("median")).alias("x")).agg(F.sum("m").alias("m"))
    mad = _ranked(apart, keys).groupBy(*keys).agg(_median().alias("mad"))
    full = centred.alias("l").join(mad.alias("r"), _null_safe(keys)).select("l.*", "r.mad")
    u = (F.col("x") - F.col("median")) / (tuning * F.col("mad"))
    weight = F.when((F.col("mad") > 0) & (F.abs(u) < 1), F.pow(1 - u * u, F.lit(2)) * F.col("m")).otherwise(0.0)
    sums = full.groupBy(*keys).agg(F.max("median").alias("median"), F.max("mad").alias("mad"), F.try_divide(F.sum(weight * F.col("x")), F.sum(weight)).alias("b"))
    return sums.select(*keys, "median", "mad", F.coalesce("b", "median").alias("biweight")).where("median is not null")


def linear_regression(df: DataFrame, keys: list[str], y: Column, x: Column) -> DataFrame:
    """slope, intercept, r2, mse, adjusted_r2 and signed r of y on x in each group; rows with a null are left out."""
    n, r2 = F.regr_count(y, x), F.regr_r2(y, x)
    sse = F.regr_syy(y, x) * (1 - r2)
    return df.groupBy(*keys).agg(
        n.alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), r2.alias("r2"), F.when(n > 2, sse / (n - 2)).alias("mse"),
        F.when(n > 2, 1 - (1 - r2) * (n - 1) / (n - 2)).alias("adjusted_r2"), (F.signum(F.regr_slope(y, x)) * F.sqrt(r2)).alias("r"),
    )


def cross_products(df: DataFrame, y: Column, xs: list[Column]) -> DataFrame:
    """One row: n and the sums of products of 1, xs and y that the normal equations need; rows with a null are left out."""
    cols = {"one": F.lit(1.0), **{f"x{i}": x.cast("double") for i, x in enumerate(xs)}, "y": y.cast("double")}
    rows = df.select(*[c.alias(k) for k, c in cols.items()]).dropna()
    names = list(cols)
    return rows.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]])


def multiple_regression(df: DataFrame, y: Column, xs: list[Column]) -> dict:
    """Coefficients (intercept first), r2, adjusted_r2, mse and n; the products are summed in Spark, solved here."""
    row = cross_products(df, y, xs).first()
    names = ["one", *[f"x{i}" for i in range(len(xs))]]
    if row["one_one"] is None or row["one_one"] <= len(names):
        raise ValueError("more rows than coefficients are needed")
    m = np.array([[row[f"{a}_{b}"] if i <= j else row[f"{b}_{a}"] for j, b in enumerate(names)] for i, a in enumerate(names)])
    v = np.array([row[f"{a}_y"] for a in names])
    beta, n = np.linalg.solve(m, v), row["one_one"]
    sst = row["y_y"] - row["one_y"] ** 2 / n
    sse = row["y_y"] - beta @ v
    r2, p = 1 - sse / sst, len(xs)
    return {"coefficients": beta.tolist(), "n": int(n), "r2": r2, "adjusted_r2": 1 - (1 - r2) * (n - 1) / (n - p - 1), "mse": sse / (n - p - 1)}


def tally(df: DataFrame, keys: list[str], x: Column) -> DataFrame:
    """Values of each group with count, share of the group and whether they are tied for the most: (*keys, value, n, share, is_mode)."""
    counts = df.select(*keys, x.alias("value")).where("value is not null").groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    return with_modes(counts, keys)


def with_modes(counts: DataFrame, keys: list[str]) -> DataFrame:
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    both = counts.alias("l").join(totals.alias("r"), on or F.lit(True))
    return both.select("l.*", (F.col("l.n") / F.col("r.total")).alias("share"), (F.col("l.n") == F.col("r.most")).alias("is_mode"))


def merge_tallies(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of two tallies added up: (*keys, value, n)."""
    cols = [*keys, "value", "n"]
    return a.select(*cols).unionByName(b.select(*cols)).groupBy(*keys, "value").agg(F.sum("n").alias("n"))


def composition(df: DataFrame, keys: list[str], seq: Column, weight: Column | None = None) -> DataFrame:
    """Share of each code over all codes of a group's sequences, to 3 decimals: (*keys, code, n, share).

    `weight` counts a sequence so often; without it each row counts once. Codes are counted in the row, so only
    their numbers are shuffled.
    """
    codes = [c for c in BASES if c != "-"]
    w = weight if weight is not None else F.lit(1)
    counts = df.groupBy(*keys).agg(*[F.sum(F.regexp_count(F.upper(seq), F.lit(c)) * w).alias(f"c_{c}") for c in codes])
    total = sum((F.coalesce(F.col(f"c_{c}"), F.lit(0)) for c in codes), F.lit(0))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(f"c_{c}").alias("n")) for c in codes]))
    return counts.select(*keys, total.alias("total"), each.alias("e")).where("e.n > 0").select(*keys, "e.code", "e.n", F.round(F.col("e.n") / F.col("total"), 3).alias("share"))


def composition_by_position(df: DataFrame, keys: list[str], seq: Column) -> DataFrame:
    """Shares of A, C, G and T at each 0-based position of sequences that long: (*keys, pos, n, a, c, g, t)."""
    at = df.select(*keys, F.posexplode(chars(F.upper(seq))).alias("pos", "code")).groupBy(*keys, "pos")
    n = F.count(F.lit(1))
    return at.agg(n.alias("n"), *[(F.count_if(F.col("code") == c) / n).alias(c.lower()) for c in "ACGT"])
