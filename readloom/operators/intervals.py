"""Coverage depth, regions of interest and neighbouring features of intervals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.functions.text import natural_key
from readloom.operators.statistics import places
from readloom.session import materialize

#: Positions of one tile; groups are cut into tiles so that a hot one is spread over tasks.
TILE = 1 << 18
#: Positions of one tile of `neighbours`, each searched by one call.
NEIGHBOUR_TILE = 1 << 22


def coverage_depth(df: DataFrame, keys: list[str], start: Column, stop: Column, *, tile: int = TILE) -> DataFrame:
    """Ranges of constant depth: (*keys, span_start, span_end, depth), half-open, from ranges with both ends included.

    A new range begins wherever a range begins or ends, so neighbours of equal depth stay apart; depth 0 is left
    out. Starts count +1 and ends -1 at their position, summed by position within each task first; depths run
    up within tiles, each with the sum of the tiles before it. Rows without a coordinate cover nothing.
    """
    lo, hi = F.least(start, stop).cast("long"), F.greatest(start, stop).cast("long")
    ends = F.array(F.struct(lo.alias("pos"), F.lit(1).alias("d")), F.struct((hi + 1).alias("pos"), F.lit(-1).alias("d")))
    events = df.where(start.isNotNull() & stop.isNotNull()).select(*keys, F.explode(ends).alias("e")).groupBy(*keys, F.floor(F.col("e.pos") / tile).alias("tile"), F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d"))
    tiles = events.groupBy(*keys, "tile").agg(F.sum("d").alias("all"), F.min("pos").alias("opens"))
    order = W.partitionBy(*keys).orderBy("tile")
    carry = tiles.select(*keys, "tile", F.coalesce(F.sum("all").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lead("opens").over(order).alias("after"))
    inside = W.partitionBy(*keys, "tile").orderBy("pos")
    runs = events.withColumn("run", F.sum("d").over(inside)).withColumn("next", F.lead("pos").over(inside))
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "tile"]]
    out = runs.alias("l").join(carry.alias("r"), on).select(*[f"l.{k}" for k in keys], F.col("l.pos").alias("span_start"), F.coalesce("l.next", "r.after").alias("span_end"), (F.col("l.run") + F.col("r.before")).alias("depth"))
    return out.where("depth > 0")


def roi_coverage(depths: DataFrame, keys: list[str], first: Column | int, last: Column | int) -> DataFrame:
    """Per group: unique and redundant bases inside and outside a region (both ends included), total and covered ratio."""
    first, last = F.lit(first) if isinstance(first, int) else first, F.lit(last) if isinstance(last, int) else last
    size = F.col("span_end") - F.col("span_start")
    inside = F.greatest(F.lit(0), F.least(F.col("span_end"), last + 1) - F.greatest(F.col("span_start"), first))
    sums = depths.groupBy(*keys).agg(
        F.sum(inside).alias("unique_in"), F.sum(inside * (F.col("depth") - 1)).alias("redundant_in"), F.sum(size - inside).alias("unique_out"),
        F.sum((size - inside) * (F.col("depth") - 1)).alias("redundant_out"), F.sum(size * F.col("depth")).alias("total_bases"), F.max(last - first + 1).alias("roi_size"),
    )
    return sums.select("*", (F.col("unique_in") / F.col("roi_size")).alias("covered_ratio")).drop("roi_size")


def max_depth(depths: DataFrame, keys: list[str]) -> DataFrame:
    return depths.groupBy(*keys).agg(F.max("depth").alias("max_depth"), F.min("span_start").alias("first_covered"), F.max("span_end").alias("end_covered"))


def _first_above(values: np.ndarray, at: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The first place from `at` on whose value exceeds the limit, the number of values if there is none; all at once.

    Maxima of blocks of 2, 4, 8, ... values; each search climbs while its block holds nothing greater, then descends.
    """
    n = len(values)
    if not n:
        return at.copy()
    low = np.iinfo("int64").min
    levels = [np.r_[values, low]]
    while len(levels[-1]) > 1:
        x = levels[-1]
        x = np.r_[x, low] if len(x) % 2 else x
        levels.append(np.maximum(x[::2], x[1::2]))
    place, height, out = np.minimum(at, n), np.zeros(len(at), "int64"), np.full(len(at), n, "int64")
    live = np.flatnonzero(at < n)
    for k, level in enumerate(levels):  # up
        mine = live[height[live] == k]
        if not len(mine):
            continue
        here = place[mine]
        hit = (here < len(level)) & (level[np.minimum(here, len(level) - 1)] > limits[mine])
        rest, here = mine[~hit], here[~hit] + 1
        odd = here % 2 == 1  # the block beside: look at it before climbing
        again = rest[odd]
        there = here[odd]
        beside = (there < len(level)) & (level[np.minimum(there, len(level) - 1)] > limits[again])
        place[again] = there
        up = np.r_[rest[~odd], again[~beside]]
        place[up] = np.r_[here[~odd], there[~beside] + 1] // 2
        height[up] = k + 1
    found = live[(height[live] < len(levels)) & (place[live] < np.array([len(x) for x in levels])[np.minimum(height[live], len(levels) - 1)])]
    for k in range(len(levels) - 1, 0, -1):  # down
        mine = found[height[found] == k]
        left = place[mine] * 2
        below = levels[k - 1]
        place[mine] = np.where(below[np.minimum(left, len(below) - 1)] > limits[mine], left, left + 1)
        height[mine] = k - 1
    out[found] = place[found]
    return out


def _next_greater(start: np.ndarray, stop: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """Of rows sorted by (start, stop): the row of the next one with greater start and stop, -1 if there is none."""
    out = np.full(len(start), -1, "int64")
    of = np.flatnonzero(asks)
    got = _first_above(stop, np.searchsorted(start, start[of], "right"), stop[of])
    out[of] = np.where(got < len(start), got, -1)
    return out


def _within(table: pa.Table) -> pa.Table:
    """A tile's rows with the next feature where the tile has it; kind 0 done, 1 still asked for, 2 an answer to others."""
    table = table.sort_by([("s", "ascending"), ("e", "ascending")])
    s, e = table["s"].to_numpy(), table["e"].to_numpy()
    at = _next_greater(s, e, np.ones(len(s), bool))
    carry = table["carry"][0].as_py()
    # Answers to earlier tiles: the running greatest stops, up to the first beyond all that earlier tiles reach.
    record = np.r_[True, e[1:] > np.maximum.accumulate(e)[:-1]] if len(e) else np.zeros(0, bool)
    passed = np.flatnonzero(record & (e > carry)) if carry is not None else np.zeros(0, "int64")
    if carry is None:
        record[:] = False
    elif len(passed):
        record[passed[0] + 1 :] = False
    keep = np.flatnonzero(record)
    kind = np.where(at >= 0, 0, 1)
    ns, ne = [pa.array(np.where(at >= 0, v[at], 0), mask=at < 0) for v in (s, e)]
    own = table.drop_columns(["carry", "tile"]).append_column("ns", ns).append_column("ne", ne).append_column("kind", pa.array(kind.astype("int32")))
    other = table.drop_columns(["carry", "tile"]).take(pa.array(keep))
    nothing = pa.nulls(len(keep), pa.int64())
    other = other.append_column("ns", nothing).append_column("ne", nothing).append_column("kind", pa.array(np.full(len(keep), 2, "int32")))
    return pa.concat_tables([own, other])


def _again(table: pa.Table) -> pa.Table:
    """A wider tile's open rows and answers: what is answered now, what stays open, and which answers go on."""
    table = table.sort_by([("s", "ascending"), ("e", "ascending"), ("kind", "ascending")])
    s, e, kind = table["s"].to_numpy(), table["e"].to_numpy(), table["kind"].to_numpy()
    at = _next_greater(s, e, kind == 1)
    carry = table["carry"][0].as_py()
    # As within a tile: running greatest stops, up to the first beyond all that is open in earlier tiles.
    record = np.r_[True, e[1:] > np.maximum.accumulate(e)[:-1]] if carry is not None else np.zeros(len(e), bool)
    passed = np.flatnonzero(record & (e > carry)) if carry is not None else []
    if len(passed):
        record[passed[0] + 1 :] = False
    ns, ne = [pa.array(np.where(at >= 0, v[at], 0), mask=at < 0) for v in (s, e)]
    n = table.column_names.index("ns")
    table = table.drop_columns(["carry", "tile"]).set_column(n, "ns", ns).set_column(n + 1, "ne", ne)
    k = table.column_names.index("kind")
    own = table.set_column(k, "kind", pa.array(np.where(at >= 0, 0, 1).astype("int32"))).filter(pa.array(kind == 1))
    nothing = pa.nulls(int(record.sum()), pa.int64())
    other = table.filter(pa.array(record)).set_column(n, "ns", nothing).set_column(n + 1, "ne", nothing)
    return pa.concat_tables([own, other.set_column(k, "kind", pa.array(np.full(other.num_rows, 2, "int32")))])


def _with_reach(rows: DataFrame, of: Column, tile: int) -> DataFrame:
    """tile: the part of positions of a row; carry: the greatest stop, of the rows that `of` tells, in the container's earlier tiles."""
    rows = rows.withColumn("tile", F.floor(F.col("s") / tile))
    order = W.partitionBy("c").orderBy("tile").rowsBetween(W.unboundedPreceding, -1)
    reach = rows.groupBy("c", "tile").agg(F.max(F.when(of, F.col("e"))).alias("reach")).select("c", "tile", F.max("reach").over(order).alias("carry"))
    return rows.join(reach, ["c", "tile"])


def neighbours(df: DataFrame, container: str, start: str, stop: str, *, previous: bool = False, wrap: bool = True, tile: int = NEIGHBOUR_TILE) -> DataFrame:
    """Distinct features with their next one: (container, start, stop, to_container, to_start, to_stop).

    Next is the first feature, by start and stop, whose start and stop are both strictly greater; previous the
    last one with both strictly smaller. With `wrap` the last feature of a container leads to the first one of
    the next container in natural order, and that of the last container to the first container; else to null.

    Tiles of positions are searched by themselves. What they leave open meets, in tiles 64 times as wide and at
    last in the container, only those rows of later tiles that can be an answer: however thin the features
    lie, a container's last step gets few of them. Rows with a null are left out.
    """
    sign = -1 if previous else 1
    rows = df.select(F.col(container).alias("c"), (sign * F.col(start)).cast("long").alias("s"), (sign * F.col(stop)).cast("long").alias("e")).dropna().distinct()
    kind = "c string, s long, e long, ns long, ne long, kind int"
    first = _with_reach(rows, F.lit(True), tile).select("c", "s", "e", "tile", "carry").groupBy("c", "tile").applyInArrow(_within, kind)
    first = materialize(first, "neighbours")  # read three times
    wide = _with_reach(first.where("kind > 0"), F.col("kind") == 1, 64 * tile).select("c", "s", "e", "ns", "ne", "kind", "tile", "carry")
    second = materialize(wide.groupBy("c", "tile").applyInArrow(_again, kind), "neighbours")
    last = second.where("kind > 0").select("*", F.lit(0).alias("tile"), F.lit(None).cast("long").alias("carry")).groupBy("c").applyInArrow(_again, kind)
    found = first.where("kind = 0").unionByName(second.where("kind = 0")).unionByName(last)
    edge = rows.groupBy("c").agg(F.min(F.struct("s", "e")).alias("f"))
    names = natural_key("c")
    by_name = W.orderBy(names.desc() if previous else names.asc(), "c")
    turn = edge.select("c", F.coalesce(F.lead(F.struct("c", "f")).over(by_name), F.first(F.struct("c", "f")).over(by_name)).alias("t"))
    out = found.join(turn, "c", "left") if wrap else found.withColumn("t", F.lit(None).cast("struct<c:string,f:struct<s:bigint,e:bigint>>"))
    gone = F.col("ns").isNull()
    return out.select(
        F.col("c").alias(container), (sign * F.col("s")).alias(start), (sign * F.col("e")).alias(stop), F.when(gone, F.col("t.c")).otherwise(F.col("c")).alias("to_container"),
        (sign * F.when(gone, F.col("t.f.s")).otherwise(F.col("ns"))).alias("to_start"), (sign * F.when(gone, F.col("t.f.e")).otherwise(F.col("ne"))).alias("to_stop"),
    )


def sorted_features(df: DataFrame, container: str, start: str, stop: str) -> DataFrame:
    """Distinct features (container, start, stop) with their place from 1 on in natural container order, and the starts before and after in their container.

    Features are put in order by range partitions; the neighbours of a container come from a window over it.
    """
    f = df.select(F.col(container).alias("container"), F.col(start).alias("start"), F.col(stop).alias("stop")).dropna().distinct()
    w = W.partitionBy("container").orderBy("start", "stop")
    near = f.withColumn("start_before", F.lag("start").over(w)).withColumn("start_after", F.lead("start").over(w)).withColumn("key_", natural_key("container"))
    return places(near, ["key_", "container", "start", "stop"]).drop("key_")
