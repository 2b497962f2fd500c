"""Covered periods and gaps of overlapping intervals per entity, on native session windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Width of a tile in bases. Spans are merged by the tile they start in, so a hot entity is spread over tasks.
TILE = 1 << 18


def merge_spans(df: DataFrame, keys: dict[str, Column], start: Column, end: Column, *, tile: int = TILE) -> DataFrame:
    """Periods and gaps per entity: (span_kind, *keys, span_start, span_end), half-open.

    A row covers the positions from its smaller coordinate up to, not including, its larger one. 'period' is a
    longest run of covered positions (touching rows join), 'gap' a run of uncovered ones between two periods.

    Of rows with the same start only the longest matters, which leaves at most `tile` rows in a tile however hot
    it is. These are grouped by entity and by the tile they start in, as session windows: the start is the event
    time in microseconds, the length the row's own gap duration, so overlapping rows merge natively. Touching
    sessions are joined afterwards. Tiles are then stitched: the furthest end of all earlier tiles tells which
    sessions of a tile open a new period, and where the period before it ended; `lead` over the heads gives each
    period's end and each gap. One task handles one tile of one entity, and the list of an entity's tiles with
    one row each: at most 2^32 / tile rows for 32-bit coordinates.

    A row that lacks a coordinate, or with equal ones, covers nothing. A null key value is an entity of its own
    kind: rows with it group together. Repeated rows change nothing. An empty table gives an empty result.
    Only the named expressions are read, so columns of `df` with clashing names do no harm.
    """
    names = list(keys)
    clash = {"span_kind", "span_start", "span_end"} & set(names)
    if clash:
        raise ValueError(f"key names taken by the result: {sorted(clash)}")
    k = [f"k{i}" for i in range(len(names))]
    lo, hi = F.least(start, end).cast("long"), F.greatest(start, end).cast("long")
    spans = (
        df.select(*[keys[n].alias(c) for n, c in zip(names, k, strict=True)], F.when(start.isNotNull() & end.isNotNull(), lo).alias("lo"), hi.alias("hi"))
        .where("lo < hi")
        .withColumn("tile", F.floor(F.col("lo") / tile))
        .groupBy(*k, "tile", "lo")
        .agg(F.max("hi").alias("hi"))
    )
    length = F.make_interval(secs=((F.col("hi") - F.col("lo")).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))
    sessions = (
        spans.withColumn("at", F.timestamp_micros("lo"))
        .groupBy(*k, "tile", F.session_window("at", length).alias("w"))
        .agg(F.max("hi").alias("hi"))
        .select(*k, "tile", F.unix_micros("w.start").alias("lo"), "hi")
    )
    # Within a tile: the end of the session before; sessions are disjoint, so it is also the furthest end so far.
    in_tile = W.partitionBy(*k, "tile").orderBy("lo")
    local = sessions.withColumn("before", F.lag("hi").over(in_tile))
    # Across tiles: the furthest end of all tiles before.
    reach = sessions.groupBy(*k, "tile").agg(F.max("hi").alias("reach"))
    order = W.partitionBy(*k).orderBy("tile")
    carry = reach.withColumn("carry", F.max("reach").over(order.rowsBetween(W.unboundedPreceding, -1))).withColumn(
        "all", F.max("reach").over(W.partitionBy(*k))
    )
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*k, "tile"]]
    both = local.alias("l").join(carry.alias("r"), same).select(*[f"l.{c}" for c in [*k, "tile"]], "l.lo", F.greatest("l.before", "r.carry").alias("ended"), "r.all")
    heads = both.where("ended is null or lo > ended")
    # The end of a period is where the next head saw the last one end; the next head may be in a later tile.
    first = heads.groupBy(*k, "tile").agg(F.min_by("ended", "lo").alias("opens"))
    nexts = first.withColumn("after", F.lead("opens").over(order)).drop("opens")
    done = heads.withColumn("next_ended", F.lead("ended").over(in_tile)).alias("l").join(nexts.alias("r"), same).select(
        *[F.col(f"l.{c}").alias(n) for c, n in zip(k, names, strict=True)], "l.lo", "l.ended", F.coalesce("l.next_ended", "r.after", "l.all").alias("hi")
    )
    kinds = F.array(
        F.struct(F.lit("period").alias("span_kind"), F.col("lo").alias("span_start"), F.col("hi").alias("span_end")),
        F.when(F.col("ended").isNotNull(), F.struct(F.lit("gap").alias("span_kind"), F.col("ended").alias("span_start"), F.col("lo").alias("span_end"))),
    )
    return done.select(*names, F.explode(kinds).alias("s")).where("s is not null").select("s.span_kind", *names, "s.span_start", "s.span_end")
