"""Duplicate removal by probe and molecular barcode, with its statistics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.text import natural_key

POLICIES = ("remove", "mark", "keep")


def best_pairs(pairs: DataFrame) -> DataFrame:
    """(probe_id, uid, best_index, best_score, n_pairs): the pair of highest score per probe and barcode, ties to the lowest read_index.

    `pairs`: read_index, probe_id, uid, score. An aggregate, so each task first reduces its own rows and a hot
    barcode is no burden. Pairs without probe, barcode or read_index are left out; a null score is the lowest.
    """
    rows = pairs.select("probe_id", "uid", "read_index", "score").dropna(subset=["probe_id", "uid", "read_index"])
    best = F.max(F.struct(F.col("score"), (-F.col("read_index")).alias("i")))
    one = rows.groupBy("probe_id", "uid").agg(best.alias("b"), F.count(F.lit(1)).alias("n_pairs"))
    return one.select("probe_id", "uid", (-F.col("b.i")).alias("best_index"), F.col("b.score").alias("best_score"), "n_pairs")


def reduce_duplicates(pairs: DataFrame, *, policy: str = "remove") -> DataFrame:
    """Pairs after duplicate reduction, with is_duplicate and is_best.

    'remove' drops the duplicates, 'mark' keeps them flagged, 'keep' keeps all unflagged. Pairs without probe
    or barcode belong to no group and are left out.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    rows = pairs.dropna(subset=["probe_id", "uid", "read_index"])
    if policy == "keep":
        return rows.withColumn("is_duplicate", F.lit(False)).withColumn("is_best", F.lit(True))
    best = best_pairs(rows).select("probe_id", F.col("best_index").alias("read_index"), F.lit(True).alias("is_best"))
    if policy == "remove":
        return rows.join(best, ["probe_id", "read_index"]).withColumn("is_duplicate", F.lit(False)).select(*rows.columns, "is_duplicate", "is_best")
    flagged = rows.join(best, ["probe_id", "read_index"], "left").withColumn("is_best", F.coalesce("is_best", F.lit(False)))
    return flagged.withColumn("is_duplicate", ~F.col("is_best")).select(*rows.columns, "is_duplicate", "is_best")


def _reduced(pairs: DataFrame) -> DataFrame:
    """(probe_id, uid, n_pairs, n_unable, unable_best) per probe and barcode; pairs without a column `extended` all could be extended."""
    rows = pairs.dropna(subset=["probe_id", "uid", "read_index"])
    able = F.coalesce("extended", F.lit(True)) if "extended" in pairs.columns else F.lit(True)
    best = F.max(F.struct("score", (-F.col("read_index")).alias("i"), able.alias("able")))
    return rows.groupBy("probe_id", "uid").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(~able).alias("n_unable"), (~best["able"]).cast("long").alias("unable_best"))


def probe_stats(pairs: DataFrame, probes: DataFrame) -> DataFrame:
    """Per probe: unique_pairs, duplicate_pairs, total_pairs, average_pairs_per_uid (0 where there are none), max_pairs_per_uid.

    Pairs whose column `extended`, if there is one, is false are taken off unique_pairs where they are the best of
    their barcode and off duplicate_pairs where they aren't; max_pairs_per_uid counts them.
    """
    one = _reduced(pairs).groupBy("probe_id").agg(
        (F.count(F.lit(1)) - F.sum("unable_best")).alias("u"), (F.sum("n_pairs") - F.sum("n_unable")).alias("t"), F.max("n_pairs").alias("m")
    )
    u, t = F.coalesce("u", F.lit(0)), F.coalesce("t", F.lit(0))
    average = F.when(u > 0, F.round(t.cast("double") / u, 2)).otherwise(0.0)
    return probes.select("probe_id").join(one, "probe_id", "left").select(
        "probe_id", u.alias("unique_pairs"), (t - u).alias("duplicate_pairs"), t.alias("total_pairs"), average.alias("average_pairs_per_uid"), F.coalesce("m", F.lit(0)).alias("max_pairs_per_uid"),
    )


def probe_details(pairs: DataFrame, probes: DataFrame) -> DataFrame:
    """`probe_stats` in report order (order_no from 1): natural container order, start, probe id."""
    first = probes.select("probe_id", F.col("container_name"), F.least("ext_start", "lig_start").alias("start"), F.greatest("ext_stop", "lig_stop").alias("stop"), "strand")
    both = probe_stats(pairs, probes).join(first, "probe_id")
    return both.orderBy(natural_key("container_name"), "start", "probe_id")


def uid_tallies(pairs: DataFrame) -> DataFrame:
    """(probe_id, uid, n, rank): each probe's barcodes by falling count, ties by barcode, one row each.

    Ranks run within parts of a probe, cut by the size of the count; each part starts after the barcodes of the
    parts before it. Only the barcodes of one count fall into one part, and those are cut further by their own order.
    """
    from pyspark.sql import Window as W

    counts = best_pairs(pairs).select("probe_id", "uid", F.col("n_pairs").alias("n"))
    cut = counts.withColumn("lead", F.substring("uid", 1, 3))
    part = ["probe_id", "n", "lead"]
    sizes = cut.groupBy(*part).agg(F.count(F.lit(1)).alias("size"))
    order = W.partitionBy("probe_id").orderBy(F.col("n").desc(), "lead").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select(*part, F.coalesce(F.sum("size").over(order), F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy(*part).orderBy("uid"))
    return cut.withColumn("own", own).join(before, part).select("probe_id", "uid", "n", (F.col("own") + F.col("before")).cast("int").alias("rank"))


def distinct_uids(pairs: DataFrame) -> DataFrame:
    """One row: the exact number of distinct barcodes."""
    return pairs.agg(F.countDistinct("uid").alias("distinct_uids"))


def mapping_classes(records: DataFrame) -> DataFrame:
    """One row: pairs with both, one or no read mapped, and single records; `records`: name, mate, mapped."""
    m = F.coalesce(F.col("mapped"), F.lit(False))
    per = records.dropna(subset=["name"]).groupBy("name").agg(
        F.max(F.when((F.col("mate") == 1), m.cast("int"))).alias("a"), F.max(F.when((F.col("mate") == 2), m.cast("int"))).alias("b")
    )
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    n = F.col("a") + F.col("b")
    return per.agg(
        F.count_if(both & (n == 2)).alias("both_mapped"), F.count_if(both & (n == 1)).alias("one_mapped"),
        F.count_if(both & (n == 0)).alias("none_mapped"), F.count_if(~both).alias("unpaired"),
    )


def summary_report(pairs: DataFrame, probes: DataFrame, classes: DataFrame, *, prefix: str = "") -> DataFrame:
    """The summary report, one row of 21 columns; `classes` is the row of `mapping_classes`.

    Pairs on target are those counted by `probe_stats`, so without the ones that couldn't be extended.
    """
    per = probe_stats(pairs, probes)
    u = F.col("unique_pairs")
    got = per.agg(
        F.sum(u).alias("unique"), F.sum("duplicate_pairs").alias("dup"), F.count(F.lit(1)).alias("probes"), F.count_if(F.col("total_pairs") == 0).alias("empty"), F.count_if(u > 0).alias("live"),
        F.max(u).alias("most"), F.sum(F.when(u > 0, F.col("average_pairs_per_uid"))).alias("averages"),
    )
    row = got.join(distinct_uids(pairs)).join(classes)
    on = F.col("unique") + F.col("dup")
    off = F.greatest(F.lit(0), F.col("both_mapped") - on)
    mapped = F.col("both_mapped")
    all_pairs = mapped + F.col("one_mapped") + F.col("none_mapped")
    return row.select(
        F.lit(prefix).alias("sample_prefix"), all_pairs.alias("input_read_pairs"), mapped.alias("pairs_with_both_reads_mapped"), F.col("none_mapped").alias("pairs_with_both_reads_unmapped"),
        F.col("one_mapped").alias("pairs_with_only_one_read_mapped"), on.alias("pairs_with_on_target_reads"), F.bround(F.try_divide(100.0 * on, mapped), 4).alias("pct_pairs_with_on_target_reads"),
        off.alias("pairs_with_off_target_reads"), F.bround(F.try_divide(100.0 * off, mapped), 4).alias("pct_pairs_with_off_target_reads"), F.col("dup").alias("duplicate_read_pairs_removed"),
        F.bround(F.try_divide(100.0 * F.col("dup"), on), 1).alias("duplicate_rate"), "probes", F.col("empty").alias("probes_with_no_mapped_read_pairs"), F.col("unique").alias("unique_read_pairs"),
        F.col("distinct_uids").alias("distinct_uids_found"), F.bround(F.try_divide(F.col("unique").cast("double"), F.col("probes")), 4).alias("average_uids_per_probe"),
        F.bround(F.try_divide(F.col("unique").cast("double"), F.col("live")), 4).alias("average_uids_per_probes_with_reads"), F.col("most").alias("max_uids_per_probe"),
        F.bround(F.try_divide(F.col("averages"), F.col("live")), 4).alias("average_read_pairs_per_uid"), F.col("unpaired").alias("unpaired_reads"), (2 * all_pairs + F.col("unpaired")).alias("input_reads"),
    )


def probe_coverage(pairs: DataFrame, probes: DataFrame) -> DataFrame:
    """BED-like rows: container, start, stop, probe, unique pairs, strand, target start and stop."""
    p = probes.select("probe_id", "container_name", F.least("ext_start", "lig_start").alias("start"), F.greatest("ext_stop", "lig_stop").alias("stop"), "strand", "target_start", "target_stop")
    return p.join(probe_stats(pairs, probes).select("probe_id", "unique_pairs"), "probe_id").select("container_name", "start", "stop", "probe_id", "unique_pairs", "strand", "target_start", "target_stop")


def trim_lengths(probes: DataFrame, *, ext_uid: int = 10, lig_uid: int = 0, extra_ext: int = 0, extra_lig: int = 0, primers: bool = True) -> DataFrame:
    """One row with first and last base to keep of both mates, from the probes' longest and shortest parts."""
    e, g, t = F.length("ext_sequence"), F.length("lig_sequence"), F.length("target_sequence")
    on = 1 if primers else 0
    return probes.agg(
        (F.lit(extra_ext + ext_uid) + on * F.max(e)).alias("r1_first"), (F.min(t) + on * F.min(g)).alias("r1_last"),
        (F.lit(extra_lig + lig_uid) + on * F.max(g)).alias("r2_first"), (F.min(t) + on * F.min(e)).alias("r2_last"),
    )


def probe_length_stats(probes: DataFrame) -> DataFrame:
    """One row: least and greatest length of extension primer, ligation primer and target."""
    return probes.agg(*[f(F.length(f"{c}_sequence")).alias(f"{n}_{c}") for c in ("ext", "lig", "target") for n, f in (("min", F.min), ("max", F.max))])


def shared_probe_sequences(probes: DataFrame) -> DataFrame:
    """Whole probe sequences that more than one probe has, with the probes' ids."""
    whole = F.concat("ext_sequence", "target_sequence", "lig_sequence")
    return probes.groupBy(whole.alias("sequence")).agg(F.array_sort(F.collect_set("probe_id")).alias("probe_ids")).where("sequence is not null and size(probe_ids) > 1")


def probes_out_of_bounds(probes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Probes whose container is unknown or that end beyond it; `dictionary`: container_name, size."""
    stop = F.greatest("ext_stop", "lig_stop")
    both = probes.select("probe_id", "container_name", stop.alias("stop")).join(dictionary.select("container_name", "size"), "container_name", "left")
    return both.where(F.col("size").isNull() | (F.col("stop") > F.col("size"))).select("probe_id", "container_name", "stop", "size")
