"""Joins of reads, alignments, probes and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Windows (probes) of up to this many bytes of columns are broadcast; beyond, both sides are shuffled by bin.
BROADCAST_BYTES = 32 << 20
#: Widths of bins as powers of two; a range lies in bins of the first width that isn't below its length, at most two of them.
_LEVELS = tuple(range(6, 63, 3))
_NONE = "array<struct<level:int,bin:bigint>>"


def _size_in_bytes(df: DataFrame) -> Column:
    """About what a row takes: 16 a column, and the characters of strings."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    return sum(texts, F.lit(16 * len(df.columns)).cast("long"))


def _level(first: Column, last: Column) -> Column:
    """The exponent of the bins for a range."""
    bits = F.length(F.bin(last - first))
    return F.greatest(F.lit(_LEVELS[0]), 3 * F.ceil(bits / 3)).cast("int")


def _bin(place: Column, level: Column) -> Column:
    return F.call_function("shiftright", place, level)


def _keys(first: Column, last: Column, level: Column) -> Column:
    """(level, bin) of each bin that a range touches."""
    return F.transform(F.sequence(_bin(first, level), _bin(last, level)), lambda x: F.struct(level.alias("level"), x.alias("bin")))


def merge_raw_reads(alignments: DataFrame, reads: DataFrame) -> DataFrame:
    """Alignments with the raw read's bases and qualities put back: join on (name, mate), one alignment each.

    `alignments`: name, mate, seq, ... ; `reads`: name, mate, read_index, seq, qual. The aligned length is kept
    as mapped_length. Of several alignments of one (name, mate) the one with the lowest start, then the least
    other columns, stays. Alignments without a read, and reads without an alignment, give no row.
    """
    others = [c for c in alignments.columns if c not in ("name", "mate")]
    ordered = [c for c in sorted(others, key=lambda c: c != "start") if not isinstance(alignments.schema[c].dataType, T.MapType)]
    kept = alignments.dropna(subset=["name", "mate"]).groupBy("name", "mate").agg(F.min_by(F.struct(*others), F.struct(*ordered)).alias("a"))
    flat = kept.select("name", "mate", *[F.col(f"a.{c}").alias(c) for c in others if c not in ("seq", "qual")], F.length("a.seq").alias("mapped_length"))
    return flat.join(reads.select("name", "mate", "read_index", "seq", "qual"), ["name", "mate"])


def restore_names(records: DataFrame, names: DataFrame) -> DataFrame:
    """Records by read_index with their original name."""
    return records.join(names.select("read_index", F.col("name").alias("original_name")), "read_index")


def pair_mates(records: DataFrame, key: str, mate: str) -> DataFrame:
    """One row per key that has both mates: key, one, two (structs of the other columns).

    Of several records of one mate the least one by all columns counts. Null keys pair with nothing.
    """
    rest = [c for c in records.columns if c not in (key, mate)]
    one, two = (F.min(F.when(F.col(mate) == m, F.struct(*rest))).alias(n) for m, n in ((1, "one"), (2, "two")))
    return records.dropna(subset=[key]).groupBy(key).agg(one, two).where("one is not null and two is not null")


def range_join(
    rows: DataFrame, windows: DataFrame, *, container: str = "container", start: str = "start", stop: str = "stop", strand: str | None = None,
    how: str = "contained", bin_width: int | None = None, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Rows with the windows that contain ('contained') or overlap ('overlap') them; both ends included.

    Both sides name their columns alike; the windows' come out with the prefix w_. With `strand`, the strands
    must be equal. The join is by container and bin. Bins are as wide as the wider of the two ranges (or
    `bin_width` positions), so a range lies in two of them at most, and a row meets only windows near it. A contained row
    lies in the bin of its own start, one for each width that windows have; an overlap is reported in the bin of the
    greater start, so each comes once. Windows are broadcast if, bins included, they take at most `broadcast_bytes`.

    Rows or windows with a null in any of these columns join nothing. Reversed coordinates are put in order for the
    comparison.
    """
    if how not in ("contained", "overlap"):
        raise ValueError("how must be 'contained' or 'overlap'")
    w = windows.select(*[F.col(c).alias(f"w_{c}") for c in windows.columns])
    a, b = F.least(start, stop).cast("long"), F.greatest(start, stop).cast("long")
    wa, wb = F.least(f"w_{start}", f"w_{stop}").cast("long"), F.greatest(f"w_{start}", f"w_{stop}").cast("long")
    rows = rows.where(F.col(start).isNotNull() & F.col(stop).isNotNull())
    w = w.where(F.col(f"w_{start}").isNotNull() & F.col(f"w_{stop}").isNotNull())
    fits = (wa <= a) & (b <= wb) if how == "contained" else (F.greatest(a, wa) <= F.least(b, wb))
    if bin_width:
        w = w.withColumn("w_key_", F.explode(F.transform(F.sequence(F.floor(wa / bin_width), F.floor(wb / bin_width)), lambda x: F.struct(F.lit(0).alias("level"), x.alias("bin")))))
        last = a if how == "contained" else b
        left = rows.withColumn("key_", F.explode(F.transform(F.sequence(F.floor(a / bin_width), F.floor(last / bin_width)), lambda x: F.struct(F.lit(0).alias("level"), x.alias("bin")))))
        once = F.lit(True) if how == "contained" else F.floor(F.greatest(a, wa) / bin_width) == F.col("key_.bin")
        small = False
    else:
        stats = w.agg(F.sum(_size_in_bytes(w) + 16).alias("bytes"), F.collect_set(_level(wa, wb)).alias("levels")).first()
        levels = sorted(stats["levels"])  # at most as many as there are widths
        if how == "contained":
            w = w.withColumn("w_key_", F.explode(_keys(wa, wb, _level(wa, wb))))
            left = rows.withColumn("key_", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(a, k).alias("bin")) for k in levels]).cast(_NONE)))
            once, copies = F.lit(True), 2
        else:
            # A pair meets at the wider of its two widths: rows go to those of windows above their own, windows to all above.
            own, w_own = _level(a, b), _level(wa, wb)
            widths = F.array(*[F.lit(k) for k in _LEVELS])
            w = w.withColumn("w_key_", F.explode(F.flatten(F.transform(F.filter(widths, lambda k: k >= w_own), lambda k: _keys(wa, wb, k)))))
            wanted = F.filter(widths, lambda k: (k == own) | ((k > own) & k.isin(levels or [-1])))
            left = rows.withColumn("key_", F.explode(F.flatten(F.transform(wanted, lambda k: _keys(a, b, k)))))
            level = F.col("key_.level")
            once = (level == F.greatest(own, w_own)) & (_bin(F.greatest(a, wa), level) == F.col("key_.bin"))
            copies = 2 * len(_LEVELS)
        small = (stats["bytes"] or 0) * copies <= broadcast_bytes
    both = (left[container] == w[f"w_{container}"]) & (left["key_"] == w["w_key_"])
    if strand:
        both = both & (left[strand] == w[f"w_{strand}"])
    return left.join(F.broadcast(w) if small else w, both & fits & once).drop("key_", "w_key_")


def mate_probe_intersection(hits: DataFrame) -> DataFrame:
    """(read_index, probe_id) hit by both mates; `hits`: read_index, mate, probe_id."""
    return hits.dropna().groupBy("read_index", "probe_id").agg(F.bit_or(F.when(F.col("mate") == 1, 1).when(F.col("mate") == 2, 2).otherwise(0)).alias("m")).where("m = 3").drop("m")


def unambiguous(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Rows whose key comes at most `most` times: an anti join against the keys that come more often."""
    often = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(key)
    return rows.join(often, key, "left_anti")


def excluding(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the names."""
    return rows.join(names.select(key).dropna().distinct(), key, "left_anti")


def names_of(assignments: DataFrame, probes: DataFrame) -> DataFrame:
    """(read_name, probe_id): the distinct names assigned to the asked probes (probe_id); looked up, not listed by probe."""
    return assignments.select("read_name", "probe_id").dropna().join(probes.select("probe_id").distinct(), "probe_id", "left_semi").distinct()


def best_candidates(scored: DataFrame) -> DataFrame:
    """(read_index, probe_id, matches, edits) of the one best candidate per read; reads with tied best ones drop out.

    Most matches go first, then the lowest edit distance.
    """
    w = W.partitionBy("read_index").orderBy(F.col("matches").desc(), F.col("edits"))
    ranked = scored.withColumn("r", F.rank().over(w)).where("r = 1")
    return ranked.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("read_index"))).where("n = 1").drop("r", "n")


def pair_assignments(one: DataFrame, two: DataFrame) -> DataFrame:
    """Names assigned in two files: (name, pairings, status) with status none, single or multiple.

    `one`, `two`: name, primary_id, secondary_id. A pairing has equal primary and different secondary ids.
    """
    b = two.select("name", F.col("primary_id").alias("p2"), F.col("secondary_id").alias("s2"))
    # The pairings of a name are counted, never listed: by primary id, all pairs less those of equal secondary ids.
    x = one.groupBy("name", "primary_id", "secondary_id").agg(F.count(F.lit(1)).alias("n"))
    y = b.groupBy("name", "p2", "s2").agg(F.count(F.lit(1)).alias("m"))
    same = x.join(y, (x.name == y.name) & (x.primary_id == y.p2) & (x.secondary_id == y.s2)).select(x.name, (F.col("n") * F.col("m")).alias("minus"), F.lit(0).cast("long").alias("plus"))
    xs, ys = x.groupBy("name", "primary_id").agg(F.sum("n").alias("n")), y.groupBy("name", "p2").agg(F.sum("m").alias("m"))
    full = xs.join(ys, (xs.name == ys.name) & (xs.primary_id == ys.p2)).select(xs.name, F.lit(0).cast("long").alias("minus"), (F.col("n") * F.col("m")).alias("plus"))
    names = one.select("name").unionByName(two.select("name")).dropna().distinct().select("name", F.lit(0).cast("long").alias("minus"), F.lit(0).cast("long").alias("plus"))
    out = names.unionByName(same).unionByName(full).groupBy("name").agg((F.sum("plus") - F.sum("minus")).alias("pairings"))
    return out.withColumn("status", F.when(F.col("pairings") == 0, "none").when(F.col("pairings") == 1, "single").otherwise("multiple"))


def identify_genomes(dictionary: DataFrame, genomes: DataFrame) -> DataFrame:
    """Genomes (genome) whose stored (container, size) hold every entry of the dictionary (container, size)."""
    asked = dictionary.select("container", "size").distinct()
    n = asked.count()
    found = genomes.select("genome", "container", "size").distinct().join(asked, ["container", "size"]).groupBy("genome").agg(F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") == n).select("genome")


def genome_mismatches(dictionary: DataFrame, genome: DataFrame) -> DataFrame:
    """Both sides' containers with their sizes and a status: equal, '*' for another size, NO_MATCH for one side only."""
    a = dictionary.select("container", F.col("size").alias("size"))
    b = genome.select("container", F.col("size").alias("genome_size"))
    status = F.when(F.col("size").isNull() | F.col("genome_size").isNull(), "NO_MATCH").when(F.col("size") != F.col("genome_size"), "*").otherwise("equal")
    return a.join(b, "container", "full_outer").withColumn("status", status)
