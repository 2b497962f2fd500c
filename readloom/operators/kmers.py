"""K-mer indexes: candidate references, repeated k-mers and exact search on both strands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.functions import sequence as S
from readloom.functions.sequence import kmer_number, reverse_complement

#: K-mers of A, C, G and T up to which the references' own are broadcast to sift the queries'.
KNOWN_KMERS = 1 << 18


def exploded(df: DataFrame, ident: str, seq: str, k: int, *, spacing: int = 1, last: bool = True) -> DataFrame:
    """(ident, pos, kmer) of every spacing-th k-mer; sequences shorter than k have none."""
    end = F.length(seq) - k - (0 if last else 1)
    at = F.explode(F.when(end >= 0, F.sequence(F.lit(0), end, F.lit(spacing))))
    # Positions are exploded, not k-mers: the cut is a compiled expression over single rows.
    return df.select(F.col(ident), F.upper(seq).alias("s"), at.alias("pos")).select(ident, "pos", F.substring(F.col("s"), F.col("pos") + 1, F.lit(k)).alias("kmer"))


def candidates(
    queries: DataFrame, references: DataFrame, *, query_id: str = "query_id", reference_id: str = "reference_id", seq: str = "seq", k: int = 5, query_spacing: int = 1,
    reference_spacing: int = 1, most_references: int | None = None, limit: int | None = None, least_ratio: float = 0.0, include_last: bool = False,
) -> DataFrame:
    """Query and reference with the number of query k-mers that the reference holds: (query_id, reference_id, hits, rank).

    The references' k-mers form an inverted index. With `most_references`, k-mers that more references hold are no
    evidence and left out of it; without, nothing is. Candidates are ranked by hits; one stays while it reaches `least_ratio` of
    the query's or of its own possible hits and, with a `limit`, while at most `limit` are before it or it ties
    with the last of these. As is usual here, the last k-mer of a sequence counts only with `include_last`.
    Repeated k-mers of a query count each time, those of a reference once.
    """
    index = exploded(references, reference_id, seq, k, spacing=reference_spacing, last=include_last).select(reference_id, "kmer").distinct()
    if most_references is not None:
        busy = index.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_references).select("kmer")
        index = index.join(busy, "kmer", "left_anti")
    places = exploded(queries, query_id, seq, k, spacing=query_spacing, last=include_last)
    # Where all k-mers of A, C, G and T are few, those that no reference holds are dropped before anything is shuffled.
    if 4**k <= KNOWN_KMERS:
        plain = F.col("kmer").rlike("^[ACGT]+$")
        known = index.where(plain).select("kmer", F.lit(True).alias("known")).distinct()
        places = places.join(F.broadcast(known), "kmer", "left").where(F.col("known") | ~plain).drop("known")
    asked = places.groupBy(query_id, "kmer").agg(F.count(F.lit(1)).alias("times"))
    hits = asked.join(index, "kmer").groupBy(query_id, reference_id).agg(F.sum("times").alias("hits"))
    if least_ratio > 0:
        q = queries.select(query_id, ((F.length(seq) - k) / query_spacing).alias("q_possible"))
        r = references.select(reference_id, ((F.length(seq) - k) / reference_spacing).alias("r_possible"))
        hits = hits.join(q, query_id).join(r, reference_id)
        hits = hits.where((F.col("hits") >= least_ratio * F.col("q_possible")) | (F.col("hits") >= least_ratio * F.col("r_possible"))).drop("q_possible", "r_possible")
    ranked = hits.withColumn("rank", F.rank().over(W.partitionBy(query_id).orderBy(F.col("hits").desc())))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit + 1)


def placed(texts: DataFrame, sought: DataFrame, mismatches: int, *, broadcast: bool = False) -> DataFrame:
    """Distinct (text, sought) that may fit without gaps: no pair with at most `mismatches` other bases is missing.

    `texts`: text, of A, C, G, T; `sought`: sought, of any codes, few of them other than these, and longer than
    `mismatches`; in either case. Of mismatches + 1 pieces of a sought sequence one must stand in the text without
    a mismatch; pieces, as all the bases their codes stand for, are looked up among the text's substrings of their
    length, and each place is compared whole: by its edit distance, never more than the mismatches, or code by
    code. `broadcast` is for few sought sequences.
    """
    stands_for = F.create_map(*[x for c, bits in S.BASES.items() for x in (F.lit(c), F.array(*[F.lit(b) for b in "ACGT" if S.BASES[b] & bits]).cast("array<string>"))])

    def spelled(c: Column) -> Column:
        more = lambda out, code: F.flatten(F.transform(out, lambda o: F.transform(stands_for[code], lambda b: F.concat(o, b))))
        return F.aggregate(S.chars(c), F.array(F.lit("")), more)

    size = F.floor(F.length("sought") / (mismatches + 1)).cast("int")
    pieces = sought.select("sought", size.alias("size"), F.explode(F.array(*[F.lit(i) for i in range(mismatches + 1)])).alias("i")).select(
        "sought", "size", (F.col("i") * F.col("size")).alias("off"), F.explode(spelled(F.upper(F.substring(F.col("sought"), F.col("i") * F.col("size") + 1, F.col("size"))))).alias("piece"),
        F.upper("sought").rlike("^[ACGT]*$").alias("plain"),
    )
    sizes = sought.select(size.alias("size")).distinct()
    at = F.explode(F.when(F.length("text") >= F.col("size"), F.sequence(F.lit(0), F.length("text") - F.col("size"))))
    places = texts.join(F.broadcast(sizes)).select("text", "size", at.alias("pos")).select("text", "size", "pos", F.upper(F.substring(F.col("text"), F.col("pos") + 1, F.col("size"))).alias("piece"))
    hit = places.join(F.broadcast(pieces) if broadcast else pieces, ["size", "piece"]).withColumn("start", F.col("pos") - F.col("off"))
    hit = hit.where((F.col("start") >= 0) & (F.col("start") + F.length("sought") <= F.length("text")))
    there = F.upper(F.substring(F.col("text"), F.col("start") + 1, F.length("sought")))
    return hit.where(F.when(F.col("plain"), F.levenshtein(there, F.upper("sought"), mismatches) >= 0).otherwise(S.mismatches(there, F.upper("sought")) <= mismatches)).select("text", "sought").distinct()


def repeated(df: DataFrame, ident: str, seq: str, k: int, *, both_strands: bool = False) -> DataFrame:
    """K-mers that come more than once: (kmer, number, n), on both strands with `both_strands`; A, C, G, T only."""
    e = exploded(df, ident, seq, k).select("kmer")
    if both_strands:
        e = e.select(F.explode(F.array(F.col("kmer"), reverse_complement("kmer"))).alias("kmer"))
    counted = e.where(F.col("kmer").rlike("^[ACGT]+$")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return counted.select("kmer", kmer_number("kmer").alias("number"), "n")


def exact_search(genome: DataFrame, queries: DataFrame, *, k: int = 11) -> DataFrame:
    """Where queries stand in a genome, on both strands: (query_id, container, start, strand), start 1-based.

    `genome`: container, start (1-based position of the piece), seq; pieces must overlap by the longest query's
    length less 1. `queries`: query_id, seq, of A, C, G, T and at least k long; others are not searched.
    Every query is looked up by its first k-mer and then compared whole.
    """
    asked = queries.where(F.upper("seq").rlike("^[ACGT]+$") & (F.length("seq") >= k))
    ways = F.array(F.struct(F.lit("+").alias("strand"), F.upper("seq").alias("q")), F.struct(F.lit("-").alias("strand"), reverse_complement(F.upper("seq")).alias("q")))
    both = asked.select("query_id", F.explode(ways).alias("w")).select("query_id", "w.strand", "w.q", F.substring("w.q", 1, k).alias("kmer"))
    g = genome.select("container", F.col("start").alias("piece"), F.upper("seq").alias("g"))
    at = F.explode(F.when(F.length("g") >= k, F.sequence(F.lit(0), F.length("g") - k)))
    places = g.select("container", "piece", "g", at.alias("pos")).select("container", "piece", "pos", F.substring(F.col("g"), F.col("pos") + 1, F.lit(k)).alias("kmer"))
    # Only the pieces of places that share a query's first k-mer are looked at again.
    hit = places.join(both, "kmer").join(g, ["container", "piece"]).where(F.substring(F.col("g"), F.col("pos") + 1, F.length("q")) == F.col("q"))
    return hit.select("query_id", "container", (F.col("piece") + F.col("pos")).alias("start"), "strand").distinct()
