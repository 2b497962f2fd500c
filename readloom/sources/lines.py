"""Text files as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.session import scan_partitions

#: Splits and files of a text source of which one small row each is broadcast (some 100 bytes).
MOST_SPLITS = 200_000


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, line_no, line) of text files, plain or gzipped, numbered from 0 in each file's order.

    One pass counts the lines of each split, a second one numbers them from what the file's splits before it hold. The
    text isn't shuffled: of splits, which are as many as the file system makes, up to MOST_SPLITS are broadcast.
    """
    base = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("line"))
    # Splits in order of path and offset, lines within a split in their own order.
    tagged = base.withColumn("nth", F.monotonically_increasing_id())
    counts = tagged.groupBy("path", "at").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("low"))
    before = counts.select("path", "at", "low", F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    few = len(base.inputFiles()) + (scan_partitions(base) or MOST_SPLITS) <= MOST_SPLITS
    out = tagged.join(F.broadcast(before) if few else before, ["path", "at"])
    return out.select("path", (F.col("before") + F.col("nth") - F.col("low")).alias("line_no"), "line")


def line_window(lines: DataFrame, first: int, last: int) -> DataFrame:
    """Lines first to last, both included."""
    return lines.where(F.col("line_no").between(first, last))


def groups_of(lines: DataFrame, n: int) -> DataFrame:
    """Every n lines of a file as one row: (path, record_no, lines); an incomplete last group too."""
    g = lines.groupBy("path", F.floor(F.col("line_no") / n).alias("record_no")).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return g.select("path", "record_no", F.col("l.line").alias("lines"))


def search(lines: DataFrame, text: str, *, ignore_case: bool = True, limit: int | None = None) -> DataFrame:
    """Lines that hold the text, with its 0-based column; `limit` for the first lines only."""
    line = F.lower("line") if ignore_case else F.col("line")
    hit = lines.withColumn("column", F.instr(line, text.lower() if ignore_case else text) - 1).where("column >= 0")
    return hit if limit is None else hit.orderBy("path", "line_no").limit(limit)


def next_match(lines: DataFrame, text: str, after: int, *, ignore_case: bool = True) -> DataFrame:
    """Per file the first line after a line number that holds the text."""
    return search(lines.where(F.col("line_no") > after), text, ignore_case=ignore_case).groupBy("path").agg(F.min(F.struct("line_no", "line", "column")).alias("m")).select("path", "m.*")


def token_index(lines: DataFrame) -> DataFrame:
    """Inverted index of the lines' blank-separated tokens: (token, path, line_no, n)."""
    t = lines.select("path", "line_no", F.explode(F.split(F.lower("line"), "\\s+")).alias("token")).where("token != ''")
    return t.groupBy("token", "path", "line_no").agg(F.count(F.lit(1)).alias("n"))


def same_text(a: DataFrame, b: DataFrame) -> bool:
    """Whether two files hold the same lines, whatever their line ends."""

    def clean(df: DataFrame) -> DataFrame:
        return df.select("line_no", F.regexp_replace("line", "\r$", "").alias("line"))

    diff = clean(a).exceptAll(clean(b)).limit(1).count() + clean(b).exceptAll(clean(a)).limit(1).count()
    return diff == 0
