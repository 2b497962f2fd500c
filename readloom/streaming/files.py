"""Folders watched as streams: new text files, and incremental duplicate reduction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def watch_folder(spark: SparkSession, path: str, *, pattern: str | None = None, glob: str | None = None, per_trigger: int = 100, line_sep: str | None = None) -> DataFrame:
    """A stream of (path, line) of all text files in a folder: those there at first, then new ones.

    `glob` narrows the listing, `pattern` is searched in the whole path. Files that change or go away later give
    no event here, as a file source reads each file once; see `changes`.
    """
    r = spark.readStream.option("maxFilesPerTrigger", per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if line_sep:
        r = r.option("lineSep", line_sep)
    lines = r.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    return lines.where(F.col("path").rlike(pattern)) if pattern else lines


def file_events(lines: DataFrame, on_created: Callable[[list[str]], None], checkpoint: str) -> StreamingQuery:
    """Runs `on_created` with the new files of each batch; stop and start the query to pause and resume."""

    def each(batch: DataFrame, _: int) -> None:
        on_created(sorted(r.path for r in batch.select("path").distinct().collect()))

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def listing(spark: SparkSession, path: str, *, pattern: str | None = None) -> DataFrame:
    """(path, length, modified) of the files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    return files.where(F.col("path").rlike(pattern)) if pattern else files


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, event) between two listings of a folder: created, modified or removed; what stayed as it was gives none.

    A stream of files tells only of new ones; for the other events keep each listing (as a table) and compare.
    """
    a = before.select("path", F.struct("length", "modified").alias("was"))
    b = after.select("path", F.struct("length", "modified").alias("is"))
    both = a.join(b, "path", "full_outer")
    event = F.when(F.col("was").isNull(), "created").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "modified")
    return both.select("path", event.alias("event")).where("event is not null")


def mapped_lines(lines: DataFrame, column: Callable) -> DataFrame:
    """A stateless listener: `column` of each line as it is read."""
    return lines.select("path", column(F.col("line")).alias("value"))


def stream_table(spark: SparkSession, path: str, schema: T.StructType, *, per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files, or a single one, as a stream."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        r, path = r.option("pathGlobFilter", p.getName()), p.getParent().toString()
    return r.parquet(path)


def running_best(pairs: DataFrame) -> DataFrame:
    """A stream of pairs (read_index, probe_id, uid, score) reduced to the best one per probe and barcode, in complete or update mode.

    The state is one struct per group, whatever the number of duplicates.
    """
    best = F.max(F.struct(F.col("score"), (-F.col("read_index")).alias("i")))
    one = pairs.dropna(subset=["read_index", "probe_id", "uid"]).groupBy("probe_id", "uid").agg(best.alias("b"), F.count(F.lit(1)).alias("n_pairs"))
    return one.select("probe_id", "uid", (-F.col("b.i")).alias("best_index"), F.col("b.score").alias("best_score"), "n_pairs")
