"""Per-key results where a few keys hold most records: multi-level tree aggregation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.session import materialize, scan_partitions

#: Rows of one input chunk, combined locally before anything is shuffled.
CHUNK_ROWS = 131_072
#: A key holding at least chunk_rows / HEAVY_SHARE rows of a chunk goes through the tree.
HEAVY_SHARE = 1024
#: States merged by one task in one round of the tree.
FAN_IN = 16


def _combine(chunk_rows: int, heavy_at: int, valued: bool):
    """mapInArrow: rows (key_field, key, value) -> one state per key and chunk; null keys, which are no values, count too."""
    counted = [("value", "min"), ("value", "max"), ("value", "count")] if valued else []

    def states(parts: list[pa.RecordBatch], part: int, chunk: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        g = t.group_by(["key_field", "key_value"]).aggregate([([], "count_all"), *counted])
        n, size = g["count_all"], len(g)
        columns = {"key_field": g["key_field"], "key_value": g["key_value"], "heavy": pc.greater_equal(n, heavy_at), "chunk": pa.array([(part << 24) + chunk] * size, pa.int64()), "n": n.cast(pa.int64())}
        if valued:
            columns |= {"lo": g["value_min"], "hi": g["value_max"], "valued": g["value_count"].cast(pa.int64())}
        return pa.table(columns).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, chunk, held, rows = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            if b.num_rows == 0:
                continue
            held.append(b)
            rows += b.num_rows
            if rows >= chunk_rows:
                yield from states(held, part, chunk).to_batches()
                held, rows, chunk = [], 0, chunk + 1
        if held:
            yield from states(held, part, chunk).to_batches()

    return run


def _merged(df: DataFrame, *by: str) -> DataFrame:
    state = {"n": F.sum("n"), "lo": F.min("lo"), "hi": F.max("hi"), "valued": F.sum("valued")}
    return df.groupBy(*by).agg(*[c.alias(k) for k, c in state.items() if k in df.columns])


def _states(df: DataFrame, keys: dict[str, Column], value: Column | None, chunk_rows: int, heavy_share: int) -> DataFrame:
    """The states of all keys by chunk, null keys among them, written to the shared folder: what follows reads them more than once."""
    if chunk_rows < 1:
        raise ValueError("chunk_rows must be at least 1")
    labels = list(keys)
    values = [] if value is None else [value.alias("value")]
    flat = df.select(*values, *[keys[k].cast("string").alias(f"k{i}") for i, k in enumerate(labels)])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("key_field"), F.col(f"k{i}").alias("key_value")) for i, k in enumerate(labels)]))
    long = flat.select(*["value" for _ in values], each.alias("k")).select("k.key_field", "k.key_value", *["value" for _ in values])
    kinds = {"key_field": T.StringType(), "key_value": T.StringType(), "heavy": T.BooleanType(), "chunk": T.LongType(), "n": T.LongType()}
    if values:
        kinds |= {"lo": (vt := flat.schema["value"].dataType), "hi": vt, "valued": T.LongType()}
    schema = T.StructType([T.StructField(k, t) for k, t in kinds.items()])
    return materialize(long.mapInArrow(_combine(chunk_rows, max(2, chunk_rows // heavy_share), bool(values)), schema), "key-states")


def _tree(states: DataFrame, fan_in: int, partitions: int) -> DataFrame:
    """One state per key: heavy ones through the rounds of the tree, then with the light ones by key."""
    known = states.where("key_value is not null")
    light = known.where("not heavy").drop("heavy", "chunk")
    heavy = known.where("heavy").withColumn("slot", F.shiftright("chunk", 24)).drop("heavy", "chunk")
    for _ in range(math.ceil(math.log(max(2, partitions), fan_in))):
        heavy = _merged(heavy.withColumn("slot", F.floor(F.col("slot") / fan_in)), "key_field", "key_value", "slot")
    return _merged(light.unionByName(heavy.drop("slot")), "key_field", "key_value")


def _partitions(df: DataFrame, partitions: int | None) -> int:
    return partitions or scan_partitions(df) or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def tree_aggregate(
    df: DataFrame, keys: dict[str, Column], value: Column, *, chunk_rows: int = CHUNK_ROWS, heavy_share: int = HEAVY_SHARE, fan_in: int = FAN_IN, partitions: int | None = None,
) -> DataFrame:
    """Rows, valued rows, least and greatest value of every key, with evenly loaded tasks.

    `keys` maps a label (column key_field) to the expression whose values (key_value, string) are the keys;
    every key column is aggregated over the one scan. `value` is any orderable expression.

    Each task combines fixed-size chunks of its input to one state per key. States of keys that are heavy in
    their chunk are merged in rounds of `fan_in` partitions, so that no task ever receives all states of a hot
    key; there are log(partitions, fan_in) rounds, one at least, over at most `heavy_share` keys a chunk. All other
    states carry few rows each; they meet by key and join the roots of the tree in one last aggregation by key.

    `partitions`: by default the number of partitions of `df` if that is a plan without shuffles, such as a scan,
    else spark.sql.shuffle.partitions. It sets the number of rounds only: a low figure costs balance, never rows.

    Null keys are no values and give no row. Null values count in n, not in valued; a key without any value
    has null lo and hi. Ties and repeated rows count as they stand. An empty table gives an empty result.
    Other columns of `df`, whatever their names, are not read.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    tree = _tree(_states(df, keys, value, chunk_rows, heavy_share), fan_in, _partitions(df, partitions))
    return tree.select("key_field", "key_value", F.col("n").alias("n_rows"), F.col("valued").alias("n_valued"), F.col("lo").alias("first_value"), F.col("hi").alias("last_value"))


def hot_keys(
    df: DataFrame, keys: dict[str, Column], share: float, *, chunk_rows: int = CHUNK_ROWS, heavy_share: int = HEAVY_SHARE, fan_in: int = FAN_IN, partitions: int | None = None,
) -> DataFrame:
    """The keys that hold at least `share` of all rows, nulls included: (key_field, key_value, n_rows); see `tree_aggregate`.

    The states carry all rows, so `df` is read once; the number of rows of each field (one row a field) is what is
    broadcast to compare the keys with.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    states = _states(df, keys, None, chunk_rows, heavy_share)
    totals = states.groupBy("key_field").agg(F.sum("n").alias("all"))
    found = _tree(states, fan_in, _partitions(df, partitions)).join(F.broadcast(totals), "key_field").where(F.col("n") >= F.col("all") * F.lit(share))
    return found.select("key_field", "key_value", F.col("n").alias("n_rows"))
