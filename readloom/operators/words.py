"""Few words merged into one that holds each as a subsequence, per group."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.session import materialize


@lru_cache(maxsize=4096)
def merged_pair(a: str, b: str) -> str:
    """A shortest string with both as subsequences; of equal lengths the letters of `a` go first."""
    n, m = len(a), len(b)
    rest = [[0] * (m + 1) for _ in range(n + 1)]  # shortest length for a[i:], b[j:]
    for i in range(n, -1, -1):
        for j in range(m, -1, -1):
            if i == n or j == m:
                rest[i][j] = n - i + m - j
            elif a[i] == b[j]:
                rest[i][j] = 1 + rest[i + 1][j + 1]
            else:
                rest[i][j] = 1 + min(rest[i + 1][j], rest[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append(a[i])
            i, j = i + 1, j + 1
        elif rest[i + 1][j] <= rest[i][j + 1]:
            out.append(a[i])
            i += 1
        else:
            out.append(b[j])
            j += 1
    return "".join(out) + a[i:] + b[j:]


def merge_words(words: list[str]) -> str:
    """One string with all words as subsequences: again and again the two whose merger is shortest, ties by text."""
    left = sorted(set(words))
    while len(left) > 1:
        best = min((len(merged_pair(x, y)), x, y) for k, x in enumerate(left) for y in left[k + 1 :])
        left = sorted({w for w in left if w not in best[1:]} | {merged_pair(*best[1:])})
    return left[0] if left else ""


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    return pa.table({"k": pa.array([key[0].as_py()], pa.string()), "word": pa.array([merge_words(table["word"].to_pylist())], pa.string())})


def merged_words(df: DataFrame, key: str, word: str, *, most: int = 200) -> DataFrame:
    """(key, merged) per group of distinct words: one string that holds each as a subsequence.

    Merging is cubic in the words, so groups of more than `most` are merged in parts of about half of it first, and their
    results in further rounds: no task gets a large group, and no word is left out.
    """
    if most < 2:
        raise ValueError("most must be at least 2")
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(word).alias("word")).dropna().distinct()
    while True:
        sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= most:
            break
        part = F.pmod(F.xxhash64("word"), F.when(F.col("n") > most, F.ceil(2 * F.col("n") / most)).otherwise(1)).alias("part")
        parts = rows.join(sizes, "k").select("k", "word", part).groupBy("k", "part").applyInArrow(_merge, "k string, word string")
        rows = materialize(parts, "merged-words").distinct()
    return rows.groupBy("k").applyInArrow(_merge, "k string, word string").select(F.col("k").alias(key), F.col("word").alias("merged"))
