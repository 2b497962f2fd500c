"""Hot keys, covered spans and bad lines against brute force, with their edge cases."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readloom.functions.keys import code_key, container_key, read_stem
from readloom.operators import badlines
from readloom.operators.hotkeys import hot_keys, tree_aggregate
from readloom.operators.spans import merge_spans


def test_keys(spark):
    df = spark.createDataFrame([(" ab ", "X\t", "r1/1"), ("", " ", "r2 1:N:0"), (None, None, None), ("a", "b", "/x")], "a string, b string, c string")
    got = df.select(code_key("a"), container_key("b"), read_stem("c")).collect()
    assert [tuple(r) for r in got] == [("AB", "x", "r1"), (None, None, "r2"), (None, None, None), ("A", "b", None)]


@pytest.mark.parametrize("partitions", [None, 600, 70000])
def test_tree_aggregate(spark, partitions):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(900)}", rng.randrange(50), rng.choice([None, 1, 2, 3])) for _ in range(6000)] + [(None, 1, 1)] * 5
    df = spark.createDataFrame(rows, "k string, other int, v int").repartition(7)
    got = tree_aggregate(df, {"k": F.col("k"), "o": F.col("other")}, F.col("v"), chunk_rows=200, heavy_share=20, fan_in=4, partitions=partitions or 7).collect()
    want: dict = defaultdict(list)
    for k, o, v in rows:
        if k is not None:
            want["k", k].append(v)
        want["o", str(o)].append(v)
    assert len(got) == len(want)
    for r in got:
        vs = want[r.key_field, r.key_value]
        here = [v for v in vs if v is not None]
        assert (r.n_rows, r.n_valued, r.first_value, r.last_value) == (len(vs), len(here), min(here, default=None), max(here, default=None))


def test_hot_keys_edges(spark):
    empty = spark.createDataFrame([], "k string, n int, value string, chunk int")
    assert hot_keys(empty, {"k": F.col("k")}, 0.1).collect() == []
    # Columns named like the operator's own, nulls only, and repeated rows.
    df = spark.createDataFrame([("a", 1, "x", 0)] * 3 + [(None, 2, "y", 1)], "k string, n int, value string, chunk int")
    got = hot_keys(df, {"k": F.col("k")}, 0.5).collect()
    assert [(r.key_value, r.n_rows) for r in got] == [("a", 3)]
    with pytest.raises(ValueError, match="fan_in"):
        tree_aggregate(df, {"k": F.col("k")}, F.col("n"), fan_in=1)


def test_hot_keys_read_once_through_a_round(spark, tmp_path):
    """At any number of partitions there is a round of the tree, and one scan serves keys and totals."""
    spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) as k").repartition(2).write.parquet(str(tmp_path / "t"))
    got = hot_keys(spark.read.parquet(str(tmp_path / "t")), {"k": F.col("k")}, 0.1, chunk_rows=200)
    assert [tuple(r) for r in got.collect()] == [("k", "hot", 1000)]
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert "slot" in plan and "/t]" not in plan and "/t," not in plan  # the table itself was read before, by the states


def _brute_spans(rows):
    cover = defaultdict(set)
    for g, a, b in rows:
        if a is not None and b is not None:
            cover[g].update(range(min(a, b), max(a, b)))
    out = []
    for g, on in cover.items():
        edges = sorted(p for p in on if p - 1 not in on), sorted(p + 1 for p in on if p + 1 not in on)
        out += [("period", g, a, b) for a, b in zip(*edges, strict=True)]
        out += [("gap", g, b, a) for b, a in zip(edges[1][:-1], edges[0][1:], strict=True)]
    return Counter(out)


@pytest.mark.parametrize("tile", [4, 32, 1 << 18])
def test_spans_against_brute_force(spark, tile):
    rng = random.Random(tile)
    rows = []
    for _ in range(500):
        a = rng.randrange(-60, 400)
        rows.append((rng.choice(["x", "y", None]), rng.choice([a, None]) if rng.random() < 0.05 else a, a + rng.choice([0, 1, 2, 3, 5, -2, 40])))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "k string, s long, e long")
    got = merge_spans(df, {"g": F.col("k")}, F.col("s"), F.col("e"), tile=tile)
    assert Counter(tuple(r) for r in got.collect()) == _brute_spans(rows)


def test_spans_edges(spark):
    schema = "tile string, lo long, hi long, extra int"
    keys = {"tile": F.col("tile")}
    assert merge_spans(spark.createDataFrame([], schema), keys, F.col("lo"), F.col("hi")).collect() == []
    df = spark.createDataFrame([("a", 5, 5, 1), ("a", None, 3, 1), ("b", 2**33, 2**33 + 5, 1)], schema)
    got = [tuple(r) for r in merge_spans(df, keys, F.col("lo"), F.col("hi")).collect()]
    assert got == [("period", "b", 2**33, 2**33 + 5)]
    with pytest.raises(ValueError, match="taken"):
        merge_spans(df, {"span_kind": F.col("tile")}, F.col("lo"), F.col("hi"))


LINES = {
    "chr1\t1\t2": None, "chr1 1 2": None, "chr1  1   2\r": None, "": "columns", "chr1\t1": "columns", "#x": "skip", "browser x": "skip", "track a=1": "skip", 'track "a': "quoting",
    "chr1\tx\t2": "chrom_start", "chr1\t1\t": "chrom_end", "chr1\t1\t2\tn\t.": None, "chr1\t1\t2\tn\t": None, "chr1\t1\t2\tn\t1.5": "score", "chr1\t1\t2\tn\t0x1F": "score", "chr1\t+1\t-2": None,
    "chr1\t2147483648\t2": "chrom_start", "chr1\t-2147483648\t2": None, "chr1\t1\t2\tn\t5\t+\tq\t7": "thick_start", "chr1\t1\t2\tn\t5\t+\t6\t": "thick_end", 'chr1\t1\t2\t"a b\tc"\t5': None,
    'chr1\t1\t2\t"a': "quoting", "\t".join("chr1 1 2 n 5 + 6 7 8 9 10 11".split()): None, "\t".join("chr1 1 2 n 5 + 6 7 8 9 10 11 12".split()): "columns", "chr1\t1_0\t2": "chrom_start",
    "chr1\t٣\t2": "chrom_start", "chr1\t+-1\t2": "chrom_start", "chr1\t00000000000000000007\t2": None, 'chr1\t1\t2\t""\t"5"': "score", "chr1\t\t\t2": "chrom_start", "chr1\t1\t2\r\r": "chrom_end",
}


@pytest.mark.parametrize("block", [1, 3, 512])
def test_bad_lines(spark, block):
    rows = [(i, t) for i, t in enumerate(LINES)] + [(1000, None)]
    df = spark.createDataFrame(rows, "line_id long, line_text string").coalesce(1)
    got = {r.line_id: r for r in badlines.parse_lines(df, "line_text", ["line_id"], block=block).collect()}
    assert len(got) == len(rows)
    for i, (text, reason) in enumerate(LINES.items()):
        r = got[i]
        assert (r.reason, r.kind == "bad") == ((None, False) if reason in (None, "skip") else (reason, True)), text
    assert got[1000].reason == "columns"
    plus = got[list(LINES).index("chr1\t+1\t-2")]
    assert (plus.container_name, plus.chrom_start, plus.chrom_end, plus.feature_name) == ("chr1", 1, -2, None)
    assert got[list(LINES).index('chr1\t1\t2\t"a b\tc"\t5')].feature_name == '"a b\tc"'


def test_bad_lines_edges(spark):
    empty = spark.createDataFrame([], "id long, line string")
    assert badlines.bad_lines(empty, "line", ["id"]).collect() == []
    long = "chr1\t1\t2\t" + "n" * 300_000
    df = spark.createDataFrame([(1, long), (1, long), (None, "x")], "reasons long, line string")
    got = badlines.parse_lines(df, "line", ["reasons"]).collect()
    assert sorted((r.reasons or 0, r.kind) for r in got) == [(0, "bad"), (1, "entry"), (1, "entry")]
    with pytest.raises(ValueError, match="taken"):
        badlines.parse_lines(df, "line", ["reasons", "score"][1:])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet='ab1-+."\t 0x#', max_size=24), min_size=1, max_size=12))
def test_fast_path_agrees_with_strict_one(lines):
    cells = badlines.Cells(pa.array(lines))
    good, bad = badlines.resolve(cells, 4)
    assert sorted([*bad, *(i for rows, _ in good for i in rows)]) == list(range(len(lines)))
    for rows, values in good:
        columns = cells.columns(rows, values.to_numpy())
        for k, i in enumerate(rows):
            kind, _, row = badlines.diagnose(lines[i])
            assert kind == "entry", lines[i]
            assert [c[k].as_py() for c in columns] == row, lines[i]
